"""Files as documents: binary scan, dispatch by extension, e-mail parsing, labelled corpora."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.blocks import structured_markdown

ATTACHMENT_LIMIT = 15 << 20
_MAIL = "struct<subject:string,sender:string,recipients:string,date:string,body:string,is_html:boolean,attachments:array<struct<filename:string,size:bigint,mime:string,skipped:boolean,reason:string,content_base64:string>>,error:string>"

#: Extensions whose files hold records.
RECORDS = ("csv", "json", "xml")
#: Extensions whose readers need a library that this package does not bring.
NEEDS_READER = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def scan(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files of a folder: path, name, extension, content. Names of unknown extensions are left out. Sort by path where order matters, without the contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    named = files.select("path", name.alias("name"), T.extension(name).alias("extension"), "modificationTime", "length", "content")
    return named.filter(T.allowed(F.col("name")))


def parse_mail(content: bytes | None, limit: int = ATTACHMENT_LIMIT) -> dict:
    """Headers, body and attachments of a message; what can't be read is told in ``error``."""
    empty = dict.fromkeys(("subject", "sender", "recipients", "date", "body"), "") | {"is_html": False, "attachments": [], "error": None}
    try:
        message = BytesParser(policy=policy.default).parsebytes(content or b"")
        body = message.get_body(preferencelist=("plain", "html"))
        attachments = []
        for part in message.iter_attachments():
            data = part.get_payload(decode=True) or b""
            over = len(data) > limit
            attachments.append({
                "filename": part.get_filename() or "attachment", "size": len(data), "mime": part.get_content_type(), "skipped": over,
                "reason": f"over {limit} bytes" if over else None, "content_base64": None if over else base64.b64encode(data).decode(),
            })
        return empty | {
            "subject": str(message.get("subject", "")), "sender": str(message.get("from", "")), "recipients": str(message.get("to", "")),
            "date": str(message.get("date", "")), "body": body.get_content() if body else "", "is_html": bool(body and body.get_content_type() == "text/html"),
            "attachments": attachments,
        }
    except Exception as e:  # noqa: BLE001  a broken message is a row with an error, not a failed job
        return empty | {"error": f"{type(e).__name__}: {e}"}


def mails(files: DataFrame, limit: int = ATTACHMENT_LIMIT) -> DataFrame:
    """``files`` with a struct ``mail``: headers on one line, body, attachments, error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_mail(c, limit) for c in batch])

    # other files do not go through the parser
    content = F.when(F.col("extension") == "eml", F.col("content")) if "extension" in files.columns else F.col("content")
    return files.withColumn("mail", F.pandas_udf(run, _MAIL)(content))


def attachments(files: DataFrame, limit: int = ATTACHMENT_LIMIT) -> DataFrame:
    """One row for each attachment of the messages."""
    return mails(files, limit).select("path", F.explode("mail.attachments").alias("a")).select("path", "a.*")


def mail_markdown(files: DataFrame) -> DataFrame:
    """Messages as Markdown: a heading, the headers, and the messages of the thread, newest first."""
    parsed = mails(files).withColumn("_body", F.when(F.col("mail.is_html"), T.html_to_text(F.col("mail.body"))).otherwise(F.col("mail.body")))
    parsed = parsed.withColumn("thread", T.split_thread(F.col("_body")))
    header = lambda name, c: F.concat(F.lit(f"**{name}:** "), T.one_line(F.col(c)))
    listed = F.transform("mail.attachments", lambda a: F.concat(F.lit("- "), a.filename, F.lit(" ("), a.size.cast("string"), F.lit(" bytes)")))
    messages = F.transform("thread", lambda m, i: F.when(i == 0, m).otherwise(F.concat(F.lit("## Earlier message "), i.cast("string"), F.lit("\n\n"), m)))
    text = F.concat(
        F.concat_ws("\n", F.concat(F.lit("# "), T.one_line(F.col("mail.subject"))), F.lit(""), header("From", "mail.sender"), header("To", "mail.recipients"), header("Date", "mail.date")),
        F.lit("\n\n"), F.array_join(messages, "\n\n"),
        F.when(F.size("mail.attachments") > 0, F.concat(F.lit("\n\n## Attachments\n\n"), F.array_join(listed, "\n"))).otherwise(F.lit("")),
    )
    return parsed.withColumn("markdown", text).drop("_body")


def convert(files: DataFrame) -> DataFrame:
    """Each file as text: markdown, engine, prose flag and error; formats without a reader get an error."""
    plain, ext = T.plain_text(F.col("content")), F.col("extension")
    own = mail_markdown(files)
    markdown = (
        F.when(ext == "eml", F.col("markdown"))
        .when(ext.isin("html", "htm"), T.html_to_text(plain))
        .when(ext.isin(*NEEDS_READER), None)
        .when(ext.isin(*RECORDS), structured_markdown(F.when(ext.isin(*RECORDS), plain), ext))
        .otherwise(T.strip_comments(plain))
    )
    engine = F.when(ext.isin(*RECORDS), "records").when(ext == "eml", "mail").when(ext.isin("html", "htm"), "html").when(ext.isin(*NEEDS_READER), None).otherwise("text")
    error = F.when(ext.isin(*NEEDS_READER), F.concat(F.lit("no reader for ."), ext)).otherwise(F.col("mail.error"))
    return own.select("path", "name", "extension", "content", markdown.alias("markdown"), engine.alias("engine"), T.prose(F.col("name")).alias("prose"), error.alias("error"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus in JSON lines: source_text and entities (label, value)."""
    return spark.read.schema("source_text string, entities array<struct<label:string,value:string>>").json(path)
