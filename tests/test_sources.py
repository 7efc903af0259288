"""Files, mails, sinks and the watched folder."""

import os
import time
from email.message import EmailMessage

from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators.options import only
from inkveil.sources import files, sinks
from inkveil.streaming import hotfolder


def _mail() -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@x.org", "b@x.org"
    m.set_content("New text\nOn Monday, Bo wrote:\n> Old text\n")
    m.add_attachment(b"12345", maintype="application", subtype="octet-stream", filename="a.bin")
    return m.as_bytes()


def test_scan_convert_and_attachments(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(_mail())
    (tmp_path / "b.txt").write_bytes("café <!-- x -->\nend".encode() + b"\xff")
    (tmp_path / "c.exe").write_bytes(b"no")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    found = files.scan(spark, f"file://{tmp_path}")
    rows = {r.name: r for r in files.convert(found).collect()}
    assert set(rows) == {"a.eml", "b.txt", "d.pdf"}
    assert "New text" in rows["a.eml"].markdown and "## Earlier message 1\n\nOld text" in rows["a.eml"].markdown
    assert rows["b.txt"].markdown == "café end�" and rows["d.pdf"].error == "no reader for .pdf"
    assert rows["a.eml"].prose is True and rows["d.pdf"].prose is None
    small = files.attachments(found.filter("extension = 'eml'"), limit=3).collect()
    assert [(a.filename, a.size, a.skipped) for a in small] == [("a.bin", 5, True)]


def test_comments_that_never_end_stay(spark):
    df = spark.createDataFrame([("a<!-- b -->\nc<!-- d",), ("<!--" * 20000,)], "t string")
    got = [r[0] for r in df.select(T.strip_comments(F.col("t"))).collect()]
    assert got == ["ac<!-- d", "<!--" * 20000]


def test_merge_and_names(spark):
    df = spark.createDataFrame([(1, "/x/b.txt", "B", None), (1, "/x/a.txt", "---\nk: 1\n---\nA", None), (1, "/x/a.eml", "", "bad")], "g int, path string, md string, err string")
    assert sinks.merge(df, ["g"], "path", "path", "md", "err").first().merged == "# 1. /x/a.eml\n\n> error: bad\n\n---\n\n# 2. /x/a.txt\n\nA\n\n---\n\n# 3. /x/b.txt\n\nB"
    assert {r.path: r.output for r in sinks.output_names(df.select("path")).collect()} == {"/x/a.eml": "a.md", "/x/a.txt": "a-txt.md", "/x/b.txt": "b.md"}


def test_hot_folder(spark, tmp_path):
    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    (inbox / "a.txt").write_text("mail x@y.org")

    def run(**more):
        hotfolder.start(spark, f"file://{inbox}", f"file://{out}", f"file://{state}", only("emails"), once=True, **more).awaitTermination()
        return sorted((r.name, r.redacted, r.output) for r in spark.read.parquet(f"file://{out}").collect())

    first = [("a.txt", "mail {{EMAIL_1}}", "a.md")]
    assert run() == first and run() == first  # the second run finds nothing new
    (inbox / "a.md").write_text("old")
    os.utime(inbox / "a.md", (1e9, 1e9))  # moved in with an old time, and with a name that is taken
    found = run()
    assert len(found) == 2 and found[0][:2] == ("a.md", "old") and found[0][2] not in ("a.md",)
    (inbox / "a.txt").write_text("new x@y.org")
    os.utime(inbox / "a.txt", (time.time() + 5, time.time() + 5))
    assert len(run(settled_seconds=60)) == 2  # too young: it waits
    os.utime(inbox / "a.txt", (time.time() - 100, time.time() - 100))
    assert ("a.txt", "new {{EMAIL_1}}", "a.md") in run(settled_seconds=60)


def test_compare_takes_groups_of_two(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d"), (3, 2, "e"), (3, 3, "f")], "g int, o int, md string")
    assert [tuple(r) for r in sinks.compare(df, ["g"], "o", "md").collect()] == [(1, "# A\n\na\n\n# B\n\nb")]


def test_one_file_for_each_document(spark, tmp_path):
    df = spark.createDataFrame([("a b.md", "é\nx"), ("b.md", ""), ("c.md", None), (None, "lost")], "output string, markdown string").repartition(3)
    for _ in range(2):
        assert sinks.write_markdown(df, f"file://{tmp_path}/out") == 3
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a b.md": "é\nx", "b.md": "", "c.md": ""}
    assert sinks.write_markdown(df.filter("false"), f"file://{tmp_path}/none") == 0
