"""Results as documents: merging, comparing, names of output files, payloads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge(df: DataFrame, by: list[str], order: str, title: str, markdown: str, error: str | None = None) -> DataFrame:
    """Documents of a group as one text: numbered headings, errors in place, front matter removed."""
    body = T.strip_frontmatter(F.col(markdown))
    if error:
        body = F.when(F.col(error).isNotNull(), F.concat(F.lit("> error: "), F.col(error))).otherwise(body)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(title).alias("t"), body.alias("b"))))
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("# "), (i + 1).cast("string"), F.lit(". "), p.t, F.lit("\n\n"), p.b)), "\n\n---\n\n")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), text.alias("merged"))


def compare(df: DataFrame, by: list[str], order: str, markdown: str) -> DataFrame:
    """Groups of exactly two documents, as A and B."""
    # counts and both ends are summed up before the shuffle, so that a large group is never collected
    one = F.struct(F.col(order).alias("o"), F.col(markdown).alias("b"))
    both = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(one).alias("_a"), F.max(one).alias("_b")).filter("_n = 2")
    return both.select(*by, F.concat(F.lit("# A\n\n"), F.col("_a.b"), F.lit("\n\n# B\n\n"), F.col("_b.b")).alias("compared"))


def output_names(df: DataFrame, path: str = "path") -> DataFrame:
    """``output``: stem.md; the second file of a stem gets stem-ext.md, further ones stem-ext-n.md."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    stem, ext = F.regexp_replace(name, r"\.[^.]+$", ""), T.extension(name)
    named = df.withColumn("_stem", stem).withColumn("_ext", ext)
    n = F.row_number().over(Window.partitionBy("_stem").orderBy(path))
    same = F.row_number().over(Window.partitionBy("_stem", "_ext").orderBy(path))
    output = F.when(n == 1, F.concat("_stem", F.lit(".md"))).when(
        (same == 1) | ((same == 2) & (F.first("_ext").over(Window.partitionBy("_stem").orderBy(path)) == F.col("_ext"))),
        F.concat_ws("", "_stem", F.lit("-"), "_ext", F.lit(".md")),
    ).otherwise(F.concat_ws("", "_stem", F.lit("-"), "_ext", F.lit("-"), same.cast("string"), F.lit(".md")))
    return named.withColumn("output", output).drop("_stem", "_ext")


def payload(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def scrub_paths(message: Column) -> Column:
    """A message without the folders of the paths in it."""
    return F.regexp_replace(message, r"(?:[A-Za-z]:)?(?:[/\\][^\s/\\:'\"]+)+[/\\]([^\s/\\:'\"]+)", "…/$1")


def write_markdown(df: DataFrame, folder: str, output: str = "output", markdown: str = "markdown") -> int:
    """One text file for each document in ``folder``, written by the tasks that hold the rows; the number of files.

    A file is written under another name and then renamed, so a reader never sees half of it; a task that runs again writes the same
    files. Rows with the same name must have the same text; names are those of ``output_names``. Null texts are written empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("name", "text")), strict=True):
                path, part = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write((text or "").encode())
                files.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(output).alias("name"), F.col(markdown).alias("text")).filter(F.col("name").isNotNull())
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
