"""What the training-data operators have in common: shared scratch space, words, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Spark's setting that drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path inside the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where nothing is set, a session of
    one machine uses a temporary folder; on a cluster, whose machines would not share it, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", path: str | None = None, dictionaries: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder (``path`` in it) and read it back: cuts lineage, survives lost executors.

    The shuffles of the write are of no use once it is done; Spark is told to drop their files then. ``dictionaries=False``
    saves the time of looking for repeated values in columns of hashes, which have none.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionaries).lower()).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Put an empty table in the place of written tables that nothing reads any more."""
    for path in paths:
        spark.range(0).write.mode("overwrite").parquet(path)


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space, as a long."""
    # one letter for each word, then no blanks: unlike a list of matches, it makes no string for each word
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(letters, BLANKS, "")).cast("long")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come before this row.

    Rows are ordered by ``bucket`` and then ``order``. A group may hold most of the table, so its
    rows are never brought together: rows are summed inside (group, bucket), and only one row for
    each bucket is ordered across the whole group.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(*group, bucket)
        .agg(F.sum(value).alias("_bucket_sum"))
        .withColumn("_base", F.coalesce(F.sum("_bucket_sum").over(across), F.lit(0)))
        .drop("_bucket_sum")
    )
    keys = [*group, bucket]
    left = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    on = [left[k].eqNullSafe(base[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = left.join(base, on)
    return joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside", *[f"_k{i}" for i in range(len(keys))])


#: Most facts that ``join_counted`` broadcasts.
HEAVY = 100_000


def join_counted(rows: DataFrame, facts: DataFrame, on: str, n: str = "n", total: int | None = None, least: int = 1000) -> DataFrame:
    """``rows`` joined with ``facts``, a written table of one narrow row for each value of ``on``.

    Column ``n`` of the facts (dropped) tells how many rows a value has, or a bound of it. At most ``HEAVY``
    values can have more than 1 / ``HEAVY`` of all rows; their facts are broadcast, so that no task gets all rows
    of such a value. Values with fewer rows, or with ``least`` or fewer, are shuffled.
    """
    known = facts.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    most = max(least, (known["all"] if total is None else total) // HEAVY) if known["most"] else least
    if not known["most"] or known["most"] <= most:
        return rows.join(facts.drop(n), on)
    heavy, light = facts.filter(F.col(n) > most).drop(n), facts.filter(F.col(n) <= most).drop(n)
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)
