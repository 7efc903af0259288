"""Tables between the steps of an operator: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a session of one machine without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table: its lineage ends there, so a lost executor costs one step and no plan holds another twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core of the cluster that ``spread`` deals rows to.
WAVES = 3


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in more parts, if their files make few: for much work on each of many small rows, of which one small file has any number."""
    parts = WAVES * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


#: Rows that one task sorts: some 100 to 200 MB.
SORTED_ROWS = 1 << 20


def dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """``rows`` by key, in as many parts as their number asks for: what a task sorts does not grow with the input, but by its largest key."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // SORTED_ROWS))
    return rows.repartition(parts, *keys)
