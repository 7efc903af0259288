"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import redact
from ..operators.options import only
from . import checks


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which e-mail addresses or payment cards were replaced, with text and report."""
    from .recognisers import steps

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = redact(docs, "text", only("emails", "fiscal"), steps=steps("email", "card"))
    return found.select("doc_id", "redacted", F.col("report.total").alias("total"), F.map_entries("report.counts").alias("counts")).filter("total > 0")


def queries() -> dict:
    from . import evaluation, names, relational, recognisers, surface, variety

    return checks.queries() | recognisers.queries() | relational.queries() | names.queries() | evaluation.queries() | variety.queries() | surface.queries()


def oracle_sql() -> dict:
    from . import evaluation, names, relational, recognisers, surface, variety

    return checks.oracle_sql() | recognisers.oracle_sql() | relational.oracle_sql() | names.oracle_sql() | evaluation.oracle_sql() | variety.oracle_sql() | surface.oracle_sql()
