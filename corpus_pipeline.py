"""From raw documents to a verified token store, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import decontamination, mixing, quality_rules, simhash, token_store
from inkveil.llm.shared import scratch


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def drop_benchmark_text(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the schedule takes."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def store_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store; per document what reads back from it."""
    path, width = token_store.production_tokenizer()
    return token_store.store_digests(docs, path, width)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Fingerprints, the schedule and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
