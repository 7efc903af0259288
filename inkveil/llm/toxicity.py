"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded sample of labelled documents (``max_training_rows``, a parameter: the rows
first in a hash order of their ids, so that it is the same sample on each run). One task learns the
weights by the FTRL-proximal rule: a learning rate for each coordinate and L1 shrinkage, which leaves
most weights at zero. There are 2**``bits`` weights at most, so their size is bounded whatever the
corpus, and they are broadcast to score every document where it lies, without a shuffle.

Features of a text: its distinct words, pairs of neighbours and pairs with one word between, in
lower case, hashed; and, since insults are inflected and compounded, the stems of words (their
first bytes) that occur once, twice or four times. A label, language, source or id is never a
feature.

Defined cases: a null, empty or blank text has the bias alone as its score. Texts are read whole.
Without labelled rows every score is the prior 0.5 of an untrained model. Repeated rows are scored
one by one; a label row that is repeated counts once, null labels are skipped. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
MAX_TRAINING_ROWS = 12_000
THRESHOLD = 0.3
EPOCHS = 2
#: Lengths of word stems in bytes, and how often one must occur to count.
STEM_BYTES, STEM_TIMES = (4, 6, 8), (1, 2, 4)
ALPHA, BETA, L1, L2 = 0.1, 1.0, 1.0, 1.0

_MARKS = b".,;:!?\"'()*#%&$|"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a text; number 0 is the bias."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    words = [x.strip(_MARKS) for x in words]
    crc = zlib.crc32
    w = np.fromiter(map(crc, words), dtype=np.uint64, count=len(words))
    parts = [w * _A, (w[:-1] * _A ^ w[1:]) * _B, (w[:-2] * _B ^ w[2:]) * _C]
    for k in STEM_BYTES:
        stems = [crc(x[:k], k) for x in words if len(x) > k]
        found, times = np.unique(np.fromiter(stems, dtype=np.uint64, count=len(stems)), return_counts=True)
        parts += [(found[times >= least] + np.uint64(least)) * _C for least in STEM_TIMES]
    hashed = np.concatenate(parts) >> np.uint64(64 - bits)
    return np.unique(np.concatenate([np.zeros(1, np.uint64), np.maximum(hashed, np.uint64(1))])).astype(np.int64)


def _probability(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def train_ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS,
               alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights after ``epochs`` passes over (features, label) in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = _probability(float(w.sum())) - label
            root = np.sqrt(n[at])
            sigma = (np.sqrt(n[at] + g * g) - root) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def held_out(key: Column) -> Column:
    """True for the rows that are kept for testing: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_training_rows: int = MAX_TRAINING_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights that are not zero, learned from rows that are not held out."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(max_training_rows)
    )
    # the sample is bounded, so broadcasting it keeps the documents' texts from being shuffled
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, bits).astype("<u4").tobytes() for t in batch["_text"]]
            yield pd.DataFrame({"key": batch["_key"].astype("int64"), "label": batch["_label"], "features": found})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = pd.concat([pd.DataFrame({"key": [], "label": [], "features": []}), *batches])
        seen["order"] = [zlib.crc32(b"order %d" % int(k)) for k in seen["key"]]
        seen = seen.sort_values(["order", "key", "features"])
        examples = [(np.frombuffer(f, "<u4").astype(np.int64), int(y)) for f, y in zip(seen["features"], seen["label"], strict=True)]
        w = train_ftrl(examples, bits)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"feature": at, "weight": w[at]})

    extracted = rows.mapInPandas(extract, "key long, label int, features binary").repartition(1)
    weights = extracted.mapInPandas(learn, "feature long, weight double").toPandas()
    return weights["feature"].to_numpy(np.int64), weights["weight"].to_numpy(np.float64)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text",
          bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: key, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.select(F.col(key), held_out(F.col(key)).alias("held_out")).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << bits, dtype=np.float64)
        at, w = shared.value
        dense[at] = w
        for batch in batches:
            p = [_probability(float(dense[features(t, bits)].sum())) for t in batch["_text"]]
            out = batch[[key, "held_out"]].copy()
            out["score"] = p
            out["predicted"] = np.array([x >= threshold for x in p], dtype=np.int32)
            yield out

    return docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text")).mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
