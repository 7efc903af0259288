"""Benchmark decontamination: find passages of test items inside training documents.

The windows of all benchmark items (``n`` consecutive normalised words, or the whole item if it is
shorter) form a hash set. When the items' text is within ``max_broadcast_bytes`` (checked, not
assumed) the set is broadcast and documents are scanned where they lie, without a shuffle. Larger
benchmarks are cut into slices below that bound, scanned one after another over the same rows, which
carry their hit spans and items along. Hash hits are verified by comparing the words.

Defined cases: null and wordless texts have no words and no hits; wordless items have no windows.
Texts are scanned whole. Overlapping hits count each word once. Items with equal text are all
reported. Null item ids are written as an empty string. Repeated document rows are reported one by
one. Extra columns are ignored by ``scan`` and kept by ``remove``. Empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

WINDOW = 10
#: Most bytes of benchmark text that one broadcast slice may hold.
MAX_BROADCAST_BYTES = 32 << 20

_BREAKS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: Bytes after lower-casing A-Z; bytes that are not part of a word become blanks.
_FOLD = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + bytes(b for b in _BREAKS if not 0x41 <= b <= 0x5A),
    bytes(range(0x61, 0x7B)) + b" " * (len(_BREAKS) - 26),
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z in lower case, runs without other ASCII than 0-9 and a-z."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _codes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash for each window of ``length`` word ids."""
    code = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    for k in range(length):
        code = (code ^ ids[k : k + len(code)].astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return code


class WindowSet:
    """The windows of some benchmark items, ready to be broadcast."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normalised_words(text)]
            length = min(n, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                owners = self.windows.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.codes = {
            length: np.unique(_codes_of_rows(np.array(list(found), dtype=np.int64))) for length, found in self.windows.items()
        }

    def hits(self, text: str | None) -> tuple[list[bytes], np.ndarray, set[str]]:
        """Words of the text, which of them are hit, and the items that occur."""
        found = normalised_words(text)
        hit, items = np.zeros(len(found), dtype=bool), set()
        if not found or not self.windows:
            return found, hit, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for length, codes in self.codes.items():
            if len(ids) < length:
                continue
            known = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(known):
                continue
            code = _codes(ids, length)[known]
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            for i in known[codes[at] == code].tolist():
                owners = self.windows[length].get(tuple(ids[i : i + length].tolist()))
                if owners:
                    hit[i : i + length] = True
                    items.update(owners)
        return found, hit, items


def _codes_of_rows(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([_codes(row, rows.shape[1]) for row in rows])


def _slices(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in lists whose texts stay below ``most`` bytes; slices are read one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("size")).first()["size"]
    n = int(size // most) + 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], r["text"]) for r in part.collect()]


def _scan_slice(found: DataFrame, windows: WindowSet) -> DataFrame:
    """``found`` with the spans and items of this slice added to those of its rows."""
    shared, names = found.sparkSession.sparkContext.broadcast(windows), found.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for value, before, owned in zip(*(batch.column(c).to_pylist() for c in ("_text", "spans", "items")), strict=True):
                words, hit, owners = shared.value.hits(value)
                for start, end in zip(before[::2], before[1::2], strict=True):
                    hit[start:end] = True
                n_words.append(len(words))
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist())
                items.append(sorted(owners.union(owned)))
            own = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names)

    return found.mapInArrow(scan, found.schema)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", n: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document row: key, n_words, spans (word offsets: start, end, start, end ...) and items.

    Nothing is shuffled, and rows stay apart whatever their keys: the slices of a large benchmark are
    scanned one after another over the same rows.
    """
    return _found(docs.select(key, F.col(text).alias("_text")), benchmark, item, item_text, n, max_broadcast_bytes).drop("_text")


def _found(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, n: int, max_broadcast_bytes: int) -> DataFrame:
    """Rows of two columns, the second ``_text``, with n_words, spans and items over all slices."""
    spans, items = F.array().cast(ArrayType(IntegerType())), F.array().cast(ArrayType(StringType()))
    found = docs.select("*", F.lit(0).cast("long").alias("n_words"), spans.alias("spans"), items.alias("items"))
    for part in _slices(benchmark, item, item_text, max_broadcast_bytes):
        found = _scan_slice(found, WindowSet(part, n))
    return found


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``scan`` found."""
    n_hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", how: str = "documents", n: int = WINDOW,
           item: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the contaminated documents, or without the hit spans of their text.

    ``how="spans"`` cuts each hit from the first letter of its first word to the last letter of its last. Hits are judged on
    the text as it was given, over all slices of the benchmark, and cut once.
    """
    if how not in ("documents", "spans"):
        raise ValueError("how is 'documents' or 'spans'")
    if how == "spans":
        # the row is one column, so that no name of its own meets those of the scan
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
        found = _found(packed, benchmark, item, item_text, n, max_broadcast_bytes)
        cut = F.pandas_udf(_cut, "string")("_text", "n_words", "spans")
        return found.withColumn("_text", F.when(F.size("spans") > 0, cut).otherwise(F.col("_text"))).select(F.col("row").withField(text, F.col("_text")).alias("row")).select("row.*")
    for items in _slices(benchmark, item, item_text, max_broadcast_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

        def clean(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[[not shared.value.hits(t)[1].any() for t in batch[text]]]

        docs = docs.mapInPandas(clean, docs.schema)
    return docs


def _cut(text: pd.Series, n_words: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, n, own in zip(text, n_words, spans, strict=True):
        hit = np.zeros(n, dtype=bool)
        for start, end in zip(own[::2], own[1::2], strict=True):
            hit[start:end] = True
        out.append(None if t is None else cut_spans(t, hit))
    return pd.Series(out, dtype=object)


def cut_spans(text: str | None, hit: np.ndarray) -> str | None:
    """The text without the runs of words that are hit."""
    if not hit.any():
        return text
    folded = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8)
    inside = np.concatenate([[0], (folded != 0x20).view(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(scan(docs, items))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw USING (m, g)),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
