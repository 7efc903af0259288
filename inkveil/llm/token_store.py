"""Token-ID output as a content-addressed store.

Every text is encoded, an end id is appended, and a rolling hash over the ids cuts the stream of each
document into chunks, so that equal passages give equal chunks wherever they lie. A store is a folder
with three tables of Parquet files:

* ``chunks``: hash (blake2b, 16 bytes), n, ids (little-endian, ``width`` bytes each); each distinct
  chunk once, whatever the number of documents that hold it.
* ``recipes``: in ascending doc_id order: doc_id, segment, start (ids of all documents before it),
  n_tokens, the chunks' hashes and lengths in order, and the root of their Merkle tree.
* ``manifest``: Merkle roots of blocks of documents, of segments and of the whole store.

Readers verify: each chunk against its hash, each recipe against its root, the recipes against the
manifest, and the lengths. ``read_digests`` checks and sums up documents without moving ids: CRC-32
of a document is combined from those of its chunks. ``read_ids`` rebuilds the ids themselves.

Defined cases: a null text is an empty one, and a document without text has the end id alone. Texts
of any length are read whole. Rows that share a doc_id are separate documents, in order of their
roots; a null doc_id comes first. An empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch

END_ID = 2
#: Chunks: ids in the rolling window, shortest, bits of the hash that must be zero (mean length), longest.
ROLL, SHORTEST, CUT_BITS, LONGEST = 16, 64, 8, 2048
BLOCK = 1024
#: Chunks that a task remembers as written.
_MEMORY = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """A hash of the last ``ROLL`` ids at each place, by doubling the window."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    span = 1
    while span < ROLL:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint64(span)
        h = h + shifted
        span *= 2
    return h


def cut(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document between two ``bounds``: the ends of its chunks."""
    marks = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - CUT_BITS) == 0) + 1
    out = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, at = [], start
        while stop - at > SHORTEST:
            k = np.searchsorted(marks, at + SHORTEST)
            end = min(int(marks[k]) if k < len(marks) else stop, at + LONGEST, stop)
            ends.append(end)
            at = end
        if at < stop:
            ends.append(stop)
        out.append(ends)
    return out


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of the binary tree over the hashes; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\x00" + h).digest() for h in hashes]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                     end_id: int = END_ID, width: int = 4) -> DataFrame:
    """Per document: recipe columns, and ``fresh``: the bytes of chunks not yet met in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_encoder import Encoder

        encoder, met = _encoder(Encoder, tokenizer_path), set()
        for batch in batches:
            for where, ids, n in encoder.encode(batch.column("_text").to_numpy(zero_copy_only=False).tolist()):
                ends = np.cumsum(n) + np.arange(1, len(n) + 1)
                stream = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
                inside = np.ones(len(stream), dtype=bool)
                inside[ends - 1] = False
                stream[inside] = ids
                raw = stream.astype(f"<u{width}").tobytes()
                hashes, fresh, roots, counts, stops = [], [], [], [], []
                start = 0
                for cuts in cut(stream, np.concatenate([[0], ends])):
                    first = len(hashes)
                    for end in cuts:
                        data = raw[start * width : end * width]
                        h = hashlib.blake2b(data, digest_size=16).digest()
                        fresh.append(None if h in met else data)
                        met.add(h)
                        hashes.append(h)
                        start = end
                    roots.append(merkle_root(hashes[first:]))
                    counts.append(len(cuts))
                    stops += cuts
                if len(met) > _MEMORY:
                    met = set()
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lengths = np.diff(np.array(stops, dtype=np.int64), prepend=0).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((hashes, pa.binary()), (lengths, pa.int32()), (fresh, pa.binary()))]
                columns = [batch.column(key).slice(where.start, len(where)), pa.array(n + 1), lists[0], lists[1], pa.array(roots, pa.binary()), lists[2]]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "hashes", "lengths", "root", "fresh"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, hashes array<binary>, lengths array<int>, root binary, fresh array<binary>"
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


_ENCODERS: dict = {}


def _encoder(kind, path: str):
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = kind(path)
    return _ENCODERS[path]


def write_store(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                end_id: int = END_ID, width: int = 4) -> str:
    """Encode ``docs`` and write the three tables under ``path``."""
    encoded = materialise(encode_documents(docs, tokenizer_path, key, text, end_id, width), "encoded")
    fresh = encoded.select(F.explode(F.arrays_zip("hashes", "lengths", "fresh")).alias("c")).filter("c.fresh IS NOT NULL")
    fresh.select(F.col("c.hashes").alias("hash"), F.col("c.lengths").alias("n"), F.col("c.fresh").alias("ids")).dropDuplicates(
        ["hash"]
    ).withColumn("width", F.lit(width)).write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered = (
        encoded.select(F.col(key).alias("doc_id"), "n_tokens", "hashes", "lengths", "root")
        .repartitionByRange("doc_id", "root")
        .sortWithinPartitions("doc_id", "root")
        .withColumn("segment", F.spark_partition_id())
    )
    ordered = materialise(ordered, "ordered")
    in_segment = Window.partitionBy("segment").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment
    bases = (
        ordered.groupBy("segment")
        .agg(F.sum("n_tokens").alias("_n"))
        .select("segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    place = F.row_number().over(Window.partitionBy("segment").orderBy("doc_id", "root"))
    recipes = (
        ordered.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(in_segment), F.lit(0)))
        .withColumn("place", place)
        .join(bases, "segment")
        .select("doc_id", "segment", "place", (F.col("_base") + F.col("_inside")).alias("start"), "n_tokens", "hashes", "lengths", "root")
    )
    recipes.sortWithinPartitions("segment", "place").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(docs.sparkSession.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return path


def manifest(recipes: DataFrame) -> DataFrame:
    """Roots of blocks of ``BLOCK`` documents, of segments and of the store."""

    def roots(df: DataFrame, level: str, keys: list, order: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda x: F.hex(x.root)), "")
        sums = [F.min("start").alias("start"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")]
        return df.groupBy(*keys).agg(*sums, F.unhex(F.sha2(joined, 256)).alias("root")).withColumn("level", F.lit(level))

    base = recipes.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)).withColumn("documents", F.lit(1).cast("long"))
    blocks = roots(base, "block", ["segment", "block"], "place")
    segments = roots(blocks, "segment", ["segment"], "block").withColumn("block", F.lit(None).cast("long"))
    store = roots(segments, "store", [F.lit(0).alias("_all")], "segment").drop("_all")
    store = store.withColumn("block", F.lit(None).cast("long")).withColumn("segment", F.lit(None).cast("int"))
    return blocks.unionByName(segments).unionByName(store)


def verify_manifest(spark, path: str) -> None:
    """Raise if the manifest does not follow from the recipes."""
    written = spark.read.parquet(f"{path}/manifest")
    fresh = manifest(spark.read.parquet(f"{path}/recipes")).select(written.columns)
    both = written.withColumn("_sign", F.lit(1)).unionByName(fresh.withColumn("_sign", F.lit(-1)))
    if not both.groupBy(*written.columns).agg(F.sum("_sign").alias("_sign")).filter("_sign != 0").isEmpty():
        raise ValueError(f"the manifest of {path} does not match its recipes")


def chunk_references(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of a document: doc_id, start, place, hash, n and ``after`` (ids behind it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, start, total, hashes, lengths, root in batch.itertuples(index=False):
                if merkle_root(list(hashes)) != root or sum(lengths) != total:
                    raise ValueError(f"the recipe at {start} does not match its root")
                behind = total - np.cumsum(lengths)
                out += [(doc, start, k, h, n, b) for k, (h, n, b) in enumerate(zip(hashes, lengths, behind, strict=True))]
            yield pd.DataFrame(out, columns=["doc_id", "start", "place", "hash", "n", "after"])

    kind = recipes.select("doc_id").schema[0].dataType.simpleString()
    columns = recipes.select("doc_id", "start", "n_tokens", "hashes", "lengths", "root")
    return columns.mapInPandas(run, f"doc_id {kind}, start long, place int, hash binary, n int, after long")


def checked_chunks(chunks: DataFrame, with_ids: bool = False) -> DataFrame:
    """hash, n and CRC-32 (of ids as 4 bytes each) of each chunk, after its hash was verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crc = []
            for h, n, data, width in batch.itertuples(index=False):
                if hashlib.blake2b(data, digest_size=16).digest() != bytes(h) or len(data) != n * width:
                    raise ValueError("a chunk does not match its hash")
                crc.append(zlib.crc32(data if width == 4 else np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            out = batch.rename(columns={"n": "found"}) if with_ids else batch[["hash", "n"]].rename(columns={"n": "found"})
            yield out.assign(crc=np.array(crc, dtype=np.int64))

    schema = "hash binary, found int" + ", ids binary, width int" * with_ids + ", crc long"
    return chunks.select("hash", "n", "ids", "width").mapInPandas(run, schema)


def _zero_tables() -> np.ndarray:
    """CRC-32 register after 2**k zero bytes, by byte of the register before: shape (40, 4, 256)."""
    one = [0xEDB88320] + [1 << (i - 1) for i in range(1, 32)]  # one zero bit, for each register bit

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = one
    for _ in range(3):
        m = [times(m, x) for x in m]
    tables = np.zeros((40, 4, 256), dtype=np.uint32)
    for k in range(40):
        for byte in range(4):
            for value in range(256):
                tables[k, byte, value] = times(m, value << (8 * byte))
        m = [times(m, x) for x in m]
    return tables


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the CRC-32 of a part adds to that of a whole in which ``n_bytes`` follow the part."""
    global _TABLES
    if _TABLES is None:
        _TABLES = _zero_tables()
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(40):
        at = np.flatnonzero((n_bytes >> k) & 1)
        if len(at):
            v = crc[at]
            t = _TABLES[k]
            crc[at] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return crc


_TABLES: np.ndarray | None = None


def read_digests(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32.

    Only hashes and sums meet in the join, and a chunk that very many documents share makes rows of
    a few bytes, whose partition Spark splits.
    """
    references = chunk_references(spark.read.parquet(f"{path}/recipes"))
    chunks = checked_chunks(spark.read.parquet(f"{path}/chunks"))

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))

    joined = references.join(chunks, "hash", "left").select(
        "doc_id",
        "start",
        F.when(F.col("found") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing"))).alias("n"),
        shifted("crc", "after").alias("part"),
    )
    return joined.groupBy("doc_id", "start").agg(
        F.sum(F.col("n").cast("long")).alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")
    )


def read_ids(spark, path: str) -> DataFrame:
    """Per document: doc_id, start and its ids as an array, rebuilt from its chunks."""
    references = chunk_references(spark.read.parquet(f"{path}/recipes"))
    chunks = checked_chunks(spark.read.parquet(f"{path}/chunks"), with_ids=True)

    @F.pandas_udf("array<long>")
    def ids(data: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, f"<u{w}").astype(np.int64) for d, w in zip(data, width, strict=True)])

    parts = references.join(chunks, "hash").select("doc_id", "start", "place", ids("ids", "width").alias("ids"))
    return parts.groupBy("doc_id", "start").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x.ids)).alias("ids")
    )


def store_digests(docs: DataFrame, tokenizer_path: str, width: int) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder, verify it and return what reads back."""
    spark = docs.sparkSession
    path = write_store(docs, scratch(spark, "store"), tokenizer_path, width=width)
    verify_manifest(spark, path)
    return read_digests(spark, path)


def production_tokenizer() -> tuple[str, int]:
    """Path of the 50,257-id byte-level BPE file, and the bytes that one of its ids needs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), 2


def query(spark, sf_dir: str) -> DataFrame:
    path, width = production_tokenizer()
    return store_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, width)
