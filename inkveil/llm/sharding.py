"""Sharding by fixed virtual slots, in DataFrame expressions only.

A record's slot is a hash of its id and text, modulo ``SLOTS``; it never changes. A table maps slots to
shards. Its version 1 deals the slots out in turn. ``rebalance`` edits a version from the bytes counted in
each slot and gives the next one: a shard keeps its slots as long as they fit under the mean of all
shards, and only the slots beyond move, the largest first, each to the shard that is least full then. So
the shards' bytes differ by about a small slot, and an edit moves no more slots than it must. The same edit
makes room for more shards, or empties shards that go. ``store_map`` and ``load_map`` keep all versions.

Rows are never brought together by shard. Bytes and rows are summed up for each slot before the shuffle; the
map has ``SLOTS`` rows, whatever the input, so it alone is broadcast, sorted in one task and folded. Places
in a shard are numbered in cells of about ``CELL_ROWS`` rows of a slot; what comes before a cell is summed up
over the cells of a slot, then over the slots of a shard.

Defined cases: a null text has no bytes and its size is 1. A null id is an id like others. Rows that repeat an
id have slots of their own unless their texts are equal too; rows equal in both are separate records in one
slot. Texts of any length count whole. Shards may be empty if there are fewer slots with rows than shards.
Extra columns are ignored by ``place`` and kept by ``assign``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch

SHARDS = 16
SLOTS = 4096
SEED = 12
#: Rows of a slot that are numbered in one cell, on average.
CELL_ROWS = 4096
#: Part of its share by which a shard may be above it without giving slots away.
SLACK = 0.001
#: What the shards hold to: near equal bytes.
LAW = "bytes"


def record_hash(key: Column, text: Column) -> Column:
    """64-bit hash of a record."""
    return F.xxhash64(key, text, F.lit(SEED))


def slot_of(h: Column, slots: int = SLOTS) -> Column:
    return F.pmod(h, F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1 (version, vslot, shard): slots dealt out in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the slots that have records; ``records`` has vslot and size."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for ``shards`` shards, edited as far as the bytes of its slots ask for it.

    ``current`` is one version, with a row for each slot; both tables have at most as many rows as slots.
    Slots of shards that no longer exist all move. A slot above its shard's share moves to the least full shard, which a second
    pass empties of all else.
    """
    once = materialise(_edited(current, sizes, shards), "slot-map")
    return _edited(once, sizes, shards).withColumn("version", F.col("version") - 1)


def _edited(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    known = current.join(F.broadcast(sizes.select("vslot", "bytes")), "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    # the level that shards fill up to: the mean of what is left when slots above the mean have a shard of their own
    whole = Window.partitionBy(F.lit(0))
    falling = whole.orderBy(F.col("bytes").desc(), "vslot")
    larger = F.coalesce(F.sum("bytes").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(shards) - F.row_number().over(falling) + 1
    mean = F.when(left > 0, (F.sum("bytes").over(whole) - larger) / left)
    ranked = known.withColumn("mean", mean)
    level = F.coalesce(F.min(F.when(F.col("bytes") <= F.col("mean"), F.col("mean"))).over(whole), F.lit(0.0))
    order = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot")
    filled = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a shard's largest slot stays, and all that fit with it; smaller ones behind those that do not fit move too, so what moves last is small
    fits = (F.row_number().over(order) == 1) | (filled <= F.col("level") * (1 + SLACK))
    marked = ranked.withColumn("level", level).withColumn("stays", (F.col("shard") < shards) & fits)
    one = marked.agg(
        F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("moving"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes", "vslot"))).alias("staying"),
        (F.max("version") + 1).alias("version"),
    )
    kept = lambda j: F.aggregate(F.filter("staying", lambda x: x.shard == j), F.lit(0).cast("long"), lambda a, x: a + x.bytes)
    full = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), kept)
    one = one.withColumn("moving", F.array_sort("moving")).withColumn("full", full)

    def give(state, x):
        least = F.array_position(state.full, F.array_min(state.full)).cast("int") - 1
        return F.struct(
            F.transform(state.full, lambda b, i: F.when(i == least, b - x.less).otherwise(b)).alias("full"),
            F.array_append(state.to, least).alias("to"),
        )

    start = F.struct(F.col("full"), F.array().cast("array<int>").alias("to"))
    dealt = one.withColumn("to", F.aggregate("moving", start, give).getField("to"))
    moved = F.transform("moving", lambda x, i: F.struct(x.vslot.alias("vslot"), F.get("to", i).alias("shard")))
    stayed = F.transform("staying", lambda x: F.struct(x.vslot.alias("vslot"), x.shard.alias("shard")))
    return dealt.select("version", F.inline(F.concat(moved, stayed))).select("version", "vslot", "shard")


def store_map(table: DataFrame, path: str) -> None:
    """Add the versions in ``table`` to those kept in ``path``."""
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map kept in ``path``, by default the last."""
    kept = spark.read.schema("vslot int, shard int, version int").parquet(path)
    last = kept.agg(F.max("version")).first()[0] if version is None else version
    return kept.filter(F.col("version") == last).select("version", "vslot", "shard")


def _records(docs: DataFrame, key: str, text: str, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, h, vslot): one narrow row for each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        record_hash(F.col(key), F.col(text)).alias("h"),
    )
    return rows.withColumn("vslot", slot_of(F.col("h"), slots))


def balanced_map(records: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Store version 1 and its edit for these records in ``path``, and give the last version."""
    spark = records.sparkSession
    store_map(first_map(spark, shards, slots), path)
    sizes = materialise(slot_sizes(records), "slot-sizes")
    store_map(rebalance(load_map(spark, path), sizes, shards), path)
    return load_map(spark, path)


def assign(docs: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS, out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``: the shard that ``table``, one version of the map, gives each record. No shuffle."""
    facts = table.select(F.col("vslot").alias("_vslot"), F.col("shard").alias("_shard"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), slot_of(record_hash(F.col(key), F.col(text)), slots).alias("_slot"))
    joined = packed.join(F.broadcast(facts), F.col("_slot") == F.col("_vslot"))
    return joined.select(F.col("_d").withField(out, F.col("_shard")).alias("_d")).select("_d.*")


def write_shards(docs: DataFrame, table: DataFrame, path: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> None:
    """Write the records in a folder for each shard. A shard's rows come from all tasks, so none is one task's work."""
    assign(docs, table, key, text, slots).write.partitionBy("shard").parquet(path)


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot (place in its shard, from 0 without a gap), grown_shard, vslot, version.

    Places go by slot and then by hash. ``map_path`` is where the versions of the map are kept (by default a fresh folder).
    """
    records = materialise(_records(docs, key, text, slots), "records")
    table = balanced_map(records, map_path or scratch(docs.sparkSession, "slot-map"), shards, slots)
    counts = slot_sizes(records).join(F.broadcast(table), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    cells = F.ceil(F.col("rows") / CELL_ROWS).cast("int")
    # one row a slot
    facts = F.broadcast(
        materialise(
            counts.select("version", "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("slot_base"), cells.alias("cells")), "slot-facts"
        )
    )
    # the bits of the hash that did not choose the slot choose the cell
    fine = F.shiftrightunsigned(F.xxhash64("h"), 1)
    named = records.join(facts, "vslot").withColumn("cell", F.floor(fine * (F.col("cells") / float(1 << 63))).cast("int"))
    inside = Window.partitionBy("vslot", "cell").orderBy("h", "doc_id", "size")
    numbered = named.withColumn("inside", F.row_number().over(inside) - 1)
    earlier = Window.partitionBy("vslot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = named.groupBy("vslot", "cell").agg(F.count(F.lit(1)).alias("n"))
    bases = materialise(per_cell.select("vslot", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_base")), "cell-bases")
    return numbered.join(bases, ["vslot", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("slot_base") + F.col("cell_base") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "version",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
