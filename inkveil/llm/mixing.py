"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame expressions only.

Sizes are words. Sources share ``budget_percent`` of all sizes by their weights; a target stops at
``max_epochs`` times its source's size and the excess is shared again by weight among the others.

Each source is shuffled (by a hash of its documents) and read as one stream of words, cut into
blocks of equal words (the last may be shorter). Slots are numbered; the golden-ratio sequence maps slot t to the fractional
part of (t + 1/2) * phi, and the interval of the cumulative weights that holds it names the slot's
source. The k-th slot of a source takes its block k, and starts again after the last block. So the
schedule is even over any stretch of slots, and a source's share differs from its target by a few
blocks of the thousands it has. A document's words that a block holds are taken once for each slot
that takes the block; a slot beyond ``max_epochs`` passes stays empty.

A source may hold most of the rows: its documents are summed up in buckets of the shuffled order, so
no window or group ever holds a whole source (``running_total``).

Defined cases: a null text has size 0, takes nothing and is still reported. Sources go by code
point, a null source last. Sources without words have target 0. Repeated rows are separate
documents. Extra columns are ignored by ``plan`` and kept by ``mix``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, n_words, running_total, words

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
#: Words of a block, unless a source would then have fewer than ``LEAST_BLOCKS`` blocks.
BLOCK_WORDS = 4096
LEAST_BLOCKS = 2048
#: Documents of a source in one bucket of the shuffled order, on average; slots in one bucket.
BUCKET_ROWS = 1024
SLOT_BUCKET = 4096
SEED = 20
#: Fixed value: fractional part of the golden ratio, times 2**32 and rounded to an odd integer.
GOLDEN_32 = 2654435769


def sources_table(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT,
                  max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: rank, size, target, words of a block, blocks, and the bounds of its interval in [0, 1).

    Filling up is exact: sources in order of the size they can take for each unit of weight are full
    as long as the budget left would give them more than that. The windows hold one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    room = (F.col("source_size") * max_epochs).cast("double")
    by_room = Window.orderBy("room_per_weight", "rank")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    later = by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("room", room)
        .withColumn("room_per_weight", F.col("room") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * (budget_percent / 100.0))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("room").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
        .withColumn("full", F.col("room_per_weight") <= F.col("level"))
        .withColumn("open_level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("room")).otherwise(F.col("weight") * F.col("open_level")))
    )
    size = F.col("source_size")
    step = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(size / LEAST_BLOCKS))).cast("long")
    slots = F.when(size > 0, F.col("target") / F.col("step")).otherwise(F.lit(0.0))
    return (
        filled.withColumn("step", step)
        .withColumn("blocks", F.ceil(size / F.col("step")).cast("long"))
        .withColumn("share", slots)
        .withColumn("all_slots", F.sum("share").over(whole))
        .withColumn("high", F.sum("share").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.col("all_slots"))
        .withColumn("low", F.col("high") - F.col("share") / F.col("all_slots"))
        .withColumn("high", F.when(F.col("high") > 1 - 1e-9, F.lit(1.0)).otherwise(F.col("high")))
        .withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int"))
        .select("source", "rank", "source_size", "target", "step", "blocks", "buckets", "low", "high", "all_slots")
    )


def point(slot: Column) -> Column:
    """Golden-ratio point of a slot in [0, 1): an odd multiplier visits every 32-bit fraction once.

    The product modulo 2**32 is put together from the halves of the slot's last 32 bits, so that no slot is too large.
    """
    low, high = slot.bitwiseAND(F.lit(0xFFFF)), F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF))
    product = ((high * GOLDEN_32) % (1 << 16)) * (1 << 16) + low * GOLDEN_32
    return ((product + GOLDEN_32 // 2) % (1 << 32)) / float(1 << 32)


def schedule(spark, sources: DataFrame) -> DataFrame:
    """(slot, rank, k): the source of every slot, and which slot of its source it is, from 0."""
    facts = sources.agg(F.max("all_slots").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    n, cells = int(round(facts["n"] or 0)), 4 * int(facts["sources"]) + 4
    # points meet intervals on the cells of an even grid: an equality join, at most two sources a cell on average
    grid = sources.filter("high > low").select(
        "rank",
        "low",
        "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"),
    )
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("at"))
    slots = slots.withColumn("cell", F.floor(F.col("at") * cells))
    named = slots.join(grid, "cell").filter("at >= low AND at < high").select("slot", "rank", F.floor(F.col("slot") / SLOT_BUCKET).alias("bucket"))
    return running_total(named.withColumn("one", F.lit(1).cast("long")), ["rank"], "bucket", ["slot"], "one", "k").select("slot", "rank", "k")


def block_uses(spark, sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(rank, block, uses): how many slots take each block that is taken at all."""
    taken = schedule(spark, sources).join(sources.select("rank", "blocks"), "rank").filter(F.col("k") < max_epochs * F.col("blocks"))
    return taken.groupBy("rank", (F.col("k") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("uses"))


def stream_places(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with the source's facts and ``place``: words of the shuffled source before the document."""
    facts = sources.withColumnRenamed("source", "_source")
    named = sizes.join(facts, sizes["source"].eqNullSafe(F.col("_source"))).drop("_source")
    order = F.shiftrightunsigned(F.xxhash64("mark", F.lit(SEED)), 1)
    bucket = F.floor(F.col("order") * (F.col("buckets") / float(1 << 63)))
    ordered = named.withColumn("order", order).withColumn("bucket", bucket)
    return running_total(ordered, ["rank"], "bucket", ["order", "doc_id", "size"], "size", "place")


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, mark (hash of the row), place, size, source_size, target, and ``passes``:
    the words that each pass over its source takes of it. Passes take words from the front on."""
    spark = docs.sparkSession
    columns = [F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(key, source, text).alias("mark")]
    sizes = materialise(docs.select(*columns, n_words(F.col(text)).alias("size")), "sizes")
    sources = materialise(sources_table(sizes, max_epochs=max_epochs), "sources")
    placed = stream_places(sizes, sources)
    first, last = F.floor(F.col("place") / F.col("step")), F.floor((F.col("place") + F.col("size") - 1) / F.col("step"))
    # a document without words lies in no block: numbers below zero, spread out, meet none
    nowhere = F.array(-1 - F.pmod(F.xxhash64("mark", "doc_id"), F.lit(SLOT_BUCKET)))
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(nowhere)
    facts = ["rank", "place", "doc_id", "mark", "size", "source_size", "target"]
    pieces = placed.select(*facts, "step", F.explode(blocks).alias("block"))
    ends = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * F.col("step"))
    words_in = ends - F.greatest("place", F.col("block") * F.col("step"))
    used = pieces.join(block_uses(spark, sources, max_epochs), ["rank", "block"], "left").withColumn("in", words_in)
    taken = [F.sum(F.when(F.col("uses") > e, F.col("in")).otherwise(0)) for e in range(max_epochs)]
    # equal rows without words share a place; their number keeps them apart
    whole = used.groupBy(*facts).agg(F.array(*taken).alias("passes"), F.count(F.when(F.col("block") < 0, True)).alias("_empty"))
    copies = F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("_empty"), F.lit(1)).cast("int")))
    return whole.withColumn("_copy", copies).drop("rank", "_empty", "_copy")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken."""
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)
    return shares(docs, key, text, source).select(F.col("doc_id").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of a document.

    A pass that takes a whole document gives its text unchanged; the one document of a source where
    a pass ends gives its first words, joined by blanks.
    """
    given = shares(docs, key, text, source).withColumn("number", F.row_number().over(Window.partitionBy("mark", "doc_id").orderBy("place")))
    given = given.filter(F.exists("passes", lambda x: x > 0)).select(F.col("doc_id").alias("k"), F.col("mark").alias("m"), "number", "size", "passes")
    # the document is one column, so that no name of its own meets those of the mix
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(key).alias("key"), F.xxhash64(key, source, text).alias("mark"))
    packed = packed.withColumn("copy", F.row_number().over(Window.partitionBy("mark", "key").orderBy("mark")))
    on = (F.col("mark") == F.col("m")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("copy") == F.col("number"))
    passes = packed.join(given, on).withColumn("take", F.explode(F.filter("passes", lambda x: x > 0)))
    own = F.col("d").getField(text)
    cut = F.when(F.col("take") < F.col("size"), F.array_join(F.slice(words(own), 1, F.col("take").cast("int")), " ")).otherwise(own)
    return passes.select(F.col("d").withField(text, cut).alias("d")).select("d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
