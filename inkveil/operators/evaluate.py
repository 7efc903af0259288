"""Measuring redaction: outcomes against gold values, ratchets, overlaps, residues, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import still_present
from . import bloom
from .engine import mask
from .tables import dealt, written


def outcome(value: Column, redacted: Column, suspects: Column) -> Column:
    """redacted: the value is gone; flagged: it is there and its mask is among the suspects; lost: neither."""
    flagged = F.array_contains(F.transform(suspects, lambda s: s.sample), mask(value))
    return F.when(~F.contains(redacted, value), "redacted").when(F.coalesce(flagged, F.lit(False)), "flagged").otherwise("lost")


def loose_outcome(value: Column, redacted: Column, suspects: Column) -> Column:
    """As ``outcome``, but any suspect counts."""
    return F.when(~F.contains(redacted, value), "redacted").when(F.size(suspects) > 0, "flagged").otherwise("lost")


def recall(gold: DataFrame, results: DataFrame, key: str = "doc_id", category: str = "category", value: str = "value",
           redacted: str = "redacted", report: str = "report") -> DataFrame:
    """Outcomes by category."""
    joined = gold.join(results.select(key, redacted, report), key)
    judged = joined.withColumn("outcome", outcome(F.col(value), F.col(redacted), F.col(f"{report}.suspects")))
    return judged.groupBy(category).pivot("outcome", ["redacted", "flagged", "lost"]).count().na.fill(0)


def ratchet(frozen: DataFrame, now: DataFrame, forms: str = "forms", grows: str = "prose") -> DataFrame:
    """Counts (grp, category, n) before and now: forms may not grow, prose may not shrink."""
    a, b = frozen.withColumnRenamed("n", "before"), now.withColumnRenamed("n", "now")
    both = a.join(b, ["grp", "category"], "full_outer").na.fill(0, ["before", "now"])
    bad = ((F.col("grp") == forms) & (F.col("now") > F.col("before"))) | ((F.col("grp") == grows) & (F.col("now") < F.col("before")))
    return both.withColumn("broken", bad)


def overlaps(wide: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct candidates (key, start, end) and whether any removed span of the document overlaps them.

    A candidate is overlapped if, of all spans that begin before it ends, the one that reaches farthest goes beyond its start. So
    both tables are put in one order for each document and the farthest end is carried along; no pairs are made. A null key is a key. The rows
    are counted first, for the number of tasks.
    """
    one = wide.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("end").alias("at"), F.lit(None).cast("long").alias("reach"), F.lit(0).alias("what"))
    two = removed.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("start").alias("at"), F.col("end").cast("long").alias("reach"), F.lit(1).alias("what"))
    # where a span begins just as a candidate ends, the candidate comes first
    before = Window.partitionBy("k").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, -1)
    both = dealt(one.unionByName(two), wide.count() + removed.count(), "k")
    seen = both.withColumn("far", F.max("reach").over(before)).filter("what = 0")
    caught = F.max(F.coalesce(F.col("far") > F.col("s"), F.lit(False))).alias("caught")
    return seen.groupBy(F.col("k").alias(key), F.col("s").alias("start"), F.col("e").alias("end")).agg(caught)


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one run that the other lacks, as newly caught or no longer caught."""
    new = after.join(before, keys, "left_anti").select(*keys, F.lit("new").alias("change"))
    gone = before.join(after, keys, "left_anti").select(*keys, F.lit("gone").alias("change"))
    return new.unionByName(gone)


def residue(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value", text: str = "text") -> DataFrame:
    """Values of ``before`` that are still in the text of ``after``."""
    return before.join(after, keys).withColumn("present", still_present(F.col(text), F.col(value)))


def substitute(key: Column, pool: list[str]) -> Column:
    """An element of the pool by the first eight bytes of the key's SHA-256."""
    number = F.conv(F.left(F.sha2(key, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.element_at(F.array(*[F.lit(p) for p in pool]), ((number % len(pool)).cast("int") + 1))


def fingerprint(names: DataFrame, name: str = "name") -> DataFrame:
    """16 hex digits over the sorted names of a corpus."""
    listed = F.array_join(F.array_sort(F.collect_list(name)), "\n")
    return names.agg(F.left(F.sha2(listed, 256), F.lit(16)).alias("fingerprint"), F.count(F.lit(1)).alias("names"))


def insert_in_middle(text: Column, fragment: Column) -> Column:
    """The text with a fragment behind the first blank after its middle."""
    half = F.floor(F.length(text) / 2).cast("int")
    at = half + F.instr(F.substr(text, half + 1), " ")
    return F.concat(F.left(text, at), fragment, F.lit(" "), F.substr(text, at + 1))


def first_examples(rows: DataFrame, by: list[str], example: str, k: int = 5) -> DataFrame:
    """The first ``k`` distinct examples of each group, in their own order, with how many there are; null examples do not count.

    The limit is applied before the shuffle, so a group with most of the rows costs ``k`` rows a task.
    """
    distinct = rows.filter(F.col(example).isNotNull()).select(*by, example).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(example))
    first = distinct.withColumn("_place", place).filter(F.col("_place") <= k)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", example))).alias("_x")).withColumn("examples", F.col(f"_x.{example}")).drop("_x")
    counts = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(by)], "n")
    # a null group is a group
    on = [F.col(b).eqNullSafe(F.col(f"_{i}")) for i, b in enumerate(by)]
    return listed.join(counts, on).select(*by, "n", "examples")


def unknown_names(values: DataFrame, known: DataFrame, value: str = "value", entry: str = "entry", filtered: bool = True) -> DataFrame:
    """The distinct values of two or three words none of which is known: column ``value``. Blanks between words become one.

    A word counts if it has three letters or more, case ignored. A Bloom filter of the known words settles inside the scan's projection nearly
    all values that are unknown; only the others meet the table of known words in a join. ``filtered=False`` leaves the filter out;
    the rows are the same.
    """
    plain = F.btrim(F.regexp_replace(value, r"\s+", " "))
    words = F.filter(F.split(F.lower(plain), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    rows = values.select(plain.alias("value"), words.alias("_words")).filter(F.size(F.split("value", " ")).between(2, 3)).distinct()
    entries = written(known.select(F.lower(entry).alias("_word")).filter("_word IS NOT NULL").distinct(), "known")
    if filtered:
        bits = bloom.filter_bits(entries.count())
        # written, as two branches read it
        rows = written(_opened(rows, bloom.bloom_filter(entries, "_word", bits), bits), "names")
        sure, rows = rows.filter("NOT _open").select("value"), rows.filter("_open")
    met = rows.select("value", F.explode("_words").alias("_word")).join(entries, "_word").select("value")
    rest = rows.select("value").join(met, "value", "left_anti")
    return sure.unionByName(rest) if filtered else rest


def _opened(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``_open``: whether a word may be known."""
    with_maps = rows.withColumn("_maps", maps.scalar())
    return with_maps.withColumn("_open", F.exists("_words", lambda w: bloom.may_contain(F.col("_maps"), w, bits))).drop("_maps")
