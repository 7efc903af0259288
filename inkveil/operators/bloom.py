"""A Bloom filter as a column expression: built by an aggregation, tested inside the scan's projection, no user function anywhere.

Bits are kept in bitmaps of 32,768 bits (Spark's ``bitmap`` functions). The filter is a scalar subquery: it is computed once and travels with
the plan. Its size is chosen from the number of values and never above ``MOST_BITS``, so what is sent has a known bound; beyond it the filter lets more
values through and stays right, as it never refuses a value that was put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_VALUE = 12
HASHES = 4
BUCKET = 32_768
#: 8 MB.
MOST_BITS = 1 << 26


def filter_bits(n: int) -> int:
    """Bits for n values: a power of two, at least one bitmap."""
    bits = BUCKET
    while bits < min(n * BITS_PER_VALUE, MOST_BITS):
        bits *= 2
    return bits


def _positions(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits)) for seed in range(HASHES)]


def bloom_filter(values: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with ``bitmaps``: an array with the bitmap of each bucket, null where a bucket has no bit."""
    at = values.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_positions(F.col(column), bits))).alias("at"))
    own = at.groupBy(F.floor(F.col("at") / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BUCKET).alias("bitmap"))
    # a row for each bucket: a few thousand at most
    listed = own.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("own"))
    return listed.select(F.transform(F.sequence(F.lit(0), F.lit(bits // BUCKET - 1)), lambda i: F.element_at("own", i)).alias("bitmaps"))


def may_contain(bitmaps: Column, value: Column, bits: int) -> Column:
    """False only if the value was not put in."""

    def has(at: Column) -> Column:
        bitmap = F.get(bitmaps, F.floor(at / BUCKET).cast("int"))
        byte = F.conv(F.hex(F.substring(bitmap, (F.floor((at % BUCKET) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))

    tests = [has(at) for at in _positions(value, bits)]
    found = tests[0]
    for t in tests[1:]:
        found = found & t
    return found
