"""Connected components of a graph whose edges are a DataFrame: distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, materialise

#: Edges of a node that may always meet in one task.
FEW = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Alternates hooking every node to the smallest neighbour of its tree (large star) with joining
    the trees of a node's smaller neighbours (small star) until nothing changes; the number of
    rounds grows with the logarithm of the component size. Rounds only group by a node with a
    minimum, which is summed up before the shuffle, and join on the node; the minima of nodes with very
    many edges are broadcast (``join_counted``), so no task gets all edges of one, and no list of
    neighbours is ever collected. Each step is written to the shared folder, so that lost executors
    cost one step at most.

    Loops and repeated edges are allowed, null ends are ignored; no edges give no rows.
    """
    current = materialise(_forward(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = _signature(current)
    while True:
        current = _small_star(*_large_star(current, before[0]))
        # a round that changes no row has reached stars; sums of row hashes tell it without a join
        after = _signature(current)
        if before == after:
            break
        before = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


def _forward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself). With a bound of the rows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    tied = join_counted(both.filter("v > u"), materialise(least, "least"), "u", total=2 * n, least=FEW)
    return materialise(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges"), n


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    joined = join_counted(edges, least, "u", total=n, least=FEW).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialise(joined.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
