"""SimHash near-duplicates: fingerprints, a binary-trie self-join and connected components.

Fingerprints are 64 majority votes over the hashes of a text's word shingles. Equal fingerprints are
merged first, so a group of copies of any size is one trie leaf. Two fingerprints within ``budget``
differing bits agree fully on one of ``budget + 1`` blocks of bits; hence the join looks at one trie
for each block, with that block turned to the front. Within a trie, pairs of nodes are traversed
together from the top: the differing bits on the way down are added up, and a pair of nodes is
dropped when they exceed the error budget (zero inside the leading block). Subtrees below the leading
block are independent, and are dealt out to tasks; a subtree with more than ``MAX_LEAVES`` leaves is
cut into parts, and every pair of parts is a task of its own, so no task holds a large group.

A task returns a spanning forest of the links it found rather than all links: components are the
same, and a group of n near copies gives n - 1 rows and not n * n.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other. A
text of one or two words is one shingle. Repeated rows share a fingerprint; with a repeated doc_id
each row is reported. A null doc_id is reported and never names a component unless all its members
are null. Extra columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise

SHINGLE, BUDGET, SEED = 3, 3, 42
#: Leaves of a subtree that one task may hold; larger subtrees are cut into parts.
MAX_LEAVES = 4096
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_VOTES = 4096


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, ASCII letters in lower case."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < size:
        return xxh64(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _VOTES):  # bits of a bounded number of shingles at a time
        octets = hashes[k : k + _VOTES].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["_text"]], dtype=np.uint64)
            yield pd.DataFrame({key: batch[key], "fp": found.view(np.int64)})

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_join(left: np.ndarray, right: np.ndarray, budget: int, same: np.ndarray, top: np.ndarray) -> Iterator[np.ndarray]:
    """Leaf pairs (i, j) within ``budget`` differing bits, from sorted leaves.

    ``top``: rows (left from, left to, right from, right to) of node pairs to start at; ``same``
    tells the starts that pair a node with itself. All node pairs of a level go down together.
    """
    nodes = np.column_stack([top, np.zeros(len(top), np.int64), same.astype(np.int64)])
    depth = 0
    while len(nodes):
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (sizes <= 64) | (depth == 64)
        if small.any():
            yield from _leaf_pairs(left, right, nodes[small], sizes[small], budget)
            nodes = nodes[~small]
        if not len(nodes):
            break
        bit = np.uint64(1) << np.uint64(63 - depth)
        l_mid, r_mid = _split(left, nodes[:, 0], nodes[:, 1], bit), _split(right, nodes[:, 2], nodes[:, 3], bit)
        l0, l1, r0, r1, cost, twin = nodes.T
        children = [
            np.column_stack([l0, l_mid, r0, r_mid, cost, twin]),
            np.column_stack([l_mid, l1, r_mid, r1, cost, twin]),
            np.column_stack([l0, l_mid, r_mid, r1, cost + 1, np.zeros_like(twin)]),
            np.column_stack([l_mid, l1, r0, r_mid, cost + 1, np.zeros_like(twin)])[twin == 0],
        ]
        nodes = np.concatenate(children)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= budget)]
        depth += 1


def _split(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each range of sorted leaves that agree above ``bit``: the first with that bit set."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        one = (leaves[np.minimum(mid, len(leaves) - 1)] & bit != 0) & (lo < hi)
        open_ = lo < hi
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaf_pairs(left, right, nodes, sizes, budget) -> Iterator[np.ndarray]:
    step = 1 << 18
    ends = np.cumsum(sizes)
    start = 0
    while start < len(nodes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step)))
        part, n = nodes[start:stop], sizes[start:stop]
        which = np.repeat(np.arange(len(part)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[which]
        i, j = part[which, 0] + k // width, part[which, 2] + k % width
        keep = (popcount(left[i] ^ right[j]) <= budget) & ((part[which, 5] == 0) | (i < j))
        yield np.column_stack([i[keep], j[keep]])
        start = stop


def forest(n: int, pairs: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest node."""
    root = np.arange(n)
    for part in pairs:
        a, b = part[:, 0], part[:, 1]
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def links(distinct: DataFrame, budget: int = BUDGET, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(a, b): links between the fingerprints of the column fp that keep every component together."""
    blocks = budget + 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]

    def turned(k: int):
        """The fingerprint with block k in front."""
        if edges[k] == 0:
            return F.col("fp")
        return F.shiftleft("fp", edges[k]).bitwiseOR(F.shiftrightunsigned("fp", 64 - edges[k]))

    tries = F.array(*[F.struct(F.lit(k).alias("trie"), turned(k).alias("leaf")) for k in range(blocks)])
    width = min(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
    leaves = (
        distinct.select(F.explode(tries).alias("t"))
        .select("t.trie", "t.leaf")
        .withColumn("subtree", F.shiftrightunsigned("leaf", 64 - width))
    )
    sizes = leaves.groupBy("trie", "subtree").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parted = leaves.join(sizes, ["trie", "subtree"]).withColumn("parts", F.ceil(F.col("n") / max_leaves).cast("int"))
    own = F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int")
    # a leaf of part p belongs to the tasks (p, q) for every part q, on the side of the smaller number
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct(F.least(F.col("own"), q).alias("i"), F.greatest(F.col("own"), q).alias("j")),
    )
    dealt = (
        parted.withColumn("own", own)
        .withColumn("task", F.explode(tasks))
        .select("trie", "subtree", F.col("task.i").alias("i"), F.col("task.j").alias("j"), (F.col("own") != F.col("task.i")).alias("second"), "leaf")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[["trie", "subtree", "i", "j"]].to_numpy(np.int64)
            last = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            stop = int(last[-1]) + 1 if len(last) else 0
            rest = batch.iloc[stop:]
            if stop:
                yield _join_tasks(batch.iloc[:stop], edges, budget)
        if rest is not None and len(rest):
            yield _join_tasks(rest, edges, budget)

    spread = dealt.repartition("trie", "subtree", "i", "j").sortWithinPartitions("trie", "subtree", "i", "j", "second")
    return spread.mapInPandas(run, "a long, b long").distinct()


def _join_tasks(batch: pd.DataFrame, edges: list[int], budget: int) -> pd.DataFrame:
    """Links of complete tasks, whose rows lie together."""
    key = batch[["trie", "subtree", "i", "j"]].to_numpy(np.int64)
    leaf, second = batch["leaf"].to_numpy(np.int64).view(np.uint64), batch["second"].to_numpy(bool)
    starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
    number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort([leaf, second, number])
    leaf, second = leaf[order], second[order]
    firsts = np.add.reduceat((~second).astype(np.int64), starts[:-1]) + starts[:-1]
    alone = key[starts[:-1], 2] == key[starts[:-1], 3]
    top = np.column_stack([starts[:-1], firsts, np.where(alone, starts[:-1], firsts), np.where(alone, firsts, starts[1:])])
    pairs = trie_join(leaf, leaf, budget, alone, top)
    a, b = forest(len(leaf), pairs)
    shift = np.array(edges, dtype=np.uint64)[key[order, 0]]  # rows keep their trie in any order within a task
    plain = np.where(shift == 0, leaf, (leaf >> shift) | (leaf << ((np.uint64(64) - shift) % np.uint64(64))))
    return pd.DataFrame({"a": plain[a].view(np.int64), "b": plain[b].view(np.int64)})


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits) and component_id (smallest key of its component)."""
    found = materialise(fingerprints(docs, key, text, size), "fingerprints")
    distinct = materialise(found.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = connected_components(links(distinct, budget))
    # names of the components: fingerprints without a link keep their own smallest key
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(of_print, "fp").select(key, digits.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest key, with the same columns."""
    found = classes(docs, key, text, size, budget)

    def marked(df: DataFrame) -> DataFrame:  # plain keys, so that the join and what follows share one shuffle
        return df.withColumn("_null", F.col(key).isNull()).withColumn("_key", F.coalesce(F.col(key), F.lit(0)))

    keepers = marked(found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(key)).select("_key", "_null").distinct()
    # rows that share the kept key are one document; any one of them stays
    return marked(docs).join(keepers, ["_key", "_null"]).dropDuplicates(["_key", "_null"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
