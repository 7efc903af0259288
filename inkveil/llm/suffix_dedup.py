"""Exact substring dedup: bytes covered by a long string that also starts earlier are removed.

A string of ``LENGTH`` bytes that occurs twice holds the same anchors in both places: the k-grams of
least hash in it (every window of ``LENGTH`` bytes has at least one, and it depends on the window
alone). So only suffixes at anchors, a small share of all, are compared across documents:

1. Each task finds the anchors of its documents, with prefix polynomial hashes: the hash of the
   k-gram and that of its whole context (all bytes that a window with this anchor can have). Anchors
   of equal context meet inside the task first, so that copies of any number leave one row a task.
2. Rows are dealt out by k-gram. Of equal contexts all but the first are removed whole. Contexts
   that share the k-gram and differ elsewhere are left for step 3.
3. Their bytes are fetched. In a group of one k-gram the suffixes that start at the anchors, and the
   reversed prefixes that end there, are sorted by mergesort; two suffixes are compared through the
   hashes of their prefixes: binary search finds the common extension in a logarithmic number of
   steps, the next byte decides, and equal hashes are verified byte by byte. A window that reaches o
   bytes to the left of the anchor then is a pair of ranks: its left and its right class of common
   extension; every window but the first of its class is removed. Groups above ``MAX_GROUP`` never
   come together: their windows are counted as rows by Spark, with sums before the shuffle.

Order: the smaller doc_id, then the earlier start. Strings are judged on the input. Defined cases:
a null text is an empty one; texts below ``LENGTH`` bytes keep all. Rows with equal doc_id stand at
the same place of the order: neither removes the other at the same start, and equal rows give equal
results. A null doc_id comes first. Texts of any length are read whole; extra columns are ignored by
``spans`` and kept by ``remove``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

LENGTH = 100
GRAM = 28
#: K-grams in a window, and the most bytes that a window has to the left of its anchor.
GRAMS = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
#: Contexts of one k-gram that one task may sort.
MAX_GROUP = 20_000
_SLICE = 1 << 20
_FLUSH = 2_000_000
_PAD = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEAST_KEY = -(1 << 63)


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_VALUES = np.frombuffer(hashlib.shake_256(b"byte values").digest(257 * 8), dtype=np.uint64)


class _PowerTables:
    """Powers of the base and of its inverse modulo 2**64, as long as needed."""

    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(int(_BASE), n), _powers(_inverse(int(_BASE)), n)
        return cls.up, cls.down


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Sums of value * base**place before each place; differences are hashes of substrings."""
    up, _ = _PowerTables.of(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[symbols] * up[: len(symbols)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _PowerTables.of(len(prefix))
    h = (prefix[stop] - prefix[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, k-gram hash, context hash) of the anchors of the texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    long_ones = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not long_ones:
        return none
    sizes = np.array([len(texts[i]) for i in long_ones], dtype=np.int64)
    starts = LENGTH + np.cumsum(sizes + LENGTH) - (sizes + LENGTH)  # pads lie before, between and behind
    symbols = np.full(int(starts[-1] + sizes[-1]) + LENGTH, _PAD, dtype=np.int16)
    for i, at in zip(long_ones, starts.tolist(), strict=True):
        symbols[at : at + len(texts[i])] = np.frombuffer(texts[i], dtype=np.uint8)
    prefix = prefix_hashes(symbols)
    place = np.arange(len(symbols) - GRAM + 1)
    gram = substring_hash(prefix, place, place + GRAM) | np.uint64(1)
    least = _sliding(gram, GRAMS, np.minimum)  # of the window at each start
    inside = np.zeros(len(least), dtype=bool)
    edges = np.zeros(len(least) + 1, dtype=np.int8)
    edges[starts] += 1
    edges[starts + sizes - LENGTH + 1] -= 1
    inside = np.cumsum(edges[:-1]).astype(bool)
    least[~inside] = 0
    behind = np.concatenate([np.zeros(GRAMS - 1, np.uint64), least, np.zeros(GRAMS - 1, np.uint64)])
    most = _sliding(behind, GRAMS, np.maximum)[: len(gram)]  # over the windows that hold each k-gram
    at = np.flatnonzero(most == gram)
    which = np.searchsorted(starts, at, side="right") - 1
    context = substring_hash(prefix, at - REACH, at + LENGTH)
    return np.array(long_ones, dtype=np.int64)[which], at - starts[which], gram[at], context


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _SLICE):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def _merge(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document joined where they touch or overlap."""
    order = np.lexsort([start, mark, doc])
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    if not len(doc):
        return doc, mark, start, end
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # never over the edge of a document
    first = new.copy()
    first[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return doc[at], mark[at], start[at], np.maximum.reduceat(end, at)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc: the order key; mark: 32 bits of the text, which tell rows of one doc_id apart."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LEAST_KEY)).alias("doc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).alias("mark"),
        F.col(text).alias("text"),
    )


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Step 1. Anchors: gram, context, doc, at = (place, mark). Copies met in the task: spans, as
    gram = any number, context = end of the span, at = -1 - (start, mark)."""

    def rows(held: list[tuple]) -> Iterator[pd.DataFrame]:
        doc, mark, place, size, gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort([place, doc, context, gram])
        same = np.zeros(len(order), dtype=bool)
        g, c, d, p = gram[order], context[order], doc[order], place[order]
        same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        later = (d != d[head]) | (p != p[head])
        keep, drop = order[~later], order[later]
        yield pd.DataFrame({"gram": gram[keep].view(np.int64), "context": context[keep].view(np.int64), "doc": doc[keep], "at": (place[keep] << 32) | mark[keep]})
        spans = _merge(doc[drop], mark[drop], np.maximum(place[drop] - REACH, 0), np.minimum(place[drop] + LENGTH, size[drop]))
        route = (spans[0] * 0x9E3779B1 + spans[2]) ^ spans[1]
        yield pd.DataFrame({"gram": route, "context": spans[3], "doc": spans[0], "at": -1 - ((spans[2] << 32) | spans[1])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            doc, mark = batch["doc"].to_numpy(np.int64), batch["mark"].to_numpy(np.int64)
            texts = [_raw(t) for t in batch["text"]]
            for start, stop in _slices(texts):
                which, place, gram, context = anchors(texts[start:stop])
                sizes = np.array([len(t) for t in texts[start:stop]], dtype=np.int64)
                held.append((doc[start:stop][which], mark[start:stop][which], place, sizes[which], gram, context))
                n += len(which)
            if n > _FLUSH:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    return docs.mapInPandas(run, "gram long, context long, doc long, at long")


def sift(found: DataFrame) -> DataFrame:
    """Step 2. kind 0: a span to remove (place, until); kind 1: an anchor to remove with its whole
    context; kind 2: an anchor whose context is the first of its kind, among others of its k-gram."""

    def complete(batch: pd.DataFrame) -> pd.DataFrame:
        g, c = batch["gram"].to_numpy(), batch["context"].to_numpy()
        d, at, sent = batch["doc"].to_numpy(), batch["at"].to_numpy(), batch["sent"].to_numpy(bool)
        new_gram = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (d != d[head]) | (at >> 32 != at[head] >> 32)
        number = np.cumsum(new_gram) - 1
        contexts = np.bincount(number, weights=new).astype(np.int64)[number]
        kind = np.where(later, 1, np.where((contexts > 1) & ~sent, 2, -1)).astype(np.int8)
        return batch.assign(kind=kind, contexts=contexts)

    def out(doc, at, kind, gram, until) -> pd.DataFrame:
        place, mark = at >> 32, at & 0xFFFFFFFF
        return pd.DataFrame({"doc": doc, "mark": mark, "place": place, "until": until, "kind": kind, "gram": gram})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            spans = batch[batch["at"] < 0]
            if len(spans):
                yield out(spans["doc"].to_numpy(), -1 - spans["at"].to_numpy(), np.int8(0), 0, spans["context"].to_numpy())
            batch = batch[batch["at"] >= 0].assign(sent=False)
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            judged = complete(batch)
            last = judged["gram"].to_numpy() == judged["gram"].iloc[-1]
            # the last k-gram may go on: its anchors stay behind, one for each context, as already told or not
            tell = judged[judged["kind"] >= 1]
            if len(tell):
                yield out(tell["doc"].to_numpy(), tell["at"].to_numpy(), tell["kind"].to_numpy(), tell["gram"].to_numpy(), 0)
            stay = judged[last & (judged["kind"].to_numpy() != 1)]
            rest = stay.assign(sent=stay["sent"] | (stay["kind"] == 2))[["gram", "context", "doc", "at", "sent"]]

    dealt = found.repartition("gram").sortWithinPartitions("gram", "context", "doc", "at")
    return dealt.mapInPandas(run, "doc long, mark long, place long, until long, kind byte, gram long")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Step 3. gram, doc, mark, place, left (bytes before the anchor there are) and the bytes around it."""
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("place", "gram")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, mark, text, places in batch.itertuples(index=False):
                raw = _raw(text)
                for x in places:
                    p = x["place"]
                    left = min(p, REACH)
                    out.append((x["gram"], doc, mark, p, left, raw[p - left : p + LENGTH]))
            yield pd.DataFrame(out, columns=["gram", "doc", "mark", "place", "left", "bytes"])

    joined = docs.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "wanted")
    return joined.mapInPandas(run, "gram long, doc long, mark long, place long, left int, bytes binary")


class SuffixOrder:
    """Sorts suffixes of equal groups by mergesort, comparing through hashes of their prefixes."""

    def __init__(self, group: np.ndarray, symbols: np.ndarray):
        self.group, self.symbols = group, symbols
        n, self.width = symbols.shape
        up, _ = _PowerTables.of(self.width + 1)
        self.prefix = np.zeros((n, self.width + 1), dtype=np.uint64)
        np.cumsum(_VALUES[symbols] * up[: self.width], axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, verified byte by byte."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            equal = self.prefix[a, mid] == self.prefix[b, mid]
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
        for k in range(0, len(a), 1 << 14):  # verification: hashes may agree by chance
            part = slice(k, k + (1 << 14))
            differ = self.symbols[a[part]] != self.symbols[b[part]]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
            lo[part] = np.minimum(lo[part], first)
        return lo

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b (ties: the smaller number)."""
        n = self.common(a, b)
        at = np.minimum(n, self.width - 1)
        x, y = self.symbols[a, at], self.symbols[b, at]
        return np.where(n == self.width, a < b, x < y)

    def sort(self) -> np.ndarray:
        """Suffix numbers in order of group and suffix; all pairs of runs of a round are merged at once."""
        n = len(self.group)
        order = np.argsort(self.group, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], self.group[order][1:] != self.group[order][:-1]]))
        base = np.repeat(starts, np.diff(np.append(starts, n)))  # where each one's group begins
        stop = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        place, width, longest = np.arange(n), 1, int((stop - base).max()) if n else 0
        while width < longest:
            run = (place - base) // width
            own = base + run * width
            other = np.where(run % 2 == 0, own + width, own - width)
            lo, hi = np.minimum(other, stop), np.minimum(other + width, stop)
            first = lo.copy()
            while True:  # place among the other run, by binary search
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                less = self.before(order[mid], order[open_])
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            target = np.minimum(own, other) + (place - own) + (lo - first)
            merged = np.empty_like(order)
            merged[np.where(first < stop, target, place)] = order
            order, width = merged, width * 2
        return order

    def extensions(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each suffix in the order with the one before it, -1 at a group's first."""
        out = np.full(len(order), -1, dtype=np.int64)
        same = np.flatnonzero(self.group[order][1:] == self.group[order][:-1]) + 1
        out[same] = self.common(order[same - 1], order[same])
        return out


def repeated_windows(group: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """(contexts, o): the contexts whose window from o bytes before the anchor occurs earlier in their group."""
    n = len(group)
    right = np.full((n, LENGTH), _PAD, dtype=np.int16)
    before = np.full((n, REACH), _PAD, dtype=np.int16)
    size = np.zeros(n, dtype=np.int64)
    for i, (cut, raw) in enumerate(zip(left.tolist(), texts, strict=True)):
        own = np.frombuffer(raw, dtype=np.uint8)
        size[i] = len(own) - cut
        right[i, : size[i]] = own[cut:]
        before[i, :cut] = own[:cut][::-1]
    ranks = []
    for side in (right, before):
        sorter = SuffixOrder(group, side)
        order = sorter.sort()
        ranks.append((order, sorter.extensions(order)))
    by_place = np.lexsort([place, doc])
    rank = np.empty(n, np.int64)
    rank[by_place] = np.cumsum(np.concatenate([[0], (doc[by_place][1:] != doc[by_place][:-1]) | (place[by_place][1:] != place[by_place][:-1])])) if n else 0
    for o in range(REACH + 1):
        fits = np.flatnonzero((left >= o) & (size >= LENGTH - o))
        if len(fits) < 2:
            continue
        classes = []
        for (order, common), need in zip(ranks, (LENGTH - o, o), strict=True):
            ids = np.empty(n, np.int64)
            ids[order] = np.cumsum(common < need)
            classes.append(ids[fits])
        pair = classes[0] * (n + 1) + classes[1]
        codes, where = np.unique(pair, return_inverse=True)
        if len(codes) == len(fits):
            continue
        first = np.full(len(codes), np.iinfo(np.int64).max)
        np.minimum.at(first, where, rank[fits])
        hit = fits[rank[fits] > first[where]]
        if len(hit):
            yield hit, o


def windows_in_groups(found: DataFrame) -> DataFrame:
    """Spans to remove: doc, mark, place, until; groups of one k-gram are sorted inside tasks."""

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        doc, mark, place = (batch[c].to_numpy(np.int64) for c in ("doc", "mark", "place"))
        group = np.cumsum(np.concatenate([[0], batch["gram"].to_numpy()[1:] != batch["gram"].to_numpy()[:-1]]))
        parts = [(hit, o) for hit, o in repeated_windows(group, doc, place, batch["left"].to_numpy(np.int64), batch["bytes"].tolist())]
        hits = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.int64)
        begins = np.concatenate([place[h] - o for h, o in parts]) if parts else np.zeros(0, np.int64)
        spans = _merge(doc[hits], mark[hits], begins, begins + LENGTH)
        return pd.DataFrame(dict(zip(("doc", "mark", "place", "until"), spans, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            edges = np.flatnonzero(batch["gram"].to_numpy()[1:] != batch["gram"].to_numpy()[:-1]) + 1
            at = 0
            while len(edges) and edges[-1] > at:  # complete groups, some thousands of rows at a time
                k = max(int(np.searchsorted(edges, at + 4096, side="right")) - 1, int(np.searchsorted(edges, at, side="right")))
                stop = int(edges[min(k, len(edges) - 1)])
                yield solve(batch.iloc[at:stop])
                at = stop
            rest = batch.iloc[at:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield solve(rest)

    dealt = found.repartition("gram").sortWithinPartitions("gram", "doc", "place")
    return dealt.mapInPandas(run, "doc long, mark long, place long, until long")


def windows_as_rows(found: DataFrame) -> DataFrame:
    """The same for groups of any size: each window is a row, first places are minima."""
    offsets = F.sequence(F.greatest(F.lit(0), F.lit(LENGTH) - (F.octet_length("bytes") - F.col("left"))), F.col("left"))
    rows = found.filter(F.octet_length("bytes") >= LENGTH).select("gram", "doc", "mark", "place", "left", "bytes", F.explode(offsets).alias("o"))
    window = F.substring(F.col("bytes"), F.col("left") - F.col("o") + 1, F.lit(LENGTH))
    rows = rows.select("gram", "doc", "mark", "place", "o", F.sha2(window, 256).alias("window"))
    first = rows.groupBy("gram", "o", "window").agg(F.min(F.struct("doc", "place")).alias("first"))
    later = rows.join(first, ["gram", "o", "window"]).filter((F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("place") > F.col("first.place"))))
    begin = F.col("place") - F.col("o")
    return later.select("doc", "mark", begin.alias("place"), (begin + LENGTH).alias("until"))


def spans_to_remove(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """doc, mark and ``spans``: array of (place, until) that cover what is removed, in any order."""
    sifted = materialise(sift(anchor_rows(docs)), "sifted")
    whole = sifted.filter("kind < 2").select(
        "doc",
        "mark",
        F.when(F.col("kind") == 0, F.col("place")).otherwise(F.greatest(F.col("place") - REACH, F.lit(0))).alias("place"),
        F.when(F.col("kind") == 0, F.col("until")).otherwise(F.col("place") + LENGTH).alias("until"),
    )
    around = materialise(contexts(docs, sifted.filter("kind = 2").select("doc", "mark", "place", "gram")), "contexts")
    sizes = around.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > max_group).select("gram")
    parts = whole.unionByName(windows_in_groups(around.join(large, "gram", "left_anti")))
    parts = parts.unionByName(windows_as_rows(around.join(large, "gram", "left_semi")))
    return parts.groupBy("doc", "mark").agg(F.collect_set(F.struct("place", "until")).alias("spans"))


def _cover(raw: bytes, spans) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs."""
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    if spans is not None and len(spans):
        place = np.array([s["place"] for s in spans], dtype=np.int64)
        until = np.minimum(np.array([s["until"] for s in spans], dtype=np.int64), len(raw))
        np.add.at(edge, place, 1)
        np.add.at(edge, until, -1)
    covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).view(np.int8), [0]])
    change = np.diff(covered)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs (starts, ends)."""
    named = _identified(docs, key, text)
    removed = spans_to_remove(named, max_group)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text_, spans_ in batch.itertuples(index=False):
                raw = _raw(text_)
                starts, ends = _cover(raw, spans_)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((None if doc == _LEAST_KEY else doc, len(raw), int((ends - starts).sum()), len(starts), kept.hexdigest(), starts, ends))
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(**{key: frame[key].astype("Int64")})

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return named.join(removed, ["doc", "mark"], "left").select("doc", "text", "spans").mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "ends")
