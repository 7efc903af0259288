"""Line dedup: near-equal lines of a corpus, by MinHash, exact verification and union-find.

Lines are compared in lower case with single blanks. A line's shingles are its strings of ``SHINGLE``
characters, or of ``SHORT_SHINGLE`` where both lines have fewer than ``SHORT`` (a line that is shorter than
that is one shingle). Two lines are linked when the Jaccard similarity of their shingle sets is
``THRESHOLD`` or more; so one inner letter or digit may differ from 29 characters on, two side by side
from 38 on. Lines of one component are one line, which stays where it comes first (smaller doc_id, then
earlier line).

1. Documents are split once; lines that a task meets for the first time keep their text.
2. Each such line gets 16 keys, each of 4 minima of its shingles' hashes: a pair at the threshold shares
   one with probability 1 - (1 - 0.8**4)**16 = 0.9998. Short lines, of which unrelated ones have many short
   shingles in common, get 48 keys of 8 minima besides: 1 - (1 - 0.8**8)**48 = 0.9999. Keys and line numbers
   travel in packed cells of a range of keys.
3. The lines of a key form a bucket; equal buckets count once. Buckets are compared exactly, as sets: a line
   is compared with the components found so far, until one of each takes it; buckets that share lines are mostly
   compared in one task, where no pair is compared twice. A bucket of more than
   ``MAX_PART`` lines is cut: all its lines are compared with one of them in parts, and only those that are
   not like it meet the whole bucket, part by part. Nothing is left out, and a task ties each line to one of
   its component. Distributed union-find joins these ties.

Defined cases: null and empty texts have no lines; blank lines are kept and never compared. Equal
lines are linked however short. Texts and lines of any length are read whole. Rows that share a
doc_id are documents of their own (in an order of their texts), also equal rows: the lines of the second
are duplicates of the first. A null doc_id comes first; ids of any type that sorts are allowed. Extra columns
are ignored by ``line_report`` and kept by ``remove``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import join_counted, materialise

SHINGLE, THRESHOLD = 8, 0.8
#: Lines of fewer characters than SHORT are compared by shorter shingles with each other.
SHORT, SHORT_SHINGLE = 100, 3
#: Keys of a line and minima of a key, by the size of the shingles.
BANDS = {SHINGLE: (16, 4), SHORT_SHINGLE: (48, 8)}
MAX_PART = 1000
#: Lines that a task remembers; characters and keys that it handles at once; rows of a cell before it is drained.
_MEMORY = 1 << 20
_BLOCK = 1 << 17
_FLUSH = 1 << 20
_CELL_ROWS = 1 << 22
#: A group of more lines is compared by an index of its shingles, or by several of fewer characters.
_MANY, _INDEXED = 24, 1 << 21
#: Lines, each once for each bucket, whose buckets may be compared in one task; sets and counted shingles that it holds.
_TOGETHER = 1 << 16
_SETS, _NUMBERS = 4096, 1 << 20


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


_ODD = (np.random.default_rng(6).integers(1 << 31, size=512, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)


def _shingle_hashes(codes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of lines of code points, one line after another, and how many each line has."""
    spans = np.maximum(lengths, size)
    if (lengths < size).any():  # such a line is one shingle, filled up with zeros
        padded = np.zeros(int(spans.sum()), dtype=np.uint32)
        padded[np.arange(len(codes)) + np.repeat(np.cumsum(spans - lengths) - (spans - lengths), lengths)] = codes
        codes = padded
    part = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
    part ^= part >> np.uint32(15)
    h, n, width = None, 0, 1  # the hash of a string from those of its two parts, whose lengths are powers of two
    while True:
        if size & width:
            if h is None:
                h = part
            else:
                own = h[: len(h) - width] * _STEP
                own ^= own >> np.uint32(13)
                own += part[n : n + len(own)]
                h = own
            n += width
        if n == size:
            break
        wider = part[:-width] * _STEP
        wider ^= wider >> np.uint32(13)
        wider += part[width:]
        part, width = wider, width * 2
    h = h * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    inside = np.ones(len(h), dtype=bool)
    ends = np.cumsum(spans)[:-1]
    for k in range(1, size):  # strings that run over the end of a line
        inside[ends - k] = False
    return h[inside], spans - size + 1


def band_keys(codes: np.ndarray, lengths: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The keys of each (normal, not empty) line; equal shingle sets give equal keys."""
    n_bands, n_rows = BANDS[size]
    keys = np.zeros((len(lengths), n_bands), dtype=np.uint64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _BLOCK, side="right")))
        hashes, counts = _shingle_hashes(codes[done : int(ends[last - 1])], lengths[first:last], size)
        starts = np.cumsum(counts) - counts
        mixed = np.empty_like(hashes)
        for band in range(n_bands):
            key = np.full(last - first, band + 1 + 1000 * size, dtype=np.uint64)
            for k in range(band * n_rows, (band + 1) * n_rows):
                np.multiply(hashes, _ODD[k], out=mixed)
                key = (key ^ np.minimum.reduceat(mixed, starts)) * _MIX
                key ^= key >> np.uint64(31)
            keys[first:last, band] = (key * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        first = last
    return keys


def split_lines(docs: DataFrame, key: str, text: str, keep: Column | None = None) -> DataFrame:
    """(row, doc, mark, numbers, names, ids, own) of each row, written once: places, names and ids of the lines that are
    not blank, and the text of those that the task has not met before. With ``keep``, a column d of that value."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            offsets, numbers, names, own = [0], [], [], []
            for value in batch.column("_text").to_pylist():
                for number, line in enumerate(value.split("\n") if value else ()):
                    line = normal(line)
                    if line:
                        h = xxh3_128_digest(line.encode())
                        numbers.append(number)
                        names.append(h)
                        own.append(None if h in met else line)
                        met.add(h)
                offsets.append(len(numbers))
            if len(met) > _MEMORY:
                met.clear()
            at = pa.array(offsets, pa.int32())
            ids = np.frombuffer(b"".join(names), dtype=np.int64)[::2]
            columns = (pa.array(numbers, pa.int32()), pa.array(names, pa.binary()), pa.array(ids), pa.array(own, pa.string()))
            lists = [pa.ListArray.from_arrays(at, x) for x in columns]
            given = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *lists], [*given, "numbers", "names", "ids", "own"])

    given = [F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("mark")]
    rows = docs.select(*given, *([] if keep is None else [keep.alias("d")]), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return materialise(rows.mapInArrow(run, f"{kinds}, numbers array<int>, names array<binary>, ids array<long>, own array<string>"), "lines", dictionaries=False)


def buckets(lines: DataFrame, max_part: int = MAX_PART) -> tuple[DataFrame, DataFrame]:
    """Lines of the keys that two lines or more share: (label, id, keys) of buckets of at most ``max_part`` lines,
    equal ones once; and (key, id) of the others. An id is the first half of a line's name; buckets that share
    lines have the same label, unless so many do that each goes by its first line."""
    spark = lines.sparkSession
    cells = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        cell = ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        at = pa.array(np.append(cuts, len(keys)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.view(np.int64))) for x in (keys, ids)]
        return pa.RecordBatch.from_arrays([pa.array(cell[cuts].astype(np.int64)), *lists], ["cell", "keys", "ids"])

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Texts and ids, in slices of bounded text (but whole lines)."""
        for batch in batches:
            own, ids = batch.column("own").flatten(), batch.column("ids").flatten()
            given = pc.is_valid(own)
            own, ids = own.filter(given), ids.filter(given).to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + _FLUSH, side="right")))
                yield own.slice(at, stop - at), ids[at:stop]
                at = stop

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for own, ids in fresh(batches):
            codes = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            lengths = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            short = lengths < SHORT
            parts = [(SHINGLE, codes, lengths, ids)]
            if short.any():
                parts.append((SHORT_SHINGLE, codes[np.repeat(short, lengths)], lengths[short], ids[short]))
            for size, *part in parts:
                keys = band_keys(part[0], part[1], size)
                held.append((keys.ravel(), np.repeat(part[2], keys.shape[1])))
                n += keys.size
            if n >= _FLUSH:
                yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, large: bool, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            at = pa.array(np.append(starts, len(ids)).astype(np.int32))
            own = keys if large else np.zeros_like(keys)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(ids.view(np.int64)))], ["key", "ids"])

        def shared(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Distinct pairs, by key; where runs of a key begin and how long they are; whether each run is shared."""
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(starts, len(keys)))
            several = np.repeat(size > 1, size)
            if several.any():  # only these need an order of their ids
                k, i = keys[several], ids[several]
                order = np.lexsort([i, k])
                k, i = k[order], i[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
                keys, ids = np.concatenate([keys[~several], k[new]]), np.concatenate([ids[~several], i[new]])
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                size = np.diff(np.append(starts, len(keys)))
            return keys, ids, starts, size, size > 1

        def drain(held: list, large: np.ndarray, last: bool) -> tuple[list[pa.RecordBatch], list, np.ndarray]:
            """What a cell tells, what stays for its later rows, and its keys that are large buckets for sure."""
            keys, ids, starts, size, both = shared(*(np.concatenate(x) for x in zip(*held, strict=True)))
            is_large = (size > max_part) | np.isin(keys[starts], large)
            told = []
            run = np.repeat(is_large, size)
            if run.any():  # rows of large buckets go through, however many they are
                told.append(out(keys[run], True, ids[run], np.arange(int(run.sum()))))
            if last:
                run = np.repeat(both & ~is_large, size)
                if run.any():
                    n = size[both & ~is_large]
                    told.append(out(keys[starts[both & ~is_large]], False, ids[run], np.cumsum(n) - n))
            stay = np.repeat(~is_large, size)
            return told, [(keys[stay], ids[stay])] if stay.any() else [], np.union1d(large, keys[starts][is_large])

        current, held, n, large = None, [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for cell, keys, ids in zip(batch.column("cell").to_pylist(), batch.column("keys"), batch.column("ids"), strict=True):
                if cell != current and held:
                    yield from drain(held, large, True)[0]
                    held, n, large = [], 0, np.zeros(0, np.uint64)
                current = cell
                held.append(tuple(x.values.to_numpy().view(np.uint64) for x in (keys, ids)))
                n += len(held[-1][0])
                if n > _CELL_ROWS:
                    told, held, large = drain(held, large, False)
                    yield from told
                    n = len(held[0][0]) if held else 0
        if held:
            yield from drain(held, large, True)[0]

    packed = lines.select("ids", "own").mapInArrow(sign, "cell long, keys array<long>, ids array<long>")
    met = materialise(packed.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "key long, ids array<long>"), "met", dictionaries=False)
    # a small bucket has no key of its own, but is its list of lines
    small = met.filter("key = 0").select("ids").distinct().select(F.xxhash64("ids").alias("key"), F.get("ids", F.lit(0)).alias("first"), F.explode("ids").alias("id"))
    small = materialise(small, "small")
    line = small.groupBy("id").agg(F.min("first").alias("least"))
    label = small.join(line, "id").groupBy("key").agg(F.min("least").alias("label"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    label = materialise(label, "labels")
    many = label.groupBy("label").agg(F.sum("n").alias("n")).select("label", (F.col("n") > _TOGETHER).alias("many"))
    label = label.join(many, "label").select("key", F.when(F.col("many"), F.col("first")).otherwise(F.col("label")).alias("label"))
    small = small.join(label, "key").groupBy("label", "id").agg(F.collect_list("key").alias("keys"))  # a line has a few dozen keys
    large = met.filter("key != 0").select("key", F.get("ids", F.lit(0)).alias("id")).distinct()
    return materialise(small, "small"), materialise(large, "large")


class Sets:
    """The shingle sets of some lines as sorted arrays of numbers, one for each shingle, made when they are needed.

    A number holds a shingle's characters themselves, a byte each, or counts shingles where the lines have more characters than bytes
    have values; so equal numbers are equal shingles.
    """

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.made: dict[tuple[int, int], np.ndarray] = {}
        self.numbers: dict[str, int] = {}
        self.alphabet: np.ndarray | None = None
        self.latin = all(map(str.isascii, lines)) or max(map(max, filter(None, lines)), default="") <= "\xff"
        if not self.latin:
            self.alphabet = np.unique(np.frombuffer("".join({c for line in lines for c in set(line)}).encode("utf-32-le"), dtype=np.uint32))

    def _bytes(self, line: str) -> bytes:
        if self.latin:
            return line.encode("latin-1")
        return np.searchsorted(self.alphabet, np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)).astype(np.uint8).tobytes()

    def _numbers(self, line: str, size: int) -> np.ndarray:
        if len(line) < size or (not self.latin and len(self.alphabet) > 256):
            # above all packed ones of SHORT_SHINGLE; those of SHINGLE use all bits, and a shorter line is never looked up beside them
            return np.array([(1 << 32) + self.numbers.setdefault(x, len(self.numbers)) for x in shingles(line, size)], dtype=np.uint64)
        n, width = len(line) - size + 1, 4 if size < 4 else 8
        packed = np.ndarray((n,), dtype=f"<u{width}", buffer=self._bytes(line) + bytes(width - size), strides=(1,))
        return packed & packed.dtype.type((1 << 8 * size) - 1)

    def of(self, i: int, size: int) -> np.ndarray:
        found = self.made.get((i, size))
        if found is None:
            found = self._numbers(self.lines[i], size)
            found.sort()
            found = found[_changes(found)]
            self.made[i, size] = found
        return found

    def make_room(self) -> None:
        """Forget all sets if there are many; those made before are not to be met with those made after it."""
        if len(self.made) > _SETS or len(self.numbers) > _NUMBERS:
            self.made.clear()
            self.numbers.clear()

    def similar(self, i: int, j: int) -> bool:
        size = SHORT_SHINGLE if len(self.lines[i]) < SHORT and len(self.lines[j]) < SHORT else SHINGLE
        if len(self.lines[i]) < size or len(self.lines[j]) < size:  # such a line is one shingle, which only an equal line has
            return self.lines[i] == self.lines[j]
        self.make_room()
        a, b = self.of(i, size), self.of(j, size)
        if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
            return False
        all_ = np.concatenate([a, b])
        all_.sort()
        both = int(np.count_nonzero(all_[1:] == all_[:-1]))
        return both / (len(all_) - both) >= THRESHOLD


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Whether each value of an ordered, not empty array differs from the one before it."""
    new = np.empty(len(ordered), dtype=bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


class Index:
    """Which lines of some have a shingle: the similarity of one line with all others at once.

    Shingles of many of the lines, as a family of near copies has them, are bits of a row for each line; for each of
    the others the places of its lines are listed.
    """

    def __init__(self, sets: Sets, members: list[int], size: int):
        sets.make_room()
        # a line shorter than a shingle has none that another line has
        made = [sets.of(i, size).astype(np.uint64) if len(sets.lines[i]) >= size else np.zeros(0, np.uint64) for i in members]
        n = len(members)
        self.sizes = np.array([len(m) for m in made])
        place = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        flat = np.concatenate(made)
        order = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(_changes(flat[order])) if len(flat) else order
        counts = np.diff(np.append(begins, len(flat)))
        codes = np.empty(len(flat), dtype=np.int32)
        codes[order] = np.repeat(np.arange(len(begins), dtype=np.int32), counts)
        #: How many of the lines have a shingle of this line, over all its shingles.
        self.shared = np.bincount(place, counts[codes], n)
        # a bit for each line costs less than the places of so many lines
        often = counts > max(1, n // 16)
        bits = np.zeros((n, -(-max(1, int(often.sum())) // 64) * 64), dtype=bool)
        own = often[codes]
        bits[place[own], (np.cumsum(often) - 1)[codes[own]]] = True
        self.bits = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)
        # a shingle of one line is no line's but its own
        some = (counts > 1) & ~often
        listed = some[codes]
        self.codes = codes[listed]
        self.stops = np.cumsum(np.bincount(place[listed], minlength=n))
        self.places, self.begins, self.counts = place[order], begins, counts

    def similar(self, k: int) -> np.ndarray:
        """Places of the lines that are like the line at place ``k`` (itself included, if it has a whole shingle)."""
        both = np.bitwise_count(self.bits & self.bits[:, k : k + 1]).sum(axis=0, dtype=np.int64)
        own = self.codes[self.stops[k - 1] if k else 0 : self.stops[k]]
        if len(own):
            counts = self.counts[own]
            at = np.arange(int(counts.sum())) + np.repeat(self.begins[own] - (np.cumsum(counts) - counts), counts)
            both += np.bincount(self.places[at], minlength=len(self.sizes))
        both[k] = self.sizes[k]
        return np.flatnonzero(both / np.maximum(1, self.sizes[k] + self.sizes - both) >= THRESHOLD)

    def middle(self) -> int:
        """The place of the line whose shingles the most lines have, on average."""
        return int(np.argmax(self.shared / np.maximum(1, self.sizes)))


def linked(names: list[bytes], lines: list[str], groups: list[list[int]] | None = None) -> list[tuple[bytes, bytes]]:
    """Links that tie each line to the least name of its component, by the links inside each of the groups of lines
    (without groups: among all lines).

    The parts of a group that are known to be of one component meet the others, line by line, until two are alike.
    In a group of many lines, those that are not tied to one in its middle are looked up in an index of all shingles instead.
    """
    sets, root = Sets(lines), list(range(len(lines)))
    tried: set[tuple[int, int]] = set()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tie(i: int, j: int) -> None:
        a_root, b_root = sorted((find(i), find(j)), key=names.__getitem__)
        root[b_root] = a_root

    def meet(a: list[int], b: list[int]) -> bool:
        for i in a:
            for j in b:
                pair = (i, j) if i < j else (j, i)
                if pair not in tried:
                    tried.add(pair)
                    if sets.similar(i, j):
                        tie(i, j)
                        return True
        return False

    def parts_of(group: list[int]) -> dict[int, list[int]]:
        parts: dict[int, list[int]] = {}
        for i in group:
            parts.setdefault(find(i), []).append(i)
        return parts

    def look_up(group: list[int]) -> None:
        short = [i for i in group if len(lines[i]) < SHORT]
        for size, members in ((SHORT_SHINGLE, short), (SHINGLE, group if len(short) < len(group) else [])):
            if len(parts_of(members)) < 2:
                continue
            index = Index(sets, members, size)
            middle = index.middle()
            for n, k in enumerate((middle, *range(len(members)))):
                i = members[k]
                if n and find(i) == find(members[middle]):  # two parts meet in a line that is not of this one
                    continue
                for j in index.similar(k).tolist():
                    j = members[j]
                    # two short lines are compared by their short shingles alone
                    if find(i) != find(j) and (size == SHORT_SHINGLE or len(lines[i]) >= SHORT or len(lines[j]) >= SHORT):
                        tie(i, j)

    def compare(group: list[int]) -> None:
        parts = parts_of(group)
        if len(parts) > 1 and len(group) > _MANY:
            blocks, n = [[]], 0
            for i in group:
                if n and n + len(lines[i]) > _INDEXED // 2:
                    blocks.append([])
                    n = 0
                blocks[-1].append(i)
                n += len(lines[i])
            if len(blocks) < 3:
                look_up(group)
            else:  # any two blocks make an index of bounded size
                for x, y in combinations(blocks, 2):
                    compare(x + y) if len(x) + len(y) <= _MANY else look_up(x + y)
            return
        done: list[list[int]] = []
        for part in parts.values() if len(parts) > 1 else ():
            apart = []
            for other in done:
                if meet(other, part):
                    part = other + part
                else:
                    apart.append(other)
            done = [part, *apart]

    for group in groups if groups is not None else [list(range(len(lines)))]:
        compare(group)
    return [(names[find(i)], names[i]) for i in range(len(lines)) if find(i) != i]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _listed(column: pa.Array) -> list:
    """A column as a list; the lists of numbers in it are made at once."""
    if not pa.types.is_list(column.type):
        return column.to_pylist() if pa.types.is_binary(column.type) or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()
    at, values = column.offsets.to_pylist(), column.values.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_group(rows: DataFrame, keys: list[str], solve, schema: str) -> DataFrame:
    """``solve`` for the rows of each group, which lie together in one task: from columns as lists to rows of ``schema``."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(batch: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
            columns = {c: _listed(batch.column(c)) for c in batch.schema.names}
            groups = ({c: v[a:b] for c, v in columns.items()} for a, b in zip(starts[:-1], starts[1:], strict=True))
            found = [x for g in groups for x in solve(g)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(fields)], schema=fields)

        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            new = np.zeros(batch.num_rows, dtype=bool)
            for ids in (batch.column(k).to_numpy(zero_copy_only=False) for k in keys):
                new[1:] |= ids[1:] != ids[:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if last:
                yield solved(batch.slice(0, last), [0, *np.flatnonzero(new[:last]).tolist(), last])
            rest = batch.slice(last)
        if rest is not None and rest.num_rows:
            yield solved(rest, [0, rest.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _links(group: dict[str, list]) -> list[tuple[bytes, bytes]]:
    texts = dict(zip(group["name"], group["own"], strict=True))
    return linked(list(texts), list(texts.values()))


def _bucket_links(group: dict[str, list]) -> list[tuple[bytes, bytes]]:
    members: dict[int, list[int]] = {}
    for i, keys in enumerate(group["keys"]):
        for k in keys:
            members.setdefault(k, []).append(i)
    return linked(group["name"], group["own"], list(members.values()))


def _large_links(large: DataFrame, max_part: int) -> DataFrame:
    """(a, b) links of the buckets (key, name, own) of many lines."""
    large = materialise(large, "large")
    whole = F.min(F.struct("name", "own")).alias("head")
    sizes = materialise(large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), whole).withColumn("parts", F.ceil(F.col("n") / max_part).cast("int")), "sizes")
    dealt = join_counted(large, sizes.select("key", "parts", "n"), "key")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    heads = sizes.select("key", F.col("head.name").alias("name"), F.col("head.own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def beside_head(group: dict[str, list]) -> list[tuple]:
        first = group["second"].index(0)
        sets, head = Sets(group["own"]), group["name"][first]
        rows = zip(group["key"], group["part"], group["name"], group["own"], strict=True)
        return [(*row, head if sets.similar(first, i) else None) for i, row in enumerate(rows) if i != first]

    both = dealt.select("key", "part", "name", "own", F.lit(1).alias("second")).unionByName(heads.select("key", "part", "name", "own", F.lit(0).alias("second")))
    judged = materialise(_by_group(both, ["key", "part"], beside_head, "key long, part int, name binary, own string, head binary"), "judged")
    near = judged.filter("head IS NOT NULL AND head != name").select(F.col("head").alias("a"), F.col("name").alias("b"))
    # the others meet all lines of the bucket
    n = judged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("head").isNull(), 1)).alias("m"), F.max("part").alias("last"))
    n = materialise(n.filter("m > 0").withColumn("groups", F.ceil(F.col("m") / max_part).cast("int")).select("key", "n", "last", "groups"), "open")
    rows = join_counted(judged, n, "key")
    own = F.pmod(F.xxhash64("name", F.lit(1)), F.col("groups")).cast("int")
    first = rows.filter("head IS NULL").select("key", own.alias("g"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"), "name", "own")
    second = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "part", "name", "own")
    far = _by_group(first.unionByName(second), ["key", "g", "part"], _links, "a binary, b binary")
    return near.unionByName(far)


def links(lines: DataFrame, max_part: int = MAX_PART) -> DataFrame:
    """(a, b): links between line names that keep every component together."""
    small, large = buckets(lines, max_part)
    texts = lines.select(F.explode(F.arrays_zip("names", "ids", "own")).alias("x")).filter("x.own IS NOT NULL")
    texts = texts.select(F.col("x.ids").alias("id"), F.col("x.names").alias("name"), "x.own")
    wanted = small.select("id").unionByName(large.select("id")).distinct()
    known = texts.join(wanted, "id", "left_semi").groupBy("id", "name").agg(F.min("own").alias("own"))
    some = not large.isEmpty()
    known = materialise(known, "known") if some else known
    found = _by_group(small.join(known, "id").select("label", "keys", "name", "own"), ["label"], _bucket_links, "a binary, b binary")
    return found.unionByName(_large_links(large.join(known, "id").select("key", "name", "own"), max_part)) if some else found


def removed_lines(lines: DataFrame, max_part: int = MAX_PART) -> DataFrame:
    """(row, removed): the numbers of the lines that a row loses; rows that lose none are left out."""
    roots = connected_components(links(lines, max_part)).withColumnRenamed("node", "name")
    places = lines.select("row", "doc", "mark", F.explode(F.arrays_zip("numbers", "names")).alias("x"))
    places = places.select(F.col("x.names").alias("name"), F.struct("doc", "mark", "row", F.col("x.numbers").alias("number")).alias("place"))
    first = materialise(places.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")), "first", dictionaries=False)
    # classes of several lines keep the least of their first places
    several = materialise(first.join(roots, "name"), "several", dictionaries=False)
    least = materialise(several.groupBy("root").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("members")), "least")
    classes = join_counted(several.select("name", "root", "n"), least, "root", n="members").select("name", "n", "kept")
    alone = first.filter("n > 1").join(roots, "name", "left_anti").select("name", "n", F.col("first").alias("kept"))
    doubled = materialise(classes.unionByName(alone), "doubled", dictionaries=False)
    gone = join_counted(places, doubled, "name").filter("place != kept").select("place.row", "place.number")
    return gone.groupBy("row").agg(F.array_sort(F.collect_list("number")).alias("removed"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", max_part: int = MAX_PART) -> DataFrame:
    """Per row: key, n_lines (not blank), n_removed, and the numbers of the removed lines from 0."""
    lines = split_lines(docs, key, text)
    found = lines.select("row", "doc", F.size("numbers").cast("long").alias("n_lines")).join(removed_lines(lines, max_part), "row", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select(F.col("doc").alias(key), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", max_part: int = MAX_PART) -> DataFrame:
    """``docs`` without the removed lines; a text of which no line is left becomes empty."""
    # the row is one column, so that no name of its own meets those of the report
    lines = split_lines(docs, key, text, keep=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    joined = lines.select("row", "d").join(removed_lines(lines, max_part), "row", "left")
    own = F.col("d").getField(text)
    kept = F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains("removed", i))
    cut = F.when(F.col("removed").isNull(), own).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("d").withField(text, cut).alias("d")).select("d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
