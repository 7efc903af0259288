"""LM scoring by cross-entropy difference of two matched n-gram models.

A target model and a background model of the same order, smoothing and vocabulary are counted over
all documents (those for which ``target`` holds, and all others). Every document gets the mean loss
of a token under either model and their difference: the lower, the more it reads like the target.

Counts cover the whole corpus. The vocabulary holds all words, and the models hold all pairs, that
occur ``LEAST`` times or more, whatever the size of the corpus. All other words are one unknown word,
and the probability of other pairs backs off to that of the word:

    P(w | v) = L * c(v, w) / c(v) + (1 - L * kept(v)) * P(w),   P(w) = (c(w) + 1) / (N + V)

where kept(v) is the share of v's successors whose pairs are in the model, and the first token of a
document has P(w).

Both models are Spark tables. The loss of a document is a sum of terms: one for each word, w's own
-log P(w) and, where a word follows, -log of the back-off weight; and for each pair in the model what
it takes off. Documents are turned into word hashes once; the ``HEAD`` / 2 most frequent words then go by
small numbers. Their terms and those of the ``HEAD`` most frequent pairs are broadcast and added up where the documents lie; all other
words and pairs of the documents meet the terms in cells, ranges of a 64-bit hash of the term, which come to a
task one after another. Pairs are counted in such cells as well. Their columns travel packed, and there
is a cell for every ``CELL`` tokens, so a task's memory does not grow with the corpus. ``HEAD`` and ``CELL``
bound memory and change no result. Terms are kept to seven digits, and added up in full. Words are told apart by 64-bit hashes, terms by hashes of 62 bits.

Defined cases: null, empty and blank texts have no tokens and zero losses. Texts are read whole.
Rows whose target flag is null belong to the background. Repeated rows count each time. If either
side is empty its probabilities are uniform. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, scratch

LEAST = 2
LAMBDA = 0.7
#: Most pairs whose terms are broadcast; of words, half as many.
HEAD = 1 << 18
#: Tokens for each cell.
CELL = 1 << 21
#: Fewest cells, so that small corpora are dealt to several tasks.
CELLS = 32
#: Sums of rows that a task holds back to add those of its next cells; about 6 MB.
MOST_SUMS = 1 << 18
_SLICE = 1 << 21
_TOKENS = 1 << 19
_ROWS = 1 << 18
#: Codes that are no word's hash: no neighbour, the unknown word, and what stands behind a word in the key of its terms.
NONE, UNKNOWN, WORD, LAST = range(4)
#: Hashes of words are not in this range; frequent words are numbered inside it.
_NUMBERS = 1 << 30


def _token_slices(texts: list[str | None]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For slices of the list: first text, its words one after another (each with a blank behind), words of each text."""
    start = 0
    while start < len(texts):
        stop, size, parts, counts = start, 0, [], []
        while stop < len(texts) and (stop == start or size < _SLICE):
            words = (texts[stop] or "").lower().encode("utf-8", "surrogatepass").split()
            counts.append(len(words))
            if words:
                parts.append(b" ".join(words))
                size += len(parts[-1])
            stop += 1
        raw = b" ".join(parts) + b" " if parts else b""
        ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x20) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        yield start, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.array(counts)
        start = stop


def _hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    coded = words.dictionary_encode()
    found = coded.dictionary.to_pylist()
    own = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found)).view(np.int64)
    own[(own >= 0) & (own < _NUMBERS)] += _NUMBERS
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def tokenised(docs: DataFrame, text: str, target: Column, key: str) -> DataFrame:
    """(row, key, target, words): the word hashes of each row, which gets a number of its own; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, counts in _token_slices(batch.column("_text").to_pylist()):
                part = batch.slice(first, len(counts))
                values = _hashes(words) if len(words) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), part.column("target"), lists], ["row", "key", "target", "words"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(target, F.lit(False)).alias("target"), F.col(text).alias("_text"))
    found = rows.mapInArrow(run, f"row long, key {kind}, target boolean, words array<long>")
    path = scratch(docs.sparkSession, "tokens")
    # a dictionary of all words of a file: indexes take less room than hashes, which do not compress
    found.write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, target, words in each row, all words) for slices of the batches."""
    for batch in batches:
        counts = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = batch.column("words").flatten().to_numpy(zero_copy_only=False)
        rows, flags = batch.column("row").to_numpy(), batch.column("target").to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        start = 0
        while start < len(counts):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _TOKENS, side="right")))
            yield rows[start:stop], flags[start:stop], counts[start:stop], values[done : int(ends[stop - 1])]
            start = stop


def _neighbours(counts: np.ndarray) -> np.ndarray:
    """Which words start a pair; pairs never cross documents."""
    inside = np.ones(int(counts.sum()), dtype=bool)
    inside[np.cumsum(counts)[counts > 0] - 1] = False
    return np.flatnonzero(inside)


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, _ROWS):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[at : at + _ROWS]) for k, v in columns.items()})


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n_target").alias("n_target"), F.sum("n_background").alias("n_background"))


def count_words(tokens: DataFrame) -> DataFrame:
    """(word, n_target, n_background) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flags, counts, words in _slices(batches):
            hit = np.repeat(flags, counts)
            for side in (True, False):
                found, n = np.unique(words[hit == side], return_counts=True)
                zero = np.zeros_like(n)
                yield from _batches({"word": found, "n_target": n if side else zero, "n_background": zero if side else n})

    return _counted(tokens.select("row", "target", "words").mapInArrow(run, "word long, n_target long, n_background long"), "word")


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each term; its last two bits are WORD or LAST for terms of words, and NONE for pairs."""
    code = (a.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + b.view(np.uint64)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return (code & ~np.uint64(3)) | np.where((b == WORD) | (b == LAST), b, NONE).view(np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, first byte of each first, compressed: what they have in common takes no room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return _ZSTD.compress(planes, asbytes=True)


def _unpack(blob: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(blob, 8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _cells(codes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The cells of sorted codes: the first ``bits`` bits."""
    cells = codes >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
    for start, stop in zip(starts, np.append(starts[1:], len(cells)), strict=False):
        yield int(cells[start]), slice(start, stop)


def _bits(tokens: int) -> int:
    return (max(CELLS, -(-tokens // CELL)) - 1).bit_length()


def _by_cell(rows: DataFrame, bits: int, *order: str) -> DataFrame:
    return rows.repartition(1 << bits, "cell").sortWithinPartitions("cell", *order)


class Lookup:
    """Sorted evenly spread keys of 64 bits, found by a table of where each small range of them starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts: np.ndarray | None = None

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values stand among the keys, and whether they do."""
        if not len(self.keys):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        least, last = int(self.keys[0]), len(self.keys) - 1
        if self.starts is None:
            self.shift = np.uint64(max(0, (int(self.keys[-1]) - least).bit_length() - last.bit_length() - 2))
            edges = (self.keys.view(np.uint64) - np.uint64(least % (1 << 64))) >> self.shift
            self.starts = np.searchsorted(edges, np.arange(int(edges[-1]) + 1, dtype=np.uint64)).astype(np.int32)
        # values below all keys wrap around to the last range
        place = (values.view(np.uint64) - np.uint64(least % (1 << 64))) >> self.shift
        at = self.starts[np.minimum(place, np.uint64(len(self.starts) - 1)).view(np.int64)].astype(np.int64)
        behind = np.flatnonzero(self.keys[at] < values)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < values[behind]]
        return at, self.keys[at] == values


def _numbered(frequent: Lookup, words: np.ndarray) -> np.ndarray:
    """Frequent words as numbers, other words as they are."""
    at, known = frequent.find(words)
    return np.where(known, at + LAST + 1, words)


def numbered(words: DataFrame, shared: Broadcast) -> DataFrame:
    """The same rows, with the column ``word`` as ``_numbered`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("word")
            yield batch.set_column(at, "word", pa.array(_numbered(shared.value, batch.column("word").to_numpy())))

    return words.mapInArrow(run, words.schema)


def _summed(a: np.ndarray, b: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted codes of the distinct pairs, the pairs and their summed counts."""
    codes = _code(a, b)
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=~codes[:1]))
    first = order[starts]
    return codes[starts], a[first], b[first], [np.add.reduceat(c[order], starts, dtype=np.int64) if len(starts) else c.astype(np.int64) for c in counts]


def count_pairs(tokens: DataFrame, shared: Broadcast, bits: int, least: int) -> DataFrame:
    """(a, b, n_target, n_background): pairs of neighbouring words that occur ``least`` times in all rows."""
    fields = ["a", "b", "n_target", "n_background"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flags, counts, words in _slices(batches):
            coded = _numbered(shared.value, words)
            at = _neighbours(counts)
            hit = np.repeat(flags, counts)[at]
            codes, a, b, n = _summed(coded[at], coded[at + 1], [hit, ~hit])
            rows = [(cell, s.stop - s.start, *(_pack(x[s]) for x in (a, b, *n))) for cell, s in _cells(codes, bits)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(["cell", "size", *fields], zip(*rows, strict=True), strict=True)), schema=sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["cell"]):
            columns = [np.concatenate(x) for x in zip(*([_unpack(r[f], r["size"]) for f in fields] for r in parts), strict=True)]
            _, a, b, n = _summed(columns[0], columns[1], columns[2:])
            kept = n[0] + n[1] >= least
            yield from _batches(dict(zip(fields, [x[kept] for x in (a, b, *n)], strict=True)))

    sent = pa.schema([("cell", pa.int64()), ("size", pa.int64()), *((f, pa.binary()) for f in fields)])
    cells = tokens.select("row", "target", "words").mapInArrow(send, "cell long, size long, " + ", ".join(f"{f} binary" for f in fields))
    return _by_cell(cells, bits).mapInArrow(count, "a long, b long, n_target long, n_background long")


def _head(df: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach (by steps of a twelfth of a doubling)."""
    step = F.floor(F.log2("n") * 12)
    found = df.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).orderBy(F.desc("s")).collect()
    least, total = 1 << 62, 0
    for r in found:
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least


def unknown_tokens(tokens: DataFrame, words: DataFrame, shared: Broadcast) -> DataFrame:
    """(row, target, before, after) of each word that is not in ``words``; neighbours may be unknown, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flags, counts, found in _slices(batches):
            coded = _numbered(shared.value, found)
            rare = np.flatnonzero(coded == found)
            owner = np.repeat(np.arange(len(counts)), counts)[rare]
            starts = np.cumsum(counts) - counts
            place = rare - starts[owner]
            wide = np.concatenate([[NONE], coded, [NONE]])
            before = np.where(place > 0, wide[rare], NONE)
            after = np.where(place + 1 < counts[owner], wide[rare + 2], NONE)
            yield from _batches({"row": rows[owner], "target": flags[owner], "place": place, "word": found[rare], "before": before, "after": after})

    rare = tokens.select("row", "target", "words").mapInArrow(run, "row long, target boolean, place long, word long, before long, after long")
    first = scratch(tokens.sparkSession, "unknown")
    missing = materialise(rare.join(words.select("word"), "word", "left_anti"), path=first)
    # neighbours that are unknown themselves
    places = missing.select("row", "place", F.lit(True).alias("u"))
    for side, shift in (("before", 1), ("after", -1)):
        near = places.select("row", (F.col("place") + shift).alias("place"), F.col("u").alias(side + "_u"))
        missing = missing.join(near, ["row", "place"], "left")
        missing = missing.withColumn(side, F.when(F.col(side + "_u"), F.lit(UNKNOWN).cast("long")).otherwise(F.col(side)))
    whole = materialise(missing.select("row", "target", "before", "after"), "unknown")
    discard(tokens.sparkSession, first)
    return whole


def unknown_pairs(unknown: DataFrame) -> DataFrame:
    """(row, target, a, b) of each pair of neighbours that has an unknown word."""
    code = F.lit(UNKNOWN).cast("long")
    behind = unknown.filter(F.col("before") != NONE).select("row", "target", F.col("before").alias("a"), code.alias("b"))
    ahead = unknown.filter(~F.col("after").isin(NONE, UNKNOWN)).select("row", "target", code.alias("a"), F.col("after").alias("b"))
    return behind.unionByName(ahead)


def _looked_up(df: DataFrame, key: str, model: DataFrame, values: list[str], out: str) -> DataFrame:
    """Add the values of the word ``key`` as a struct; those of frequent words are broadcast, so no task gets all rows of one."""
    facts = model.select(F.col("word").alias(key), F.struct(*values).alias(out))
    frequent = F.col(key).between(UNKNOWN, _NUMBERS - 1)
    near = df.filter(frequent).join(F.broadcast(facts.filter(frequent)), key)
    return near.unionByName(df.filter(~frequent).join(facts.filter(~frequent), key))


@dataclass
class Fitted:
    """The terms of both models as a table, and what the documents of the fit have been turned into."""

    terms: DataFrame
    words: DataFrame
    frequent: Broadcast
    unknown: dict[int, tuple[float, float]]
    head: int
    bits: int
    docs: DataFrame
    columns: tuple[str, str]
    tokens: DataFrame
    unknown_tokens: DataFrame


def fit(docs: DataFrame, target: Column, text: str = "text", least: int = LEAST, weight: float = LAMBDA, key: str = "doc_id", head: int = HEAD) -> Fitted:
    """The two models over all rows: every word and pair that occurs ``least`` times."""
    spark = docs.sparkSession
    tokens = tokenised(docs, text, target, key)
    size = F.size("words").cast("long")
    sums = tokens.agg(F.sum(F.when(F.col("target"), size)).alias("t"), F.sum(F.when(~F.col("target"), size)).alias("b")).first()
    total = [sums["t"] or 0, sums["b"] or 0]
    n = F.col("n_target") + F.col("n_background")
    words = materialise(count_words(tokens).filter(n >= least).withColumn("n", n), "words")
    own = words.agg(F.count(F.lit(1)).alias("n"), F.sum("n_target").alias("t"), F.sum("n_background").alias("b")).first()
    rest = [total[0] - (own["t"] or 0), total[1] - (own["b"] or 0)]
    top = words.filter(F.col("n") >= _head(words, head // 2)).select("word").toPandas()["word"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(Lookup(np.sort(top)))
    bits = _bits(sum(total))
    unknown = unknown_tokens(tokens, words, frequent)
    odd = unknown_pairs(unknown).select("a", "b", F.col("target").cast("long").alias("n_target"), (~F.col("target")).cast("long").alias("n_background"))
    # pairs with a word that occurs less than ``least`` times are rarer than that themselves, so none of them is in both
    kept = count_pairs(tokens, frequent, bits, least).unionByName(_counted(odd, "a", "b").filter(n >= least))
    paths = [scratch(spark, "pairs"), scratch(spark, "model")]
    pairs = materialise(kept.withColumn("n", n), path=paths[0])

    more = spark.createDataFrame([(UNKNOWN, *map(int, rest), 1 << 62)], "word long, n_target long, n_background long, n long")
    mass = pairs.groupBy(F.col("a").alias("word")).agg(F.sum("n_target").alias("m_target"), F.sum("n_background").alias("m_background"))
    every = numbered(words, frequent).unionByName(more).join(mass, "word", "left")
    for side, k in (("target", 0), ("background", 1)):
        count = F.greatest(F.col(f"n_{side}"), F.lit(1)).cast("double")
        every = every.withColumn(f"c_{side}", count)
        every = every.withColumn(f"p_{side}", (F.col(f"n_{side}") + 1.0) / F.lit(float(total[k] + own["n"] + 1)))
        every = every.withColumn(f"o_{side}", F.greatest(1.0 - weight * F.coalesce(F.col(f"m_{side}"), F.lit(0)) / count, F.lit(1e-6)))
    model = materialise(every.select("word", "n", *[f"{x}_{s}" for s in ("target", "background") for x in "cpo"]), path=paths[1])

    first = _looked_up(pairs, "a", model, ["c_target", "o_target", "c_background", "o_background"], "x")
    both = _looked_up(first, "b", model, ["p_target", "p_background"], "v")
    gain = [-F.log1p(weight * F.col(f"n_{s}") / F.col(f"x.c_{s}") / (F.col(f"v.p_{s}") * F.col(f"x.o_{s}"))) for s in ("target", "background")]
    terms = both.select("a", "b", "n", gain[0].alias("t"), gain[1].alias("u"))
    inner = [-F.log(f"p_{s}") - F.log(f"o_{s}") for s in ("target", "background")]
    last = [F.log(f"o_{s}") for s in ("target", "background")]
    for code, parts in ((WORD, inner), (LAST, last)):
        terms = terms.unionByName(model.select(F.col("word").alias("a"), F.lit(code).cast("long").alias("b"), "n", parts[0].alias("t"), parts[1].alias("u")))
    terms = materialise(terms.withColumns({"t": F.col("t").cast("float"), "u": F.col("u").cast("float")}), "terms")
    discard(spark, *paths)
    default = {r["b"]: (r["t"], r["u"]) for r in terms.filter((F.col("a") == UNKNOWN) & F.col("b").isin(WORD, LAST)).collect()}
    return Fitted(terms, words, frequent, default, _head(terms.filter(~F.col("b").isin(WORD, LAST)), head), bits, docs, (key, text), tokens, unknown)


class Terms:
    """Some terms in arrays."""

    def __init__(self, code: np.ndarray, t: np.ndarray, u: np.ndarray):
        order = np.argsort(code)
        self.own, self.value = Lookup(code[order]), np.stack([t, u])[:, order]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.own.find(code)


_SENT = {"cell": "long", "row": "long", "size": "long", "codes": "binary", "rows": "binary", "t": "binary", "u": "binary"}
_KINDS = {"long": pa.int64(), "binary": pa.binary()}


def _message(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=pa.schema([(k, _KINDS[v]) for k, v in _SENT.items()]))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once, with the sums of its values."""
    order = np.argsort(rows)
    own = rows[order]
    starts = np.flatnonzero(np.diff(own, prepend=~own[:1]))
    return own[starts], np.stack([np.add.reduceat(v[order], starts) if len(starts) else v for v in values])


def _sent(rows: np.ndarray, codes: np.ndarray, bits: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Messages: sums of rows that are known already (cell -1, no codes), and the rows of other terms by cell."""
    columns: dict[str, list] = {k: [] for k in _SENT}

    def add(*values) -> None:
        for column, value in zip(columns.values(), values, strict=True):
            column.append(value)

    if sums is not None and len(sums[0]):
        add(-1, -1, len(sums[0]), None, _pack(sums[0]), _pack(sums[1][0]), _pack(sums[1][1]))
    order = np.argsort(codes)
    rows, codes = rows[order], codes[order]
    for cell, s in _cells(codes, bits):
        base = int(rows[s].min())
        add(cell, base, s.stop - s.start, _pack(np.diff(codes[s], prepend=np.uint64(0))), _pack(rows[s] - base), None, None)
    yield _message(columns)


def _messages(tokens: DataFrame, unknown: DataFrame, fitted: Fitted) -> DataFrame:
    """What tells the terms of every row: those of its words and pairs, and of pairs with an unknown word."""
    spark, bits, frequent = tokens.sparkSession, fitted.bits, fitted.frequent
    of_word = F.col("b").isin(WORD, LAST)
    frequent_word = of_word & F.col("a").between(LAST + 1, _NUMBERS - 1)
    frequent_pair = ~of_word & (F.col("n") >= fitted.head)
    top = fitted.terms.filter(frequent_pair).select("a", "b", "t", "u").toPandas()
    codes = _code(top["a"].to_numpy(np.int64), top["b"].to_numpy(np.int64))
    head = spark.sparkContext.broadcast(Terms(codes, top["t"].to_numpy(np.float64), top["u"].to_numpy(np.float64)))
    top = fitted.terms.filter(frequent_word).select("a", "b", "t", "u").toPandas()
    terms = np.zeros((2, 2, len(frequent.value.keys)))
    for k, column in enumerate(("t", "u")):
        terms[(top["b"] == LAST).to_numpy(np.int64), k, top["a"].to_numpy(np.int64) - LAST - 1] = top[column].to_numpy(np.float64)
    own = spark.sparkContext.broadcast(terms)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, counts, words in _slices(batches):
            number, known = frequent.value.find(words)
            coded = np.where(known, number + LAST + 1, words)
            owner = np.repeat(np.arange(len(rows)), counts)
            ends = np.cumsum(counts)[counts > 0] - 1
            sums, rest = np.zeros((2, len(rows))), []
            for code, at in ((WORD, np.arange(len(words))), (LAST, ends)):
                told = at[known[at]]
                for k in (0, 1):
                    sums[k] += np.bincount(owner[told], weights=own.value[code - WORD, k][number[told]], minlength=len(rows))
                others = at[~known[at]]
                rest.append((others, _code(coded[others], np.full(len(others), code))))
            at = _neighbours(counts)
            codes = _code(coded[at], coded[at + 1])
            place, hit = head.value.find(codes)
            for k in (0, 1):
                sums[k] += np.bincount(owner[at[hit]], weights=head.value.value[k][place[hit]], minlength=len(rows))
            rest.append((at[~hit], codes[~hit]))
            who, what = map(np.concatenate, zip(*rest, strict=True))
            yield from _sent(rows[owner[who]], what, bits, (rows, sums))

    def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b = (batch.column(k).to_numpy() for k in ("row", "a", "b"))
            codes = _code(a, b)
            place, hit = head.value.find(codes)
            yield from _sent(row[~hit], codes[~hit], bits, _sums(row[hit], head.value.value[:, place[hit]]))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, t, u = (batch.column(k).to_numpy() for k in ("a", "b", "t", "u"))
            code = _code(a, b)
            order = np.argsort(code)
            code, t, u = code[order], t[order].astype(np.float64), u[order].astype(np.float64)
            rows = [(cell, -1, s.stop - s.start, _pack(code[s]), None, _pack(t[s]), _pack(u[s])) for cell, s in _cells(code, bits)]
            if rows:
                yield _message(dict(zip(_SENT, map(list, zip(*rows, strict=True)), strict=True)))

    schema = ", ".join(f"{k} {v}" for k, v in _SENT.items())
    rare = fitted.terms.filter(~frequent_word & ~frequent_pair).select("a", "b", "t", "u").mapInArrow(kept, schema)
    said = tokens.select("row", "target", "words").mapInArrow(whole, schema)
    return rare.unionByName(said).unionByName(unknown_pairs(unknown).select("row", "a", "b").mapInArrow(odd, schema))


def _added(batches: Iterator[pa.RecordBatch], unknown: dict[int, tuple[float, float]]) -> Iterator[pa.RecordBatch]:
    """(row, t, u): sums of the terms of rows, cell by cell; the terms of a cell come before the rows.

    What the cells of a task say of a row is added up before it is handed on, as far as ``MOST_SUMS`` rows go.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return _sums(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1))

    for _, parts in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["cell"]):
        terms: list[tuple] = []
        known = None
        for r in parts:
            n = r["size"]
            if r["codes"] is None:
                yield from _batches({"row": _unpack(r["rows"], n), "t": _unpack(r["t"], n, np.float64), "u": _unpack(r["u"], n, np.float64)})
                continue
            codes = _unpack(r["codes"], n, np.uint64)
            if r["row"] < 0:
                terms.append((codes, _unpack(r["t"], n, np.float64), _unpack(r["u"], n, np.float64)))
                continue
            if known is None:
                known = Terms(*map(np.concatenate, zip(*terms, strict=True))) if terms else Terms(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
            rows, codes = _unpack(r["rows"], n) + r["row"], np.cumsum(codes)
            at, hit = known.find(codes)
            kind = codes & np.uint64(3)
            values = np.zeros((2, n))
            for code, value in unknown.items():
                values[:, kind == code] = np.array(value)[:, None]
            if hit.any():
                values[:, hit] = known.value[:, at[hit]]
            told = hit | (kind != NONE)
            found.append(_sums(rows[told], values[:, told]))
            if sum(len(f[0]) for f in found) > 2 * MOST_SUMS:
                found = [summed()]
                if len(found[0][0]) > MOST_SUMS:
                    yield from _batches({"row": found[0][0], "t": found[0][1][0], "u": found[0][1][1]})
                    found = []
    if found:
        rows, values = summed()
        yield from _batches({"row": rows, "t": values[0], "u": values[1]})


def score(docs: DataFrame, fitted: Fitted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: key, n_tokens, target_loss, background_loss and score (their difference)."""
    if docs is fitted.docs and (key, text) == fitted.columns:
        tokens, unknown = fitted.tokens, fitted.unknown_tokens
    else:
        tokens = tokenised(docs, text, F.lit(False), key)
        unknown = unknown_tokens(tokens, fitted.words, fitted.frequent)
    messages, default = _messages(tokens, unknown, fitted), fitted.unknown
    # sums of frequent terms need no cell and stay where they are dealt by row
    cells = messages.withColumn("cell", F.when(F.col("cell") < 0, -1 - F.pmod(F.xxhash64("rows"), F.lit(1 << fitted.bits))).otherwise(F.col("cell")))
    # a task has many cells, so that what they say of a row meets there; a row is shuffled once for each task at most
    tasks = min(1 << fitted.bits, max(CELLS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "row")
    parts = dealt.mapInArrow(lambda batches: _added(batches, default), "row long, t double, u double")
    sums = parts.groupBy("row").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
    n = F.size("words").cast("long")
    whole = tokens.select("row", "key", n.alias("n_tokens")).join(sums, "row", "left")
    mean = [F.coalesce(F.col(x) / F.greatest("n_tokens", F.lit(1)), F.lit(0.0)) for x in ("t", "u")]
    return whole.select(F.col("key").alias(key), "n_tokens", mean[0].alias("target_loss"), mean[1].alias("background_loss"), (mean[0] - mean[1]).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The target is the curated source ``src1``; every document is scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, F.col("source") == "src1"))
