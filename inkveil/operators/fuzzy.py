"""Values that survive with a few characters wrong: approximate search of a value in a text, without a scan of all windows.

Letters and digits alone count, in capitals. A value of n characters is near a text if some substring is at most
floor(n / 5) edits away (insert, delete, replace): a similarity of 0.8. The search is exact:

* filter: a substring within k edits of the value shares at least n - q + 1 - k * q of the value's q-grams (q is 3, for values under 10
  characters 2), and their places in text and value differ by amounts at most 2 * k apart. The text's q-grams are numbers that are looked up
  among those of all values at once; only stretches with enough hits go on.
* verification: edit distance by bit vectors, a whole column of the table in a few operations on one number per character. The
  tables of many rows are filled together, and short texts are verified whole, without the filter.

Values meet their text in a join on the document. A document with many values gets several rows of at most ``GROUP`` values, so
neither a text nor a list of values without bound comes to one task through a hot document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: One edit is allowed for so many characters of a value.
CHARS_PER_EDIT = 5
#: Values of a document that share a row.
GROUP = 1000


def plain(text: Column) -> Column:
    """Letters and digits of ASCII, in capitals."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z]", ""))


def allowed(value: str) -> int:
    return len(value) // CHARS_PER_EDIT


def least_edits(value: str, text: str, most: int) -> int | None:
    """Edits between the value and the nearest substring of the text, or None above ``most``."""
    n = len(value)
    if n <= most:
        return n
    where: dict[str, int] = {}
    for i, c in enumerate(value):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, best = full, 0, n, n
    for c in text:
        match = where.get(c, 0)
        same = match | down
        flat = (((match & up) + up) ^ up) | match
        rise = down | ~(flat | up) & full
        fall = up & flat
        if rise & last:
            edits += 1
        elif fall & last:
            edits -= 1
        # a substring may begin anywhere: nothing is carried into the first row
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | ~(same | rise) & full, rise & same
        best = min(best, edits)
    return best if best <= most else None


def _numbers(text: bytes, q: int) -> np.ndarray:
    """The q-grams of a text of ASCII characters as numbers."""
    codes = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(codes) < q:
        return np.empty(0, np.int64)
    total = codes[: len(codes) - q + 1].copy()
    for k in range(1, q):
        total = total * 128 + codes[k : len(codes) - q + 1 + k]
    return total


def _stretches(values: list[str], text: str) -> Iterator[tuple[int, int, int]]:
    """(value, from, to): the stretches of the text that can hold a value."""
    data = text.encode()
    for q in (2, 3):
        own = [v for v, x in enumerate(values) if (q == 3) == (len(x) >= 10) and len(x) >= q]
        if not own:
            continue
        grams = [_numbers(values[v].encode(), q) for v in own]
        numbers = np.concatenate(grams)
        offsets = np.concatenate([np.arange(len(g)) for g in grams])
        holders = np.repeat(own, [len(g) for g in grams])
        order = np.argsort(numbers, kind="stable")
        numbers, offsets, holders = numbers[order], offsets[order], holders[order]
        seen = _numbers(data, q)
        low, high = np.searchsorted(numbers, seen, "left"), np.searchsorted(numbers, seen, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        # every (place in the text, q-gram of a value) that agree
        entry = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        holder, shift = holders[entry], np.repeat(hit, many) - offsets[entry]
        order = np.lexsort((shift, holder))
        holder, shift = holder[order], shift[order]
        starts = np.searchsorted(holder, own, "left")
        for v, a, b in zip(own, starts, np.searchsorted(holder, own, "right"), strict=True):
            n, k = len(values[v]), allowed(values[v])
            need = n - q + 1 - k * q
            d = shift[a:b]
            if len(d) < need:
                continue
            close = np.flatnonzero(d[need - 1 :] - d[: len(d) - need + 1] <= 2 * k)
            at = -1
            for i in close.tolist():
                begin, end = max(0, int(d[i]) - k), min(len(text), int(d[i + need - 1]) + n + k)
                if begin <= at:
                    pending = (v, pending[1], max(pending[2], end))
                else:
                    if at >= 0:
                        yield pending
                    pending = (v, begin, end)
                at = pending[2]
            if at >= 0:
                yield pending


#: Bits of a number that a column of the table may take; longer values are verified one by one.
WORD = 63
#: Pairs whose columns are taken together: their table of characters has some 4 MB.
TOGETHER = 4096
#: Characters of the values times those of the text, up to which the whole text is verified: a filter would cost more.
WHOLE = 1 << 12
#: Pairs and their characters that wait for verification at most.
MOST_PAIRS, MOST_CHARS = 1 << 15, 1 << 22


def least_edits_of_pairs(values: list[str], texts: list[str]) -> np.ndarray:
    """For many pairs at once the edits of ``least_edits``, whatever is allowed: a column of all tables in a few operations."""
    best = np.empty(len(values), np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        best[own] = _columns([values[i] for i in own], [texts[i] for i in own], lengths[own])
    return best


def _columns(values: list[str], texts: list[str], lengths: np.ndarray) -> np.ndarray:
    """``least_edits_of_pairs`` of texts that do not grow in length."""
    n = np.array([len(v) for v in values], np.int64)
    rows, one = np.arange(len(values)), np.uint64(1)
    codes = lambda strings: np.frombuffer("".join(strings).encode(), np.uint8)
    held, where = codes(values), np.zeros((len(values), 128), np.uint64)
    first = np.cumsum(n) - n
    for i in range(int(n.max(initial=0))):
        own = rows[n > i]
        where[own, held[first[own] + i]] |= one << np.uint64(i)
    read, begin = codes(texts), np.cumsum(lengths) - lengths
    full, last = (one << n.astype(np.uint64)) - one, one << (n - 1).astype(np.uint64)
    up, down, edits, best = full.copy(), np.zeros(len(values), np.uint64), n.copy(), n.copy()
    for j in range(int(lengths.max(initial=0))):
        m = int(np.searchsorted(-lengths, -j, "left"))
        u, d, all_, end = up[:m], down[:m], full[:m], last[:m]
        match = where[rows[:m], read[begin[:m] + j]]
        same = match | d
        flat = (((match & u) + u) ^ u) | match
        rise = d | ~(flat | u) & all_
        fall = u & flat
        edits[:m] += ((rise & end) != 0).astype(np.int64) - ((fall & end) != 0)
        # a substring may begin anywhere: nothing is carried into the first row
        rise, fall = (rise << one) & all_, (fall << one) & all_
        up[:m], down[:m] = fall | ~(same | rise) & all_, rise & same
        np.minimum(best[:m], edits[:m], out=best[:m])
    return best


def _candidates(values: list[str], text: str) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of what is to be verified: the whole of a short text, stretches of a long one."""
    if len(text) * sum(map(len, values)) <= WHOLE:
        yield from ((v, 0, len(text)) for v, x in enumerate(values) if len(x) > 1)
    else:
        yield from _stretches(values, text)


def nearest_edits_of_rows(rows: Iterator[tuple[list[str], str]]) -> list[list[int | None]]:
    """``nearest_edits`` of many rows."""
    found: list[list[int | None]] = []
    pending: list[tuple[list[int | None], int, str, str]] = []
    waiting = 0

    def note(edits: list[int | None], v: int, value: str, n: int | None) -> None:
        if n is not None and n <= allowed(value) and (edits[v] is None or n < edits[v]):
            edits[v] = n

    def verify() -> None:
        nonlocal waiting
        for (edits, v, value, _), n in zip(pending, least_edits_of_pairs([p[2] for p in pending], [p[3] for p in pending]).tolist(), strict=True):
            note(edits, v, value, n)
        pending.clear()
        waiting = 0

    for values, text in rows:
        edits: list[int | None] = [0 if x and x in text else None for x in values]
        found.append(edits)
        for v, begin, end in _candidates(values, text):
            if edits[v] == 0:
                continue
            if len(values[v]) > WORD:
                note(edits, v, values[v], least_edits(values[v], text[begin:end], allowed(values[v])))
                continue
            pending.append((edits, v, values[v], text[begin:end]))
            waiting += end - begin
            if len(pending) >= MOST_PAIRS or waiting >= MOST_CHARS:
                verify()
    verify()
    return found


def nearest_edits(values: list[str], text: str) -> list[int | None]:
    """For each value (letters and digits, as ``plain`` leaves them) the least edits to a substring of the text, None above what is allowed."""
    return nearest_edits_of_rows(iter([(values, text)]))[0]


def _near(texts: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series(nearest_edits_of_rows((list(v), t) for t, v in zip(texts, values, strict=True)), dtype=object)


def fuzzy_distances(gold: DataFrame, texts: DataFrame, key: str = "doc_id", value: str = "value", columns: tuple[str, ...] = ("before", "after")) -> DataFrame:
    """The distinct (key, value) of ``gold`` with ``<column>_edits`` for each text column: the least edits, null above what is allowed.

    A value without letters and digits is near nothing, a null text holds nothing, rows of gold without a text (or null key) go. Of
    texts that share a key the nearest counts.
    """
    own = gold.select(F.col(key).alias("k"), F.col(value).alias("v")).filter("v IS NOT NULL").distinct()
    counts = own.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    parted = own.join(counts, "k").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    lists = parted.groupBy("k", "part").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    facts = texts.select(F.col(key).alias("k"), *[plain(F.col(c)).alias(f"_t{i}") for i, c in enumerate(columns)])
    near = F.pandas_udf(_near, "array<int>")
    joined = lists.join(facts, "k").withColumn("_p", F.transform("vs", plain))
    for i in range(len(columns)):
        joined = joined.withColumn(f"_e{i}", near(f"_t{i}", "_p"))
    spread = joined.select("k", F.inline(F.arrays_zip("vs", *[f"_e{i}" for i in range(len(columns))])))
    return spread.groupBy(F.col("k").alias(key), F.col("vs").alias(value)).agg(*[F.min(f"_e{i}").alias(f"{c}_edits") for i, c in enumerate(columns)])


def mask_windows(text: Column, sample: Column) -> Column:
    """All windows of a text that a mask may stand for: its first two and last two characters and its length. Masks of four or fewer characters show nothing."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    inner = F.concat(F.lit(".{"), (F.length(sample) - 4).cast("string"), F.lit("}"))
    pattern = F.concat(F.lit("(?s)(?=("), quoted(F.left(sample, F.lit(2))), inner, quoted(F.right(sample, F.lit(2))), F.lit("))"))
    shown = (F.length(sample) > 4) & ~F.contains(sample, F.lit("\\E"))
    return F.when(shown, F.regexp_extract_all(text, pattern, F.lit(1))).otherwise(F.array().cast("array<string>"))


def covered(value: Column, text: Column, samples: Column) -> Column:
    """Whether one of the masks stands for a window of the text that is near the value."""
    own = plain(value)
    most = F.floor(F.length(own) / CHARS_PER_EDIT).cast("int")
    return F.exists(samples, lambda s: F.exists(mask_windows(text, s), lambda w: F.levenshtein(plain(w), own) <= most))


def fuzzy_outcomes(gold: DataFrame, results: DataFrame, key: str = "doc_id", value: str = "value", before: str = "text", after: str = "redacted",
                   report: str = "report") -> DataFrame:
    """``gold`` with ``outcome`` and the two distances.

    not read: nothing near the value is in the text that was read. redacted: nothing near it is left. flagged: it is left, and the mask
    of a suspect stands for it. lost: it is left and nobody says so.
    """
    samples = F.transform(f"{report}.suspects", lambda s: s.sample)
    # written: distances and masks both read it, and redaction should run once
    texts = written(results.select(F.col(key), F.col(before), F.col(after), samples.alias("_samples")), "fuzzy")
    near = fuzzy_distances(gold, texts, key, value, (before, after))
    facts = texts.select(F.col(key).alias("_k"), F.col(after).alias("_after"), "_samples")
    judged = gold.join(near, [key, value]).join(facts, F.col(key) == F.col("_k"))
    flagged = F.coalesce(covered(F.col(value), F.col("_after"), F.col("_samples")), F.lit(False))
    outcome = (
        F.when(F.col(f"{before}_edits").isNull(), "not read").when(F.col(f"{after}_edits").isNull(), "redacted").when(flagged, "flagged").otherwise("lost")
    )
    return judged.withColumn("outcome", outcome).drop("_k", "_after", "_samples")
