"""Spans of text: found again from a redacted text, freed of overlaps, and met with the nearest label. All in characters from 0, ends excluded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .engine import Step, flatten_numbers, redact
from .options import Options
from .tables import dealt, written

_PLACEHOLDER = re.compile(r"\{\{([A-Z]+(?:_[A-Z]+)*)(?:_\d+)?\}\}")
#: Places of the next literal piece that are tried for a value; starts of a value that are followed at once.
TRIES, WIDTH = 12, 144
_WAY = "array<struct<gap:int,start:int,end:int,label:string,piece:string>>"
_SPAN = "array<struct<start:int,end:int,label:string>>"


# ---- spans from a redacted text


def _pieces(redacted: str) -> tuple[list[str], list[str]]:
    """Literal pieces, one more than the labels between them. Placeholders that touch are one gap with all their labels."""
    literals, labels, last = [], [], 0
    for m in _PLACEHOLDER.finditer(redacted):
        if labels and m.start() == last:
            labels[-1] += "+" + m[1]
        else:
            literals.append(redacted[last : m.start()])
            labels.append(m[1])
        last = m.end()
    return [*literals, redacted[last:]], labels


Way = tuple[int, int, int, str, str]


def first_way(text: str | None, redacted: str | None) -> list[Way]:
    """(gap, start, end, label, piece) with each literal piece at its first place behind the one before; as far as that goes."""
    if text is None or redacted is None:
        return []
    literals, labels = _pieces(redacted)
    if not labels or not text.startswith(literals[0]):
        return []
    ways, start = [], len(literals[0])
    for gap, (label, literal) in enumerate(zip(labels, literals[1:], strict=True)):
        last = gap == len(labels) - 1
        end = len(text) - len(literal) if last else text.find(literal, start + 1)
        if end <= start or (last and not text.endswith(literal)):
            break
        ways.append((gap, start, end, label, text[start:end]))
        start = end + len(literal)
    return ways


def more_ways(text: str | None, redacted: str | None, sure: list[bool]) -> list[Way]:
    """All ways through the gaps that the first way did not settle; ``sure`` tells which of its pieces the engine confirms.

    A confirmed piece stays where it is. Between two of them every place of a literal piece among the next ``TRIES`` is followed, from at most
    ``WIDTH`` starts of a gap, and what does not lead to the next confirmed piece (or the end of the text) is left out.
    """
    first = first_way(text, redacted)
    if not first:
        return []
    literals, labels = _pieces(redacted)
    sure = [s for s, _ in zip(sure, first, strict=False)] + [False] * (len(labels) - len(first))
    out, gap = [], 0
    while gap < len(labels):
        if sure[gap]:
            out.append(first[gap])
            gap += 1
            continue
        stop = gap
        while stop < len(labels) and not sure[stop]:
            stop += 1
        start = first[gap][1] if gap < len(first) else first[-1][2] + len(literals[len(first)])
        if gap and sure[gap - 1]:
            start = first[gap - 1][2] + len(literals[gap])
        goal = first[stop][1] if stop < len(labels) else len(text)
        out += _between(text, literals, labels, gap, stop, start, goal)
        gap = stop
    return out


def _between(text: str, literals: list[str], labels: list[str], gap: int, stop: int, start: int, goal: int) -> list[Way]:
    reached, steps = [start], []
    for g in range(gap, stop):
        literal, found = literals[g + 1], []
        for begin in reached:
            if g == stop - 1:
                # the last literal piece ends where the goal begins
                end = goal - len(literal)
                found += [(g, begin, end)] if end > begin and text.startswith(literal, end) else []
                continue
            at = begin
            for _ in range(TRIES):
                at = text.find(literal, at + 1, goal)
                if at < 0:
                    break
                found.append((g, begin, at))
        steps.append(found)
        reached = sorted({end + len(literal) for _, _, end in found})[:WIDTH]
    alive, kept = {goal}, []
    for g, found in zip(range(stop - 1, gap - 1, -1), reversed(steps), strict=True):
        good = [x for x in found if x[2] + len(literals[g + 1]) in alive]
        alive = {x[1] for x in good}
        kept += good
    return [(g, s, e, labels[g], text[s:e]) for g, s, e in sorted(kept)]


def choose(ways: list[tuple[int, int, int, str, bool]], lengths: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the way with the fewest pieces that the engine does not confirm, then with the earliest ends.

    ``ways`` has (gap, start, end, label, confirmed), ``lengths`` those of the literal pieces.
    """
    gaps = len(lengths) - 1
    by_gap: list[dict[int, list]] = [{} for _ in range(gaps)]
    for gap, start, end, label, sure in ways:
        by_gap[gap].setdefault(start, []).append((end, label, sure))
    # from the last gap on: how many pieces stay unconfirmed at least behind each start
    cost: list[dict[int, int]] = [{} for _ in range(gaps)]

    def least(gap: int, end: int, sure: bool) -> int | None:
        rest = 0 if gap == gaps - 1 else cost[gap + 1].get(end + lengths[gap + 1])
        return None if rest is None else rest + (not sure)

    for gap in range(gaps - 1, -1, -1):
        for start, own in by_gap[gap].items():
            totals = [c for end, _, sure in own if (c := least(gap, end, sure)) is not None]
            if totals:
                cost[gap][start] = min(totals)
    chain, start = [], lengths[0]
    for gap in range(gaps):
        if start not in cost[gap]:
            return []
        end, label = min((end, label) for end, label, sure in by_gap[gap][start] if least(gap, end, sure) == cost[gap][start])
        chain.append((start, end, label))
        start = end + lengths[gap + 1]
    return chain


def _told(ways: list[Way]) -> list[dict]:
    return [dict(zip(("gap", "start", "end", "label", "piece"), x, strict=True)) for x in ways]


def _first(text: pd.Series, redacted: pd.Series) -> pd.Series:
    return pd.Series([_told(first_way(t, r)) for t, r in zip(text, redacted, strict=True)], dtype=object)


def _more(text: pd.Series, redacted: pd.Series, ways: pd.Series) -> pd.Series:
    """The first way where it is confirmed, and all ways for what it leaves open."""
    out = []
    for t, r, own in zip(text, redacted, ways, strict=True):
        sure = [w["sure"] for w in sorted(own, key=lambda w: w["gap"])]
        out.append(_told(more_ways(t, r, sure)))
    return pd.Series(out, dtype=object)


def _chosen(redacted: pd.Series, ways: pd.Series) -> pd.Series:
    out = []
    for r, own in zip(redacted, ways, strict=True):
        found = choose([(w["gap"], w["start"], w["end"], w["label"], w["sure"]) for w in own], [len(x) for x in _pieces(r)[0]])
        out.append([{"start": a, "end": b, "label": label} for a, b, label in found])
    return pd.Series(out, dtype=object)


def _judged(rows: DataFrame, options: Options, steps: list[Step] | None) -> DataFrame:
    """Rows (id, t, r, ways) with the engine's word on each way: it sees every distinct piece once."""
    rows = written(rows, "ways")
    ways = rows.select("id", F.explode("ways").alias("w")).withColumn("bare", F.btrim("w.piece"))
    seen = redact(ways.select("bare").distinct(), "bare", options, steps).select("bare", flatten_numbers(F.col("redacted")).alias("as"))
    seen = written(seen, "seen")
    expected = F.concat(F.lit("{{"), F.replace(F.col("w.label"), F.lit("+"), F.lit("}}{{")), F.lit("}}"))
    marked = ways.join(seen, "bare").select("id", F.struct("w.gap", "w.start", "w.end", "w.label", (F.col("as") == expected).alias("sure")).alias("w"))
    return rows.drop("ways").join(marked.groupBy("id").agg(F.collect_list("w").alias("ways")), "id")


def recover_spans(df: DataFrame, key: str, text: str = "text", redacted: str = "redacted", options: Options | None = None,
                  steps: list[Step] | None = None) -> DataFrame:
    """(key, start, end, label): which characters of the text each placeholder of the redacted text stands for, from the two texts alone.

    What lies between placeholders is a copy and serves as an anchor. First every anchor is put at its first place, and the engine (with
    the same options and steps) looks at the pieces this would cut: one that it replaces whole by the same placeholder is confirmed.
    An anchor may also lie inside a value, so between confirmed pieces the other places of the anchors are followed, and the
    way with the fewest unconfirmed pieces wins, then the one with the earliest ends. The engine sees all distinct pieces of all documents
    at once, twice. Placeholders that touch are one span, their labels joined by ``+``. Texts that do not fit together have no spans,
    nor has a null. Rows may share a key.
    """
    options = options or Options()
    # written first: a filter on a redacted text would be copied into all steps that made it
    given = written(df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(redacted).alias("r")), "texts")
    rows = given.filter(F.contains("r", F.lit("{{"))).withColumn("id", F.struct("k", "t", "r")).withColumn("id", F.sha2(F.to_json("id"), 256)).dropDuplicates(["id"])
    first = _judged(rows.withColumn("ways", F.pandas_udf(_first, _WAY)("t", "r")), options, steps)
    more = _judged(first.withColumn("ways", F.pandas_udf(_more, _WAY)("t", "r", "ways")), options, steps)
    return more.select(F.col("k").alias(key), F.inline(F.pandas_udf(_chosen, _SPAN)("r", "ways")))


# ---- overlaps


def keep_first(spans: Column) -> Column:
    """Of an array of structs with start and end those that a sweep keeps: by start, then end, each that begins no earlier than the last kept one ends."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.end - b.end).cast("int"))
    kind = F.filter(spans, lambda s: F.lit(False))

    def add(state, s):
        return F.when(s.start >= state["last"], F.struct(s.end.cast("long").alias("last"), F.array_append(state["kept"], s).alias("kept"))).otherwise(state)

    start = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), kind.alias("kept"))
    return F.aggregate(ordered, start, add, lambda state: state["kept"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps rows of batches sorted by key, start and end; remembers one key and one end."""
    key, last = object(), 0
    for batch in batches:
        keep = []
        for k, start, end in zip(*(batch.column(c).to_pylist() for c in ("_key", "_start", "_end")), strict=True):
            if k != key:
                key, last = k, start
            keep.append(start >= last)
            if keep[-1]:
                last = end
        yield batch.filter(pa.array(keep))


def resolve_overlaps(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The rows of ``spans`` that a sweep keeps, for each ``key``: as ``keep_first``, in the long form.

    Rows are sorted, not collected: a task reads them in order and remembers one end, so a document may have any number of
    spans. Ties of start and end keep one row. Rows with a null start or end go; a null key is a key.
    """
    given = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    named = given.select("*", F.col(key).cast("string").alias("_key"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    rest = [c for c in spans.columns if c not in (key, start, end)]
    ordered = named.repartition("_key").sortWithinPartitions("_key", "_start", "_end", *rest)
    return ordered.mapInArrow(_sweep, named.schema).select(*spans.columns)


# ---- nearest labels

#: Characters of a document whose spans are put in one order by one task.
BLOCK = 128


def nearest_label(spans: DataFrame, labels: DataFrame, key: str, within: int, start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """``spans`` with ``label`` and ``label_gap``: the label of the same document that is nearest to the span, at most ``within`` characters off.

    Labels have a start and an end too. The gap is counted between the ends that face each other, 0 where they overlap; of two
    labels as near the one before the span wins, then the longer one, then the greater text. Spans without a start have no label, labels
    without a start or end are none.

    Both tables are put in one order for each block of ``BLOCK`` characters of a document, and the last label seen is carried along, forwards and
    backwards. What a block is told by those before and behind it is found from one row for each block, so a document may have any number
    of spans; no pairs of spans and labels are made. Both tables are read twice, and counted for the number of tasks.
    """
    block = F.floor(F.col("at") / BLOCK).alias("block")
    one = spans.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(start).cast("long").alias("at"), F.col(end).cast("long").alias("to"))
    two = labels.select(F.col(key).alias("k"), F.col(start).cast("long").alias("at"), F.col(end).cast("long").alias("to"), F.col(label).cast("string").alias("name"))
    two = two.filter("at IS NOT NULL AND to IS NOT NULL AND name IS NOT NULL")
    # before: of all labels that begin no later, the one that ends last; after: of those that begin later, the first to begin
    told = F.struct(F.col("to").alias("edge"), (-F.col("at")).alias("reach"), "name"), F.struct((-F.col("at")).alias("edge"), F.col("to").alias("reach"), "name")
    kind = "struct<edge:bigint,reach:bigint,name:string>"
    marks = two.select("k", block, "at", told[0].alias("mb"), told[1].alias("ma"))
    # one row for each block, and what those before and behind it hold
    blocks = marks.select("k", "block", "mb", "ma").unionByName(one.select("k", block).distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy("k", "block").agg(F.max("mb").alias("mb"), F.max("ma").alias("ma"))
    past = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("k").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.select("k", "block", F.max("mb").over(past).alias("mb"), F.max("ma").over(rest).alias("ma"))
    edges = told.select("k", "block", F.inline(F.array(
        F.struct((F.col("block") * BLOCK - 1).alias("at"), F.col("mb"), F.lit(None).cast(kind).alias("ma")),
        F.struct(((F.col("block") + 1) * BLOCK).alias("at"), F.lit(None).cast(kind).alias("mb"), F.col("ma")),
    )))
    given = marks.unionByName(edges).filter("mb IS NOT NULL OR ma IS NOT NULL").withColumn("what", F.lit(0))
    both = one.select("row", "k", block, "at", "to", F.lit(1).alias("what")).unionByName(given, allowMissingColumns=True)
    both = dealt(both, spans.count() + labels.count(), "k", "block")
    behind = Window.partitionBy("k", "block").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("k", "block").orderBy(F.col("at").desc(), F.col("what").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("b", F.max("mb").over(behind)).withColumn("a", F.max("ma").over(ahead)).filter("what = 1")
    before = F.when(F.col("b").isNotNull(), F.greatest(F.col("at") - F.col("b.edge"), F.lit(0)))
    after = F.when(F.col("a").isNotNull(), F.greatest(-F.col("a.edge") - F.col("to"), F.lit(0)))
    first = F.col("b").isNotNull() & (F.col("a").isNull() | (before <= after))
    gap = F.when(first, before).otherwise(after)
    near = gap <= within
    given = gap.cast(spans.schema[start].dataType)
    found = seen.select("row", F.when(near, F.when(first, F.col("b.name")).otherwise(F.col("a.name"))).alias("_label"), F.when(near, given).alias("_gap"))
    return found.select("row.*", F.col("_label").alias("label"), F.col("_gap").alias("label_gap"))
