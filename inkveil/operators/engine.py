"""The redaction engine: an ordered program of steps over a text column.

A step marks its candidates (a pattern proposes), splits the text at the marks and judges every
candidate with its surroundings (a check or the context decides): replace, only detect, suspect or
leave. Each step is two projections of built-in expressions and the text is read as it enters the
step, so placeholders of earlier steps are seen by later ones. Nothing is shuffled: a document stays
in its row, and the chain grows linearly because no expression refers to a long one twice.

Inside the chain a placeholder is ``{{LABEL`` + U+E012 + reference + ``}}``; ``finish`` turns the
references into numbers by first appearance for each label of the document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .options import Options

OPEN, CLOSE, REF = "\ue010", "\ue011", "\ue012"
SHIELD_OPEN, SHIELD_CLOSE = "\ue013", "\ue014"
_PRIVATE = f"[{OPEN}-{SHIELD_CLOSE}]"
#: How all of them begin in UTF-8.
_PRIVATE_BYTES = bytearray(OPEN.encode()[:2])
_NOTE = "array<struct<ref:string,kind:string,label:string,key:string,sample:string,decision:string,why:string,size:int,inner:array<string>>>"


_ANY_REF = r"\{\{[A-Z_]+" + REF + r"([a-j.]+)\}\}"


@dataclass(frozen=True)
class Candidate:
    """A marked value, the text before and after it (as it enters the step)."""

    value: Column
    before: Column
    after: Column

    def context(self, chars: int) -> Column:
        return F.right(self.before, F.lit(chars))

    def follows(self, chars: int) -> Column:
        return F.left(self.after, F.lit(chars))


@dataclass(frozen=True)
class Verdict:
    """decision: replace, detect, suspect or leave. head and tail are given back around the value."""

    decision: Column
    value: Column
    head: Column | None = None
    tail: Column | None = None
    label: Column | None = None
    kind: Column | None = None
    why: Column | None = None
    key: Column | None = None


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Bound:
    """A verdict over a value that is computed once."""

    value: Column
    use: Callable[[Column], Verdict]


@dataclass(frozen=True)
class Step:
    name: str
    kind: str
    label: str
    pack: str
    switch: str
    priority: int
    pattern: str = ""
    judge: Callable[[Candidate, Options], Verdict | Bound] | None = None
    #: The pattern's first group stays in the text, the second is the value.
    labelled: bool = False
    #: Marks candidates in another way than by the pattern; null for a text without any.
    mark: Callable[[Column, Options], Column] | None = None
    #: What a text must have for the step to find anything: one of each group. A word is looked for in small letters, ``=Word`` as it is
    #: written, ``re:...`` as a pattern in small letters; ``{{LABEL`` is a placeholder of an earlier step. A text without it is passed over.
    #: A group of which all conditions are ``quick`` is looked at first: the others are looked for only in texts that meet it.
    needs: tuple[tuple[str, ...], ...] = ()
    #: False: the judge only detects, suspects or leaves its whole candidates, so the text stays as it is.
    replaces: bool = True

    def conditions(self) -> list[str]:
        return [x for group in self.needs for x in group if not x.startswith("{{")]

    def wanted(self, known: dict[str, int]) -> Column | None:
        """Whether a text has what the step needs; ``known``: the bit of each condition in ``_has``."""
        tests = [any_of(group, known) for group in self.needs]
        return reduce(and_, tests) if tests else None

    def marked(self, text: Column, options: Options) -> Column:
        if self.mark is not None:
            return self.mark(text, options)
        return F.regexp_replace(text, self.pattern, f"$1{OPEN}$2{CLOSE}" if self.labelled else f"{OPEN}$0{CLOSE}")


def always(c: Candidate, options: Options) -> Verdict:
    return Verdict(F.lit("replace"), c.value)


def when(condition: Callable[[Candidate], Column], otherwise: str = "leave", why: str | None = None):
    """A judge that replaces where the condition holds."""

    def judge(c: Candidate, options: Options) -> Verdict:
        decision = F.when(F.coalesce(condition(c), F.lit(False)), F.lit("replace")).otherwise(F.lit(otherwise))
        return Verdict(decision, c.value, why=F.lit(why) if why else None)

    return judge


def normal_key(value: Column) -> Column:
    """Values that differ only in case, blanks and punctuation are one value."""
    return F.lower(F.regexp_replace(value, r"(?U)[^\p{L}\p{N}]", ""))


def mask(value: Column) -> Column:
    """A sample that shows the first two and last two characters; short values show none."""
    v = F.btrim(value, F.lit(" \t\n\r"))
    n = F.length(v)
    return F.when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.left(v, F.lit(2)), F.repeat(F.lit("•"), n - 4), F.right(v, F.lit(2))))


def begin(df: DataFrame, text: str) -> DataFrame:
    """Working columns; characters that the engine uses itself are taken out of the input."""
    own = F.contains(F.col(text).cast("binary"), F.lit(_PRIVATE_BYTES))
    cleared = F.when(own, F.regexp_replace(F.col(text), _PRIVATE, "")).otherwise(F.col(text))
    return df.withColumn("_text", cleared).withColumn("_notes", F.array().cast(_NOTE))


#: Letters that match another one when case is ignored, though small letters differ.
_FOLDED = ("ſıİK", "siik")
#: Bits of a long.
MOST_CONDITIONS = 62
#: A digit of any script.
DIGIT = r"re:\p{Nd}"
#: 15 letters and digits in a row, listed one by one: so they are looked up in one table.
LONG_WORD = "re:[0123456789abcdefghijklmnopqrstuvwxyz]{15}"


def quick(x: str) -> bool:
    """Conditions that cost little: one or two characters, words with a capital, a digit, a long word."""
    return x in (DIGIT, LONG_WORD) or x.startswith("=") or len(x) <= 2


def find_conditions(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, tuple[tuple[str, int], ...]]:
    """``df`` with ``_has`` (longs with a bit for each condition that the text meets) and the place of each condition.

    Looking for a word is much cheaper than a pattern with its surroundings, and most texts have few of the words. Quick conditions
    come first; a word is looked for only where the quick groups of one of its steps are met, since no step asks for its bit elsewhere.
    """
    conditions = list(dict.fromkeys(x for s in steps for x in s.conditions()))
    first = [x for x in conditions if quick(x)]
    known = {x: i for i, x in enumerate(first)}
    guards: dict[str, frozenset] = {}
    for x in conditions:
        if x not in known:
            groups = [[g for g in s.needs if all(map(quick, g))] for s in steps if x in s.conditions()]
            guards[x] = frozenset() if not all(groups) else frozenset(frozenset(frozenset(g) for g in own) for own in groups)
    # words behind the same guard stand together
    order = sorted(guards, key=lambda x: sorted(sorted(map(sorted, own)) for own in guards[x]))
    at = -(-len(first) // MOST_CONDITIONS) * MOST_CONDITIONS
    known |= {x: at + i for i, x in enumerate(order)}

    def met(x: str) -> Column:
        if x.startswith("re:"):
            return F.col("_low").rlike(x[3:])
        return F.contains("_text", F.lit(x[1:])) if x.startswith("=") and x != "=" else F.contains("_low", F.lit(x))

    def bits(own: list[str]) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(met(x), F.lit(1 << known[x] % MOST_CONDITIONS).cast("long")).otherwise(F.lit(0).cast("long")) for x in own])

    def guarded(own: list[str]) -> Column:
        column = None
        for guard in dict.fromkeys(guards[x] for x in own):
            found = bits([x for x in own if guards[x] == guard])
            if guard:
                tests = [reduce(and_, [any_of(g, known) for g in sorted(map(sorted, groups))]) for groups in guard]
                found = F.when(reduce(or_, tests), found).otherwise(F.lit(0).cast("long"))
            column = found if column is None else column.bitwiseOR(found)
        return column

    odd = reduce(or_, [F.contains("_text", F.lit(x)) for x in _FOLDED[0]])
    work = df.withColumn("_low", F.lower(F.when(odd, F.translate("_text", *_FOLDED)).otherwise(F.col("_text"))))
    for use, own in ((bits, first), (guarded, order)):
        slices = [own[i : i + MOST_CONDITIONS] for i in range(0, len(own), MOST_CONDITIONS)]
        work = work.withColumns({f"_has{known[x[0]] // MOST_CONDITIONS}": use(x) for x in slices}) if slices else work
    return work.drop("_low"), tuple(known.items())


def any_of(group: Iterable[str], known: dict[str, int]) -> Column:
    """Whether a text meets one of the conditions; ``known``: the bit of each in ``_has``."""
    masks: dict[int, int] = {}
    for place in (known[x] for x in group if x in known):
        masks[place // MOST_CONDITIONS] = masks.get(place // MOST_CONDITIONS, 0) | 1 << place % MOST_CONDITIONS
    words = [F.col(f"_has{i}").bitwiseAND(F.lit(m).cast("long")) != 0 for i, m in masks.items()]
    return reduce(or_, [*words, *[F.contains("_text", F.lit(x)) for x in group if x.startswith("{{")]])


@lru_cache(maxsize=512)
def _step_columns(step: Step, number: int, options: Options, known: tuple[tuple[str, int], ...] = ()) -> tuple[Column, Column, Column, Column]:
    """The step's expressions: parts, judged parts, new text, what to note. Built once for equal options."""

    empty, null = F.lit(""), F.lit(None).cast("string")

    def told_of(v: Verdict) -> Column:
        kind = v.kind if v.kind is not None else F.lit(step.kind)
        decision = v.decision
        if options.detect_only:
            decision = F.when((decision == "replace") & kind.isin(*options.detect_only), F.lit("detect")).otherwise(decision)
        return F.struct(
            decision.alias("decision"),
            (v.head if v.head is not None else empty).alias("head"),
            v.value.alias("value"),
            (v.tail if v.tail is not None else empty).alias("tail"),
            (v.label if v.label is not None else F.lit(step.label)).alias("label"),
            kind.alias("kind"),
            (v.why if v.why is not None else null).alias("why"),
            (v.key if v.key is not None else v.value).alias("key"),
        )

    def judged(x: Column, i: Column) -> Column:
        before = F.concat(*[F.coalesce(F.get("_parts", i - k), F.lit("")) for k in (4, 3, 2, 1)])
        after = F.concat(*[F.coalesce(F.get("_parts", i + k), F.lit("")) for k in (1, 2, 3)])
        v = step.judge(Candidate(x, before, after), options)
        yes = bound(v.value, lambda b: told_of(v.use(b))) if isinstance(v, Bound) else told_of(v)
        no = F.struct(
            F.lit("text").alias("decision"), empty.alias("head"), x.alias("value"), empty.alias("tail"),
            null.alias("label"), null.alias("kind"), null.alias("why"), null.alias("key"),
        )
        return F.when(i % 2 == 1, yes).otherwise(no)

    # references are letters, which no later step takes for a number
    ref = lambda i: F.translate(F.concat(F.lit(f"{number}."), i.cast("string")), "0123456789", "abcdefghij")
    rewritten = F.array_join(
        F.transform(
            "_judged",
            lambda v, i: F.when(
                v.decision == "replace", F.concat(v.head, F.lit("{{"), v.label, F.lit(REF), ref(i), F.lit("}}"), v.tail)
            ).otherwise(F.concat(v.head, v.value, v.tail)),
        ),
        "",
    )
    told = F.transform(
        F.filter(
            F.transform("_judged", lambda v, i: F.struct(ref(i).alias("ref"), v.alias("v"))),
            lambda x: ~x.v.decision.isin("text", "leave"),
        ),
        lambda x: F.struct(
            x.ref.alias("ref"), x.v.kind.alias("kind"), x.v.label.alias("label"), normal_key(x.v.key).alias("key"),
            mask(x.v.value).alias("sample"), x.v.decision.alias("decision"), x.v.why.alias("why"),
            # characters of the value, but for the placeholders inside it, and which those are
            F.length(F.regexp_replace(x.v.value, _ANY_REF, "")).alias("size"), F.regexp_extract_all(x.v.value, F.lit(_ANY_REF), F.lit(1)).alias("inner"),
        ),
    )
    found = F.size("_judged") > 1
    parts = F.split(step.marked(F.col("_text"), options), f"[{OPEN}{CLOSE}]")
    wanted = step.wanted(dict(known)) if known else None
    return (
        parts if wanted is None else F.when(wanted, parts),
        F.transform("_parts", judged),
        F.when(found, rewritten).otherwise(F.col("_text")).alias("_text") if step.replaces else F.col("_text"),
        F.when(found, F.concat("_notes", told)).otherwise(F.col("_notes")).alias("_notes"),
    )


def apply_step(df: DataFrame, step: Step, number: int, options: Options, known: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Run one step over ``_text`` and add what it decided to ``_notes``."""
    parts, judged, text, notes = _step_columns(step, number, options, known)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("_text", "_notes")]
    return df.withColumn("_parts", parts).withColumn("_judged", judged).select(*kept, text, notes)


def term_pattern(values: tuple[str, ...]) -> str:
    """Whole terms, case ignored, any horizontal blanks between their words."""
    one = [r"[ \t ]+".join(re.escape(w).replace("\\ ", " ") for w in v.split()) for v in values]
    return r"(?iU)(?<![\w])(?:" + "|".join(one) + r")(?![\w])"


def shield(df: DataFrame, options: Options) -> DataFrame:
    """Hide the terms that must never be touched."""
    if not options.never:
        return df
    pattern = term_pattern(options.never)
    hidden = df.withColumn("_shield", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    gaps = hidden.withColumn("_gaps", F.split("_text", pattern))
    joined = F.array_join(
        F.transform("_gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(SHIELD_OPEN), i.cast("string"), F.lit(SHIELD_CLOSE), g))), ""
    )
    return gaps.withColumn("_text", joined).drop("_gaps")


def unshield(df: DataFrame, options: Options) -> DataFrame:
    if not options.never:
        return df
    split = df.withColumn("_pieces", F.split("_text", f"[{SHIELD_OPEN}{SHIELD_CLOSE}]"))
    back = F.array_join(F.transform("_pieces", lambda p, i: F.when(i % 2 == 1, F.get("_shield", p.cast("int") - 1)).otherwise(p)), "")
    return split.withColumn("_text", back).drop("_pieces", "_shield")


_PLACEHOLDER = re.compile(r"\{\{([A-Z_]+)" + REF + r"([a-j.]+)\}\}")


def _number(text: str, refs: list[str], keys: list[str]) -> str:
    """Placeholders with numbers: one for each (label, key), counted for each label by first appearance."""
    of, seen, count = dict(zip(refs, keys, strict=True)), {}, {}

    def numbered(m: re.Match) -> str:
        own = (m[1], of.get(m[2], m[2]))
        if own not in seen:
            seen[own] = count[m[1]] = count.get(m[1], 0) + 1
        return "{{%s_%d}}" % (m[1], seen[own])

    return _PLACEHOLDER.sub(numbered, text)


def _places(text: str, refs: list[str], sizes: list[int], inner: list[list[str]]) -> dict[str, tuple[int, int]]:
    """Where in the original text the value of each placeholder lies: pieces between placeholders are copies, values have known sizes."""
    own, within = dict(zip(refs, sizes, strict=True)), dict(zip(refs, inner, strict=True))

    def size(ref: str) -> int:
        return own.get(ref, 0) + sum(size(r) for r in within.get(ref, ()))

    at, last, found = 0, 0, {}
    for m in _PLACEHOLDER.finditer(text):
        at += m.start() - last
        n = size(m[2])
        found[m[2]] = (at, at + n)
        at, last = at + n, m.end()
    return found


def _spans(text: pd.Series, refs: pd.Series, sizes: pd.Series, inner: pd.Series) -> pd.Series:
    """For each note its span in the original text; null for what is not replaced or lies inside another value."""
    out = []
    for t, r, s, i in zip(text, refs, sizes, inner, strict=True):
        found = {} if t is None else _places(t, r, s, i)
        out.append([None if ref not in found else {"start": found[ref][0], "end": found[ref][1]} for ref in r])
    return pd.Series(out, dtype=object)


#: Rows whose texts an Arrow function holds as Python's own strings at once.
PIECE = 128


def by_pieces(use: Callable[..., str | None], batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """``use`` of each row, given out in pieces of a few rows: beside the batch that came in nothing of its size is held."""
    for columns in batches:
        for at in range(0, len(columns[0]), PIECE):
            own = [c.slice(at, PIECE).to_pylist() for c in columns]
            yield pa.array([use(*row) for row in zip(*own, strict=True)], pa.string())


def finish(df: DataFrame, options: Options) -> DataFrame:
    """Numbers for the placeholders: by first appearance, for each label. Linear in the findings of a text.

    Ranks need a memory of what was seen, which expressions over arrays only have at a quadratic cost; so texts with
    placeholders, and they alone, go through an Arrow function.
    """
    if not options.numbered:
        return df.withColumn("_text", F.regexp_replace("_text", REF + r"[a-j.]+\}\}", "}}"))

    @F.arrow_udf("string")
    def number(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return by_pieces(lambda t, r, k: None if t is None else _number(t, r, k), batches)

    replaced = df.withColumn("_found", F.filter("_notes", lambda n: n.decision == "replace"))
    some = F.when(F.size("_found") > 0, F.col("_text"))
    listed = [F.when(F.size("_found") > 0, F.col(f"_found.{c}")) for c in ("ref", "key")]
    return replaced.withColumn("_text", F.coalesce(number(some, *listed), F.col("_text"))).drop("_found")


def report_column() -> Column:
    """counts, total, suspects, detected of the notes."""
    kinds = lambda d: F.transform(F.filter("_notes", lambda n: n.decision == d), lambda n: n.kind)

    def tally(d: str) -> Column:
        own = kinds(d)
        entries = F.transform(F.array_sort(F.array_distinct(own)), lambda k: F.struct(k, F.size(F.filter(own, lambda x: x == k))))
        return F.map_from_entries(entries)

    suspects = F.transform(F.filter("_notes", lambda n: n.decision == "suspect"), lambda n: F.struct(n.kind.alias("kind"), n.sample.alias("sample"), n.why.alias("why")))
    detected = F.transform(F.filter("_notes", lambda n: n.decision == "detect"), lambda n: F.struct(n.kind.alias("kind"), n.sample.alias("sample")))
    return F.struct(
        tally("replace").alias("counts"), F.size(kinds("replace")).alias("total"), suspects.alias("suspects"), F.size(suspects).alias("suspects_total"),
        detected.alias("detected"), tally("detect").alias("detected_counts"), F.size(detected).alias("detected_total"),
    )


def program(options: Options, steps: list[Step] | None = None) -> list[Step]:
    """Steps whose pack and switch are on, in a stable order of priority."""
    from .steps import STEPS

    chosen = [s for s in (steps or STEPS) if s.pack in options.packs and getattr(options, s.switch)]
    return sorted(chosen, key=lambda s: s.priority)


def step_number(step: Step) -> int:
    """A number of its own for each step, so that references never clash."""
    from .steps import STEPS, SUSPECT_STEPS

    known = [s.name for s in [*STEPS, *SUSPECT_STEPS]]
    return 1 + known.index(step.name) if step.name in known else 1000 + zlib.crc32(step.name.encode()) % 9000


def redact(df: DataFrame, text: str = "text", options: Options | None = None, steps: list[Step] | None = None,
           into: str = "redacted", report: str = "report") -> DataFrame:
    """``df`` with the redacted text and its report.

    A null text stays null with an empty report; an empty text is unchanged. Switches, packs and
    lists are resolved here, so that steps that are off are not part of the plan.
    """
    options = options or Options()
    if not options.any_switch():
        return begin(df, text).withColumn(into, F.col(text)).withColumn(report, report_column()).drop("_text", "_notes")
    work = unshield(_decided(df, text, options, steps), options)
    # where no step replaces there is no placeholder to number, and no row has to go through a function
    if options.always or any(s.replaces for s in program(options, steps)):
        work = finish(work, options)
    return work.withColumn(into, F.col("_text")).withColumn(report, report_column()).drop("_text", "_notes")


def _decided(df: DataFrame, text: str, options: Options, steps: list[Step] | None) -> DataFrame:
    """The working columns after the terms, the steps and (for the whole program) the suspects."""
    from .steps import SUSPECT_STEPS

    chosen = program(options, steps)
    chosen += [s for s in SUSPECT_STEPS if steps is None and s.pack in options.packs]
    work = shield(begin(df, text), options)
    if options.always:
        own = Step("terms", "terms", "TERM", "CORE", "names", 0, term_pattern(options.always), always)
        work = apply_step(work, own, 0, options)
    work, known = find_conditions(work, chosen)
    for step in chosen:
        work = apply_step(work, step, step_number(step), options, known)
    return work.drop(*[c for c in work.columns if c.startswith("_has")])


def annotations(df: DataFrame, key: str, text: str = "text", options: Options | None = None, steps: list[Step] | None = None,
                keep: tuple[str, ...] = (), places: bool = False) -> DataFrame:
    """What ``redact`` decides, as rows: key, the columns ``keep``, ref, kind, label, value_key, sample, decision, why.

    With ``places`` also start and end: the characters of the original text that a placeholder stands for, counted from 0, the end
    excluded. They are null for what stays in the text. Characters that the engine takes out of the input do not count.
    """
    options = options or Options()
    given = [*dict.fromkeys([key, *keep])]
    if not options.any_switch():
        work = begin(df, text)
    else:
        work = unshield(_decided(df, text, options, steps), options)
    told = F.col("_notes")
    if places:
        some = F.when(F.exists("_notes", lambda n: n.decision == "replace"), F.col("_text"))
        work = work.withColumn("_spans", F.pandas_udf(_spans, "array<struct<start:int,end:int>>")(some, *[F.col(f"_notes.{c}") for c in ("ref", "size", "inner")]))
        told = F.zip_with("_notes", "_spans", lambda n, s: n.withField("start", s.start).withField("end", s.end))
    # an outer explode: the optimizer would copy the filter of a plain one through all steps, whose expressions then grow without end
    found = work.select(*given, F.explode_outer(told).alias("n")).filter("n IS NOT NULL")
    return found.select(
        *given, "n.ref", "n.kind", "n.label", F.col("n.key").alias("value_key"), "n.sample", "n.decision", "n.why", *(["n.start", "n.end"] if places else [])
    )


def flatten_numbers(text: Column) -> Column:
    """``{{LABEL_3}}`` becomes ``{{LABEL}}``."""
    return F.regexp_replace(text, r"\{\{([A-Z]+(?:_[A-Z]+)*)_[0-9]+\}\}", "{{$1}}")
