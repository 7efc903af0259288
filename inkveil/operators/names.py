"""Names of persons. Rules that start from a label, a title or an address are expressions; runs of capitalised words and
single names are decided by the automaton of ``namegrammar`` in Arrow batches, which mark them for the engine's common steps.

The lexicon travels with the tasks. A larger one stays a table: ``with_lexicon`` gives each document the entries that
its words can make, and ``name_steps`` takes them from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import CLOSE, OPEN, Candidate, Step, Verdict, by_pieces
from .lexicon import Lexicon, with_classes
from .namegrammar import Grammar
from .options import Options

LEXICON = Lexicon()
_CAP = r"[A-ZÀ-Ý][a-zà-ÿ]+(?:['’-][A-ZÀ-Ý][a-zà-ÿ]+)*"
_TOKEN = rf"(?:[DL]['’])?{_CAP}|[A-ZÀ-Ý]\."
_NAME = rf"(?:{_TOKEN})(?:[ \t](?:(?:de|di|da|del|della|von|van|le|la)[ \t])?(?:{_TOKEN})){{0,3}}"
_STOP = "Sir|Madam|All|Team|Customer|Colleague|Colleagues|Friends|Mr|Mrs|Ms|Dr|Signore|Signora|Tutti|Cliente|Colleghi"


def mark_names(text: str | None, prose: bool | None, alone: bool, grammar: Grammar) -> str | None:
    """Names between marks; suspected ones carry a question mark after the opening mark."""
    if not text or not grammar.may_hold(text):
        return text
    out, last = [], 0
    for f in grammar.find(text, prose, alone):
        out += [text[last : f.start], OPEN, "?" if f.decision == "suspect" else "", text[f.start : f.end], CLOSE]
        last = f.end
    return "".join([*out, text[last:]])


def _marked(text: str | None, options: Options, grammar: Grammar) -> str | None:
    """The text with its names marked, or null if it has none: a text that stays as it is need not come back."""
    marked = mark_names(text, options.prose, options.names_alone, grammar)
    return None if marked == text else marked


def marker(lexicon: Lexicon = LEXICON) -> Callable[[Column, Options], Column]:
    """Marks the names of a lexicon that travels with the tasks."""
    entries = lexicon.bits()

    def mark(text: Column, options: Options) -> Column:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            grammar = Grammar(entries)
            return by_pieces(lambda t: _marked(t, options, grammar), ((b,) for b in batches))

        return F.arrow_udf(run, "string")(text)

    return mark


def marker_from(column: str) -> Callable[[Column, Options], Column]:
    """Marks the names of the entries that each document carries in a map column."""

    def mark(text: Column, options: Options) -> Column:
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, maps in batches:
                found = [_marked(t, options, Grammar(dict(m or {}))) for t, m in zip(texts, maps, strict=True)]
                yield pd.Series(found, dtype=object)

        return F.pandas_udf(run, "string")(text, F.col(column))

    return mark


def _judged(c: Candidate, options: Options) -> Verdict:
    suspect = c.value.startswith("?")
    plain = F.regexp_replace(c.value, r"^\?", "")
    return Verdict(F.when(suspect, F.lit("suspect")).otherwise(F.lit("replace")), plain, why=F.lit("one word is a name"))


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words)) + ")"


_LISTED = _any(x for x in LEXICON.given | LEXICON.surnames if " " not in x)
_COMMON = _any(LEXICON.common)
_ENTITY = rf"(?<!\w){_any(LEXICON.entity)}(?!\w)"
#: A name and a surname that is also a common word, or a compound surname, at the end.
_SUPPORTED = rf"(?<!\w)(?:(?:{_any((LEXICON.given | LEXICON.surnames) - LEXICON.common)}) {_any(LEXICON.surnames & LEXICON.common)}|{_any(x for x in LEXICON.surnames if ' ' in x)})$"
_GLUED = _any(sorted(f"{p} {x[len(p):]}" for x in LEXICON.surnames for p in LEXICON.particles if x.startswith(p) and len(x) - len(p) > 3))
_COMPANY = r"^,?[ \t]?(?:S\.?[rR]\.?[lL]|S\.?[pP]\.?[aA]|S\.?[nN]\.?[cC]|S\.?[aA]\.?[sS]|Ltd|LLC|Inc|PLC|plc|GmbH|AG)(?!\w)"


def _person(c: Candidate, options: Options, trim: str = "tail", listed: bool = False, company: bool = False) -> Verdict:
    """The judge of the rules with a label. Common words at the end (``tail``) or the start (``head``) go back to the text.

    A surname that is also a common word stays behind a name, as a compound surname does. ``listed``: one word alone must
    be in the lexicon, and several of which none is must not hold a job. ``company``: a company's form behind it excludes it.
    """
    low = F.lower(c.value)
    supported = low.rlike(f"(?U){_SUPPORTED}") | low.rlike(rf"(?U)(?<!\w){_GLUED}$")
    if trim == "tail":
        kept = F.when(supported, c.value).otherwise(F.regexp_replace(c.value, rf"(?iU)(?:(?:^|[ \t]+){_COMMON})+$", ""))
        head, tail = None, F.substring(c.value, F.length(kept) + 1, F.length(c.value))
    else:
        starts = low.rlike(rf"(?U)^{_GLUED}(?!\w)")
        kept = F.when(starts, c.value).otherwise(F.regexp_replace(c.value, rf"(?iU)^(?:{_COMMON}(?:[ \t]+|$))+", ""))
        head, tail = F.left(c.value, F.length(c.value) - F.length(kept)), None
    no = low.rlike(f"(?U){_ENTITY}") | (kept == "")
    if listed:
        known = low.rlike(rf"(?U)(?<!\w){_LISTED}(?!\w)")
        no = no | (~known & (~kept.rlike(r"\s") | low.rlike(rf"(?U)(?<!\w){_any(LEXICON.jobs)}(?!\w)")))
    if company:
        no = no | c.after.rlike(_COMPANY) | F.regexp_extract(c.value, r"\S+$", 0).rlike(_COMPANY)
    return Verdict(F.when(no, F.lit("leave")).otherwise(F.lit("replace")), F.when(no, c.value).otherwise(kept),
                   head=None if head is None else F.when(no, F.lit("")).otherwise(head), tail=None if tail is None else F.when(no, F.lit("")).otherwise(tail))


_beside_mail = partial(_person, trim="head", listed=True)
_declared = partial(_person, company=True)


def with_lexicon(docs: DataFrame, key: str, text: str, entries: DataFrame, into: str = "lexicon") -> DataFrame:
    """``docs`` with the entries of a lexicon table that each text can hold; see ``lexicon.with_classes``."""
    return with_classes(docs, key, text, entries, into)


def name_steps(column: str | None = None, lexicon: Lexicon = LEXICON) -> list[Step]:
    """The steps for names. The last one takes its lexicon from the map ``column`` of each document, or from ``lexicon``."""
    mark = marker_from(column) if column else marker(lexicon)
    return [s if s.name != "name_runs" else Step(s.name, s.kind, s.label, s.pack, s.switch, s.priority, judge=_judged, mark=mark) for s in NAME_STEPS]


def _rule(name: str, pack: str, priority: int, before: str, value: str = _NAME, judge=_person) -> Step:
    return Step(name, "names", "NAME", pack, "names", priority, rf"(?U)((?<![\w{{])(?:{before}))({value})(?![\w}}])", judge, True)


_HORIZONTAL = r"[ \t]"
NAME_STEPS: list[Step] = [
    _rule("name_title", "IT", 90, rf"(?:[Ss]ig(?:\.ra|\.na|\.|nora|nor)|[Dd]ott(?:\.ssa|\.|oressa|ore|or)|[Aa]vv\.|[Ii]ng\.|[Gg]eom\.|[Rr]ag\.|[Pp]rof(?:\.ssa|\.)|[Oo]n\.){_HORIZONTAL}?"),
    _rule("name_role_colon", "IT", 90, rf"(?:[Ii]l|[Ll]a){_HORIZONTAL}[^,:\n]{{3,60}}:{_HORIZONTAL}?", r"[A-ZÀ-Ý]{3,}"),
    Step("name_before_mail", "names", "NAME", "IT", "names", 90, rf"(?U)(?<![\w{{])(?:{_TOKEN})(?:[ \t](?:{_TOKEN})){{1,2}}(?=[ \t]?[<(]?\{{\{{EMAIL)", _beside_mail),
    Step("name_after_mail", "names", "NAME", "IT", "names", 90, rf"(?U)((?<!\w)\{{\{{EMAIL[^}}]*\}}\}}[>)]?[ \t]?[(-]?[ \t]?)((?:{_TOKEN})(?:[ \t](?:{_TOKEN})){{1,2}})(?![\w}}])", _beside_mail, True),
    Step("name_before_code", "names", "NAME", "IT", "names", 90, rf"(?U)(?<![\w{{])(?:{_TOKEN})(?:[ \t](?:{_TOKEN})){{1,3}}(?=,?[ \t]?(?i:C\.?F\.?|cod(?:ice|\.) fiscale)?[ \t:.]*\{{\{{CODICE_FISCALE)", _person),
    _rule("name_declared_role", "IT", 90, rf"(?i:(?:il|la|the){_HORIZONTAL}(?:cliente|paziente|inquilin[oa]|testimone|conduttore|locatore|ricorrente|client|patient|tenant|witness|claimant)){_HORIZONTAL}", rf"(?:{_TOKEN})(?:[ \t](?:{_TOKEN})){{1,2}}", _declared),
    _rule("name_field", "IT", 90, rf"(?i:nome|cognome|nome e cognome|cognome e nome|name|surname|first name|last name|full name){_HORIZONTAL}?[:=]{_HORIZONTAL}?", judge=_declared),
    _rule("name_closing", "IT", 90, r"(?i:cordiali saluti|distinti saluti|un saluto|cordialmente|in fede),?\s{1,4}"),
    _rule("name_greeting", "IT", 90, rf"(?i:ciao|caro|cara|gentile|egregio|buongiorno|salve){_HORIZONTAL}", rf"(?:{'|'.join(sorted(x.capitalize() for x in LEXICON.given))})(?:[ \t]{_CAP})?"),
    _rule("name_title_en", "EN", 91, rf"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam)\.?{_HORIZONTAL}"),
    _rule("name_dear", "EN", 91, rf"(?:Dear|Attn:?|Attention:|c/o|FAO){_HORIZONTAL}", rf"(?!(?:{_STOP})\b)(?:{_CAP})(?:[ \t]{_CAP}){{0,2}}"),
    _rule("name_closing_en", "EN", 91, r"(?i:(?:kind |best |warm )?regards|yours (?:sincerely|faithfully|truly)|sincerely|best wishes|many thanks),?\s{1,4}", rf"{_CAP}(?:[ \t]{_CAP}){{0,2}}"),
    Step("name_runs", "names", "NAME", "IT", "names", 92, judge=_judged, mark=marker()),
]

#: What a text must have for a step to find anything; see ``Step.needs``.
_NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "name_title": (("sig", "dott", "avv.", r"re:ing\.(?<![a-z]ing\.)", "geom.", "rag.", "prof", r"re:on\.(?<![a-z]on\.)"),),
    "name_role_colon": ((":",),),
    "name_before_mail": (("{{EMAIL",),),
    "name_after_mail": (("{{EMAIL",),),
    "name_before_code": (("{{CODICE_FISCALE",),),
    "name_declared_role": (("client", "paziente", "inquilin", "testimone", "conduttore", "locatore", "ricorrente", "patient", "tenant", "witness", "claimant"),),
    "name_field": (("nome", "name"), (":", "=")),
    "name_closing": (("cordial", "distinti", "un saluto", "in fede"),),
    "name_greeting": (("ciao", "caro", "cara", "gentile", "egregio", "buongiorno", "salve"),),
    "name_title_en": (("=Mr", "=Mrs", "=Ms", "=Miss", "=Dr", "=Prof", "=Sir", "=Madam"),),
    "name_dear": (("=Dear", "=Attn", "=Attention", "=c/o", "=FAO"),),
    "name_closing_en": (("regards", "yours ", "sincerely", "best wishes", "many thanks"),),
}
NAME_STEPS = [replace(s, needs=_NEEDS.get(s.name, ())) for s in NAME_STEPS]
