"""What to look for: switches, packs, term lists, profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

PACKS = ("CORE", "IT", "EN", "ATTI")
DEFAULT_PACKS = ("CORE", "IT", "EN")
SWITCHES = ("secrets", "urls", "emails", "fiscal", "phones", "addresses", "names", "documents", "records", "quasi_ids", "dates", "amounts")
#: Categories of the report.
KINDS = (
    "secrets", "urls", "emails", "mrz", "codice_fiscale", "iban", "cards", "bban", "partita_iva", "itin", "ssn", "nino", "nhs_number",
    "routing_number", "sin", "abn", "tfn", "dates", "documents", "pratica", "catasto", "targhe", "age", "sex", "phones", "amounts",
    "addresses", "names", "terms",
)
MAX_TERMS, MAX_TERM_CHARS, MIN_TERM_CHARS = 500, 120, 2


@dataclass(frozen=True)
class Options:
    secrets: bool = True
    urls: bool = True
    emails: bool = True
    fiscal: bool = True
    phones: bool = True
    addresses: bool = True
    names: bool = True
    documents: bool = True
    records: bool = True
    quasi_ids: bool = True
    dates: bool = False
    amounts: bool = False
    numbered: bool = True
    names_alone: bool = False
    always: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    detect_only: tuple[str, ...] = ()
    packs: tuple[str, ...] = DEFAULT_PACKS
    prose: bool | None = None

    def __post_init__(self):
        unknown = set(self.packs) - set(PACKS)
        if unknown:
            raise ValueError(f"unknown packs: {sorted(unknown)}")
        unknown = set(self.detect_only) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown categories: {sorted(unknown)}")
        object.__setattr__(self, "always", terms(self.always))
        object.__setattr__(self, "never", terms(self.never))

    def any_switch(self) -> bool:
        return any(getattr(self, s) for s in SWITCHES) or bool(self.always)


def terms(values: Iterable[str] | str) -> tuple[str, ...]:
    """Distinct terms (case is ignored), longest first; too short ones go, too long ones are cut."""
    values = values.splitlines() if isinstance(values, str) else values
    seen: dict[str, str] = {}
    for value in values:
        value = " ".join(value.split())[:MAX_TERM_CHARS]
        if len(value) >= MIN_TERM_CHARS:
            seen.setdefault(value.casefold(), value)
    return tuple(sorted(list(seen.values())[:MAX_TERMS], key=lambda x: -len(x)))


def no_redaction(**more) -> Options:
    return Options(**{s: False for s in SWITCHES}, **more)


def only(*switches: str, **more) -> Options:
    """Options with these switches alone; an unknown name is an error."""
    unknown = set(switches) - set(SWITCHES)
    if unknown:
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    return replace(no_redaction(), **{s: True for s in switches}, **more)


def _flag(value) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def from_dict(values: Mapping) -> Options:
    """Options from loosely typed values; keys that are no option are ignored, unknown categories are errors."""
    out = {}
    for f in fields(Options):
        if f.name not in values:
            continue
        v = values[f.name]
        if f.name in ("always", "never"):
            out[f.name] = terms(v)
        elif f.name in ("detect_only", "packs"):
            out[f.name] = tuple(x.strip() for x in v.split(",") if x.strip()) if isinstance(v, str) else tuple(v)
        elif f.name == "prose":
            out[f.name] = None if v in (None, "", "auto") else _flag(v)
        else:
            out[f.name] = _flag(v)
    return Options(**out)


PROFILES: dict[str, dict] = {
    "default": {},
    "legal_mail": {"amounts": True, "dates": True},
    "conversion_only": {s: False for s in SWITCHES},
    "llm_ready": {"numbered": True},
    "no_privacy": {s: False for s in SWITCHES},
}


def from_form(values: Mapping, profile: str = "default") -> Options:
    """A profile, then the fields that are given, which win."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    return from_dict({**PROFILES[profile], **values})
