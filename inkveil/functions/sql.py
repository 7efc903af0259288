"""The library in Spark SQL alone: every check as a SQL function, and ``detect``, a table function for LATERAL joins.

``register(spark)`` makes temporary functions of the session. The checks are SQL expressions and stay inside generated code. ``detect``
runs in Python: it proposes by pattern, decides by check, and knows the checks of a few kinds only; the engine's program is ``redact``.

    SELECT doc_id, d.* FROM documents, LATERAL detect(text) d WHERE d.kind = 'iban'
    SELECT * FROM customers WHERE NOT iban_ok(account)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .validators import CF_ODD, IBAN_LENGTHS

_DIGITS = "regexp_replace(s, '[^0-9]', '')"
_COMPACT = r"upper(regexp_replace(s, '[\\s-]', ''))"


def _shaped(value: str, pattern: str, rest: str = "true") -> str:
    """Null stays null, another shape is false."""
    return f"CASE WHEN s IS NULL THEN NULL WHEN {value} RLIKE '{pattern}' THEN coalesce({rest}, false) ELSE false END"


def _sum(value: str, weights: tuple[int, ...]) -> str:
    own = f"transform(sequence(1, {len(weights)}), i -> coalesce(try_cast(substring({value}, i, 1) AS INT), 0) * element_at(array{weights}, i))"
    return f"aggregate({own}, 0, (a, x) -> a + x)"


def _worth(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN '0' AND '9' THEN ascii({x}) - 48 ELSE ascii({x}) - 55 END"


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


_REST_97 = (
    f"aggregate(transform(sequence(1, length({_COMPACT})), i -> substring(concat(substring({_COMPACT}, 5), left({_COMPACT}, 4)), i, 1)), 0, "
    f"(a, x) -> CASE WHEN x BETWEEN '0' AND '9' THEN (a * 10 + ascii(x) - 48) % 97 ELSE (a * 100 + ascii(x) - 55) % 97 END)"
)
_CF_SUM = (
    f"aggregate(transform(sequence(1, 15), i -> CASE WHEN i % 2 = 1 THEN element_at({_map(CF_ODD)}, substring(upper(s), i, 1)) "
    "WHEN substring(upper(s), i, 1) BETWEEN '0' AND '9' THEN ascii(substring(upper(s), i, 1)) - 48 ELSE ascii(substring(upper(s), i, 1)) - 65 END), 0, (a, x) -> a + x)"
)
_NHS = f"(11 - {_sum(_DIGITS, (10, 9, 8, 7, 6, 5, 4, 3, 2))} % 11) % 11"
_PREFIX = "try_cast(left(s, 2) AS INT)"
_GROUP = f"try_cast(substring({_DIGITS}, 4, 2) AS INT)"
_NANP = f"regexp_replace({_DIGITS}, '^1(?=[0-9]{{10}}$)', '')"
_MRZ = f"aggregate(transform(sequence(1, length(s) - 1), i -> ({_worth('substring(upper(s), i, 1)')}) * element_at(array(7, 3, 1), (i - 1) % 3 + 1)), 0, (a, x) -> a + x)"
_MRZ = _MRZ.replace("ELSE ascii(substring(upper(s), i, 1)) - 55", "WHEN substring(upper(s), i, 1) = '<' THEN 0 ELSE ascii(substring(upper(s), i, 1)) - 55")

#: name: SQL over the string s. ``mrz_ok`` takes a field with its check digit behind it.
CHECKS: dict[str, str] = {
    "luhn_ok": _shaped(_DIGITS, "^[0-9]{13,19}$", f"luhn_check({_DIGITS})"),
    "iban_ok": _shaped(_COMPACT, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", f"length({_COMPACT}) = element_at({_map(IBAN_LENGTHS)}, left({_COMPACT}, 2)) AND {_REST_97} = 1"),
    "cf_ok": _shaped("upper(s)", "^[A-Z]{6}[0-9LMNPQRSTUV]{2}[A-EHLMPR-T][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$", f"{_CF_SUM} % 26 = ascii(substring(upper(s), 16, 1)) - 65"),
    "piva_ok": _shaped("s", "^[0-9]{11}$", "luhn_check(s)"),
    "nino_ok": _shaped(_COMPACT, "^[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z][0-9]{6}[A-D]$", f"left({_COMPACT}, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')"),
    "ssn_ok": _shaped("s", "^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$", f"{_DIGITS} RLIKE '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$'"),
    "itin_ok": _shaped("s", "^9[0-9]{2}-?[0-9]{2}-?[0-9]{4}$", " OR ".join(f"{_GROUP} BETWEEN {a} AND {b}" for a, b in ((50, 65), (70, 88), (90, 92), (94, 99)))),
    "nhs_ok": _shaped(_DIGITS, "^[0-9]{10}$", f"{_NHS} <> 10 AND {_NHS} = try_cast(substring({_DIGITS}, 10, 1) AS INT)"),
    "aba_ok": _shaped("s", "^[0-9]{9}$", f"({_PREFIX} BETWEEN 0 AND 12 OR {_PREFIX} BETWEEN 21 AND 32 OR {_PREFIX} BETWEEN 61 AND 72 OR {_PREFIX} = 80) AND {_sum('s', (3, 7, 1) * 3)} % 10 = 0"),
    "sin_ok": _shaped(_DIGITS, "^[1-79][0-9]{8}$", f"luhn_check({_DIGITS})"),
    "abn_ok": _shaped(_DIGITS, "^[1-9][0-9]{10}$", f"({_sum(_DIGITS, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0"),
    "tfn_ok": _shaped(_DIGITS, "^[0-9]{8,9}$", f"CASE WHEN length({_DIGITS}) = 9 THEN {_sum(_DIGITS, (1, 4, 3, 7, 5, 8, 6, 9, 10))} ELSE {_sum(_DIGITS, (10, 7, 8, 4, 6, 3, 5, 1))} END % 11 = 0"),
    "mrz_ok": _shaped("s", "^[A-Za-z0-9<]+[0-9]$", f"{_MRZ} % 10 = try_cast(right(s, 1) AS INT)"),
    "postcode_ok": "upper(s) RLIKE '^(GIR ?0AA|[A-PR-UWYZ]([0-9]{1,2}|[A-HK-Y][0-9]([0-9]|[ABEHMNPRVWXY])?|[0-9][A-HJKPS-UW]) ?[0-9][ABD-HJLNP-UW-Z]{2})$'",
    "nanp_ok": f"CASE WHEN s IS NULL THEN NULL ELSE {_NANP} RLIKE '^[2-9](?!11)[0-9]{{2}}[2-9](?!11)[0-9]{{2}}[0-9]{{4}}$' AND NOT {_NANP} RLIKE '^[0-9]{{3}}55501[0-9]{{2}}$' END",
    "secret_plausible": "length(s) >= 16 OR (s RLIKE '[A-Za-z]' AND s RLIKE '[0-9]') OR s RLIKE '[^A-Za-z0-9]'",
}


# ---- detect


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _card(value: str) -> bool:
    d = re.sub("[^0-9]", "", value)
    return 13 <= len(d) <= 19 and _luhn(d)


def _iban(value: str) -> bool:
    v = re.sub("[ -]", "", value).upper()
    return len(v) == IBAN_LENGTHS.get(v[:2]) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _tax_code(value: str) -> bool:
    v = value.upper()
    total = sum(CF_ODD[c] if i % 2 == 0 else int(c) if c.isdigit() else ord(c) - 65 for i, c in enumerate(v[:15]))
    return total % 26 == ord(v[15]) - 65


#: kind, label, pattern, check; earlier kinds win where values overlap.
_PROPOSALS = [
    ("urls", "URL", r"(?:https?://|www\.)[^\s<>\"{}]*[^\s<>\"{}.,;:!?)\]']", None),
    ("emails", "EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", None),
    ("codice_fiscale", "CODICE_FISCALE", r"(?i)(?<!\w)[A-Z]{6}[0-9LMNPQRSTUV]{2}[A-EHLMPR-T][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z](?!\w)", _tax_code),
    ("iban", "IBAN", r"(?i)(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("cards", "CARD", r"(?<![\w.])[3-6]\d{3}(?:[ -]?\d{2,6}){2,4}(?!\w)", _card),
]


class _Detect:
    def eval(self, text: str | None) -> Iterator[tuple]:
        taken: list[tuple[int, int]] = []
        found = []
        for kind, label, pattern, check in _PROPOSALS:
            for m in re.finditer(pattern, text or ""):
                if any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                good = check is None or check(m[0])
                if good:
                    taken.append((m.start(), m.end()))
                found.append((kind, label, m.start(), m.end(), m[0], "replace" if good else "suspect"))
        yield from sorted(x for x in found if x[5] == "replace" or not any(a < x[3] and x[2] < b for a, b in taken))


def register(spark: SparkSession) -> list[str]:
    """Register all functions as temporary functions of the session; their names."""
    for name, body in CHECKS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS BOOLEAN RETURN {body}")
    table = udtf(_Detect, returnType="kind string, label string, start int, end int, value string, decision string")
    spark.udtf.register("detect", table)
    return [*CHECKS, "detect"]
