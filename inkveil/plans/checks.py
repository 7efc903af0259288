"""Queries of the identifier checks: numbers made from order keys, judged by Spark and by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V


def _n(digits: int, a: int, b: int) -> str:
    """SQL, the same on both sides: a number of so many digits from the order key."""
    return f"lpad(cast((o_orderkey * {a} + {b}) % {10**digits} as string), {digits}, '0')"


def _d(s: str, i: int) -> str:
    return f"substr({s}, {i}, 1)::INT"


def weighted_sql(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {_d(s, i)}" for i, w in enumerate(weights, 1)) + ")"


def luhn_sql(s: str) -> str:
    double = f"2 * substr({s}, i::INT, 1)::INT"
    return (
        f"(list_sum(list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN (len({s}) - i) % 2 = 1 "
        f"THEN CASE WHEN {double} > 9 THEN {double} - 9 ELSE {double} END ELSE substr({s}, i::INT, 1)::INT END)) % 10 = 0)"
    )


def mod97_sql(s: str) -> str:
    """Remainder of an IBAN, turned and with letters as numbers."""
    return (
        f"list_reduce(list_transform(string_split(regexp_replace(substr({s}, 5) || substr({s}, 1, 4), '(.)', '\\1,', 'g')[:-2], ','), "
        f"lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END), "
        f"lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END, 0)"
    )


def cf_sql(s: str) -> str:
    odd = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in V.CF_ODD.items()) + "}"
    parts = []
    for i in range(1, 16):
        x = f"substr({s}, {i}, 1)"
        even = f"CASE WHEN {x} BETWEEN '0' AND '9' THEN ascii({x}) - 48 ELSE ascii({x}) - 65 END"
        parts.append(f"{odd}[{x}]" if i % 2 else even)
    return f"(({' + '.join(parts)}) % 26 = ascii(substr({s}, 16, 1)) - 65)"


_LETTER = "chr(cast(65 + (o_orderkey * {a} + {b}) % 26 as int))"
TAX_CODE = (
    "'RSSMR' || " + _LETTER.format(a=5, b=1) + " || " + _n(2, 37, 5) + " || 'A' || " + _n(2, 11, 3) + " || 'H' || " + _n(3, 733, 9) + " || " + _LETTER.format(a=7, b=2)
)
_IBAN = (
    "CASE WHEN o_orderkey % 3 = 0 THEN 'DE' WHEN o_orderkey % 3 = 1 THEN 'FR' ELSE 'GB' END || lpad(cast(98 - ((o_orderkey % 97) * 50 + 131400) % 97 as string), 2, '0') || "
    "lpad(cast(o_orderkey as string), 18, '0')"
)
_NINO = "chr(cast(65 + o_orderkey % 26 as int)) || chr(cast(65 + (o_orderkey * 3) % 26 as int)) || " + _n(6, 7919, 17) + " || chr(cast(65 + o_orderkey % 5 as int))"
_POST = "chr(cast(65 + o_orderkey % 26 as int)) || cast(o_orderkey % 12 as string) || ' ' || cast(o_orderkey % 10 as string) || chr(cast(65 + o_orderkey % 26 as int)) || 'H'"

_SSN = "substr(s, 1, 3) || '-' || substr(s, 4, 2) || '-' || substr(s, 6, 4)"
_GROUP = "substr(s, 4, 2)::INT"

#: name, candidate (both sides), check in Spark, check in SQL over the candidate s.
CHECKS: list[tuple] = [
    ("val_luhn", "cast(400000 + o_orderkey % 9 as string) || " + _n(10, 7919, 31), V.luhn_ok, luhn_sql("s")),
    ("val_iban", _IBAN, V.iban_ok, f"(len(s) = CASE substr(s, 1, 2) WHEN 'DE' THEN 22 WHEN 'FR' THEN 27 ELSE 22 END AND {mod97_sql('s')} = 1)"),
    ("val_cf", TAX_CODE, V.cf_ok, cf_sql("s")),
    ("val_piva", _n(11, 7919, 104729), V.piva_ok, luhn_sql("s")),
    ("val_nhs", _n(10, 7919, 104729), V.nhs_ok, f"((11 - {weighted_sql('s', range(10, 1, -1))} % 11) % 11 <> 10 AND (11 - {weighted_sql('s', range(10, 1, -1))} % 11) % 11 = {_d('s', 10)})"),
    ("val_nino", _NINO, V.nino_ok, "regexp_matches(s, '^[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z][0-9]{6}[A-D]$') AND substr(s, 1, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')"),
    ("val_ssn", _n(9, 7919, 3), V.ssn_ok, "substr(s, 1, 3) NOT IN ('000', '666') AND substr(s, 1, 1) <> '9' AND substr(s, 4, 2) <> '00' AND substr(s, 6, 4) <> '0000'"),
    ("val_itin", _n(9, 7919, 3), V.itin_ok, f"substr(s, 1, 1) = '9' AND ({_GROUP} BETWEEN 50 AND 65 OR {_GROUP} BETWEEN 70 AND 88 OR {_GROUP} BETWEEN 90 AND 92 OR {_GROUP} BETWEEN 94 AND 99)"),
    ("val_aba", _n(9, 7919, 1), V.aba_ok, f"(substr(s, 1, 2)::INT BETWEEN 0 AND 12 OR substr(s, 1, 2)::INT BETWEEN 21 AND 32 OR substr(s, 1, 2)::INT BETWEEN 61 AND 72 OR substr(s, 1, 2) = '80') AND {weighted_sql('s', (3, 7, 1) * 3)} % 10 = 0"),
    ("val_sin", _n(9, 7919, 11), V.sin_ok, f"substr(s, 1, 1) NOT IN ('0', '8') AND {luhn_sql('s')}"),
    ("val_abn", _n(11, 7919, 13), V.abn_ok, f"substr(s, 1, 1) <> '0' AND ({weighted_sql('s', (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0"),
    ("val_tfn", _n(9, 7919, 19), V.tfn_ok, f"{weighted_sql('s', (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0"),
    ("val_mrz", _n(9, 7919, 23), lambda s: V.mrz_ok(F.left(s, F.lit(8)), F.substring(s, 9, 1)), f"{weighted_sql('s', (7, 3, 1, 7, 3, 1, 7, 3))} % 10 = {_d('s', 9)}"),
    ("val_postcode", _POST, V.postcode_ok, "regexp_matches(s, '^[A-PR-UWYZ][0-9]{1,2} [0-9][ABD-HJLNP-UW-Z]{2}$')"),
    ("val_nanp", _n(10, 7919, 29), V.nanp_ok, "regexp_matches(s, '^[2-9][0-9]{2}[2-9][0-9]{2}[0-9]{4}$') AND substr(s, 2, 2) <> '11' AND substr(s, 5, 2) <> '11' AND NOT regexp_matches(s, '^...55501..$')"),
    ("val_secret", "CASE WHEN o_orderkey % 3 = 0 THEN 'abcdefgh' WHEN o_orderkey % 3 = 1 THEN 'abc' || cast(o_orderkey as string) ELSE 'abc-def-' || 'x' END", V.secret_plausible, "len(s) >= 16 OR (regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]')) OR regexp_matches(s, '[^A-Za-z0-9]')"),
]


def queries() -> dict:
    def query(candidate: str, check):
        def run(spark, sf_dir: str):
            rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(candidate).alias("s"))
            return rows.select("o_orderkey", "s", check(F.col("s")).alias("valid"))

        return run

    def selectivity(spark, sf_dir: str):
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
        found = None
        for name, candidate, check, _ in CHECKS:
            own = rows.select(F.expr(candidate).alias("s")).select(F.lit(name).alias("validator"), check(F.col("s")).cast("int").alias("ok"))
            found = own if found is None else found.unionByName(own)
        return found.groupBy("validator").agg(F.count(F.lit(1)).alias("tried"), F.sum("ok").alias("accepted"))

    return {name: query(candidate, check) for name, candidate, check, _ in CHECKS} | {"val_selectivity": selectivity}


def oracle_sql() -> dict:
    out = {name: f"SELECT o_orderkey, s, ({sql}) AS valid FROM (SELECT o_orderkey, {candidate} AS s FROM orders)" for name, candidate, _, sql in CHECKS}
    parts = [f"SELECT '{n}' AS validator, ({sql})::INT AS ok FROM (SELECT {candidate} AS s, o_orderkey FROM orders)" for n, candidate, _, sql in CHECKS]
    out["val_selectivity"] = f"SELECT validator, count(*) AS tried, sum(ok)::BIGINT AS accepted FROM ({' UNION ALL '.join(parts)}) GROUP BY validator"
    return out
