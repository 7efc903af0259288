"""Queries over generated values: all pass their checks, their neighbours fail, and the whole program removes them in many shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import generate
from ..operators.engine import redact
from ..operators.evaluate import outcome
from ..operators.options import PACKS, Options, only
from ..operators.steps import STEPS
from ..operators.tables import spread, written
from .checks import luhn_sql

#: A label and how the value is written behind it: as it is, or in groups of so many characters with a separator.
_FOURS = (4, 4, 4, 4, 4, 4, 4, 4, 4)
SHAPES: list[tuple[str, str, tuple[int, ...], str]] = [
    *[(kind, label, groups, sep) for kind in ("card_visa", "card_mastercard") for label, groups, sep in (("card ", (), ""), ("carta n. ", _FOURS, " "), ("paid with ", _FOURS, "-"))],
    ("card_amex", "card ", (4, 6, 5), " "),
    *[(f"iban_{c}", label, groups, sep) for c in ("it", "de", "fr", "gb", "sd") for label, groups, sep in (("IBAN: ", (), ""), ("pay to ", _FOURS, " "), ("conto ", _FOURS, "-"))],
    *[(kind, label, (), "") for kind in ("tax_code", "tax_code_foreign", "tax_code_letters") for label in ("codice fiscale ", "il C.F. ", "")],
    ("vat_number", "P.IVA ", (), ""),
    ("vat_number", "partita iva ", (), ""),
    ("vat_number", "VAT number ", (), ""),
    ("nhs", "NHS number ", (), ""),
    ("nhs", "NHS ", (3, 3, 4), " "),
    ("abn", "ABN ", (2, 3, 3, 3), " "),
    ("abn", "business number ", (), ""),
    ("tfn", "tax file number ", (3, 3, 3), " "),
    ("tfn", "TFN ", (), ""),
    ("sin", "SIN ", (3, 3, 3), " "),
    ("routing", "routing number ", (), ""),
    ("ssn", "number ", (), ""),
    ("itin", "number ", (), ""),
    ("nino", "number ", (), ""),
    ("nino", "NI no ", (2, 2, 2, 2, 1), " "),
    ("postcode", "postcode ", (), ""),
    ("phone_us", "phone ", (3, 3, 4), "-"),
    ("phone_us", "call ", (3, 3, 4), " "),
]


def generated_values(spark, sf_dir: str) -> DataFrame:
    """By kind: how many values pass their check, and how many of their neighbours do."""
    out = None
    for rows in generate.checked(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey"):
        yes = lambda is_neighbour, name: F.sum((F.col("valid") & (F.col("is_neighbour") == is_neighbour)).cast("int")).alias(name)
        own = rows.groupBy("kind").agg(F.count(F.when(~F.col("is_neighbour"), 1)).alias("tried"), yes(False, "valid"), yes(True, "neighbour_valid"))
        out = own if out is None else out.unionByName(own)
    return out


def generated_numbers(spark, sf_dir: str) -> DataFrame:
    """Values of three kinds."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", generate.card(k).alias("card"), generate.iban(k, "DE").alias("iban"), generate.vat_number(k).alias("vat"))


def _written(value, groups: tuple[int, ...], separator: str):
    if not groups:
        return value
    places = [1 + sum(groups[:i]) for i in range(len(groups))]
    parts = [F.substring(value, at, n) for at, n in zip(places, groups, strict=True)]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), separator)


def variety_recall(spark, sf_dir: str) -> DataFrame:
    """Where the values of each kind go in the whole default program with all packs, over all shapes."""
    # one shape and one kind for each key, so that no other value is made
    keys = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").filter("o_orderkey IS NOT NULL"))
    place = F.pmod(F.col("o_orderkey"), F.lit(len(SHAPES))).cast("int")
    of_shape = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SHAPES]), F.col("shape") + 1)
    rows = keys.withColumn("shape", place).withColumn("kind", of_shape(0)).withColumn("value", generate.value(F.col("o_orderkey"), F.col("kind")))
    shown = F.coalesce(*[F.when(F.col("shape") == i, _written(F.col("value"), s[2], s[3])) for i, s in enumerate(SHAPES)])
    texts = rows.withColumn("shown", shown).withColumn("text", F.concat(F.lit("il "), of_shape(1), "shown", F.lit(" fine, grazie")))
    found = redact(written(texts.select("kind", "shown", "text"), "texts"), "text", Options(packs=PACKS))
    judged = found.withColumn("outcome", outcome(F.col("shown"), F.col("redacted"), F.col("report.suspects")))
    return judged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("tried"), *[F.sum((F.col("outcome") == x).cast("int")).alias(x) for x in ("redacted", "flagged", "lost")]
    )


#: Digits and the letters a reader takes them for.
_MISREAD = ("0125678", "OIZSGTB")


def ocr_recall(spark, sf_dir: str) -> DataFrame:
    """Tax codes and account numbers with one digit read as a letter: which were damaged, and which the repair steps remove."""
    k = F.col("o_orderkey")
    steps = [s for s in STEPS if s.name in ("codice_fiscale_ocr", "iban_ocr")]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, generate.tax_code(k).alias("cf"), generate.iban(k, "DE").alias("iban"))
    for name, place in (("cf", 7), ("iban", 3)):
        read = F.translate(F.substring(name, place, 1), *_MISREAD)
        rows = rows.withColumn(f"{name}_read", F.concat(F.left(name, F.lit(place - 1)), read, F.substr(name, F.lit(place + 1))))
    texts = rows.withColumn("text", F.concat(F.lit("il codice "), "cf_read", F.lit(" e il conto "), "iban_read", F.lit(".")))
    found = redact(written(texts, "texts"), "text", only("fiscal", numbered=False), steps)
    gone = {name: ~F.contains("redacted", F.col(f"{name}_read")) for name in ("cf", "iban")}
    return found.select(
        "o_orderkey", *[(F.col(n) != F.col(f"{n}_read")).alias(f"{n}_damaged") for n in gone], *[x.alias(f"{n}_removed") for n, x in gone.items()]
    )


def queries() -> dict:
    return {f.__name__: f for f in (generated_values, generated_numbers, variety_recall, ocr_recall)}


def _digits_sql(name: str, n: int) -> str:
    if n > 12:
        return f"({_digits_sql(name, 12)} || {_digits_sql(name + '+', n - 12)})"
    return f"lpad((('0x' || left(md5(o_orderkey::VARCHAR || ':{name}'), 13))::BIGINT % {10**n})::VARCHAR, {n}, '0')"


def oracle_sql() -> dict:
    kinds = ", ".join(f"('{k}')" for k in generate.KINDS)
    values = f"SELECT kind, count(*) AS tried, count(*) AS valid, 0::BIGINT AS neighbour_valid FROM orders, (VALUES {kinds}) AS k(kind) GROUP BY kind"
    # the check digits by trial: the one of ten (or of 97) that the checks of the other queries accept
    numbers = (
        f"WITH rows AS (SELECT o_orderkey, '4' || {_digits_sql('card4', 14)} AS c, {_digits_sql('ibanDE', 18)} AS b, {_digits_sql('vat', 10)} AS v FROM orders) "
        f"SELECT o_orderkey, list_filter(list_transform(range(10), lambda x: c || x::VARCHAR), lambda s: {luhn_sql('s')})[1] AS card, "
        "'DE' || lpad((98 - (b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || b AS iban, "
        f"list_filter(list_transform(range(10), lambda x: v || x::VARCHAR), lambda s: {luhn_sql('s')})[1] AS vat FROM rows"
    )
    shapes = ", ".join(f"({i}, '{s[0]}')" for i, s in enumerate(SHAPES))
    recall = (
        f"SELECT kind, count(*) AS tried, count(*) AS redacted, 0::BIGINT AS flagged, 0::BIGINT AS lost FROM orders, (VALUES {shapes}) AS s(shape, kind) "
        f"WHERE o_orderkey % {len(SHAPES)} = shape GROUP BY kind"
    )
    misread = ", ".join(f"'{d}'" for d in _MISREAD[0])
    # a number that is not damaged is not theirs to remove
    ocr = (
        f"SELECT o_orderkey, cf AS cf_damaged, cf AS cf_removed, iban AS iban_damaged, iban AS iban_removed FROM (SELECT o_orderkey, left({_digits_sql('year', 2)}, 1) IN ({misread}) AS cf, "
        f"left(lpad((98 - ({_digits_sql('ibanDE', 18)} || '131400')::HUGEINT % 97)::VARCHAR, 2, '0'), 1) IN ({misread}) AS iban FROM orders)"
    )
    return {"generated_values": values, "generated_numbers": numbers, "variety_recall": recall, "ocr_recall": ocr}
