"""Checks of identifiers as Column expressions: each takes a string column and gives a boolean.

Null stays null; anything of another shape is false.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from functools import partial, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the IBAN of each country in the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Fixed values of the tax code decree: worth of digits and letters in odd places.
CF_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23,
), strict=True))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stepwise(steps: Callable[..., Generator[Column, Column, Column]], **given) -> Callable[..., Column]:
    """A function of columns, written as a generator: it yields what it uses more than once and gets a reference to it.

    Called, it makes one column (``once`` around each step, which Spark interprets). ``add_column`` makes each step a column of
    its own instead, which Spark compiles: for many rows.
    """

    @wraps(steps)
    def column(*args, **more) -> Column:
        return nested(column.steps(*args, **more))

    column.steps = partial(steps, **given)
    column.given = lambda **more: stepwise(steps, **given, **more)
    return column


def nested(steps: Generator[Column, Column, Column]) -> Column:
    def go(found: Column | None) -> Column:
        try:
            value = steps.send(found)
        except StopIteration as done:
            return done.value
        return once(value, go)

    return go(None)


def add_column(rows: DataFrame, name: str, use: Callable[..., Column], *args: Column) -> DataFrame:
    """``rows`` with a column of ``use(*args)``; the steps of a ``stepwise`` function are columns on the way."""
    if not hasattr(use, "steps"):
        return rows.withColumn(name, use(*args))
    steps, kept, found = use.steps(*args), rows.columns, None
    while True:
        try:
            value = steps.send(found)
        except StopIteration as done:
            return rows.select(*kept, done.value.alias(name))
        step = f"_{name}_{len(rows.columns)}"
        rows, found = rows.withColumn(step, value), F.col(step)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def compact(s: Column) -> Column:
    """Upper case without blanks and hyphens."""
    return F.upper(F.regexp_replace(s, "[\\s-]", ""))


def digit(x: Column, i: int) -> Column:
    """A decimal digit of a whole number, from 0 for the last one."""
    return (F.call_function("div", x, F.lit(10**i)) if i else x) % 10


def weighted(x: Column, n: int, weights: tuple[int, ...]) -> Column:
    """Sum of the digits of a number times the weights, from the first of its n digits on."""
    terms = [digit(x, n - 1 - i) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def _shaped(s: Column, pattern: str, rest: Column) -> Column:
    return F.when(s.isNull(), None).when(s.rlike(pattern), rest).otherwise(F.lit(False))


@stepwise
def luhn_ok(s: Column):
    """Payment card: 13 to 19 digits that pass the Luhn check; separators are ignored."""
    d = yield digits(s)
    return _shaped(d, "^[0-9]{13,19}$", _luhn(d))


def _luhn(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def _letters_value(x: Column) -> Column:
    return _code_value(F.ascii(x))


def _code_value(code: Column) -> Column:
    """What a digit or a capital letter is worth by its ASCII code: 0 to 9, then A is 10."""
    return F.when(code < 58, code - 48).otherwise(code - 55)


def letter_value(x: Column) -> Column:
    """What a digit, or a capital letter counted from A as 0, is worth."""
    return F.when(F.ascii(x) < 58, F.ascii(x) - 48).otherwise(F.ascii(x) - 65)


@stepwise
def mod97(number: Column):
    """The remainder modulo 97 of up to 80 digits."""
    whole = yield F.lpad(number, 80, "0")
    parts = [F.substring(whole, 1 + 16 * i, 16).try_cast("long") % 97 * (10 ** (64 - 16 * i) % 97) for i in range(5)]
    return (sum(parts[1:], parts[0]) % 97).cast("int")


_CF_WORTH = [CF_ODD.get(chr(c), 0) for c in range(48, 91)]


def cf_total(text: Column) -> Column:
    """The sum over the 15 digits and capital letters of a tax code that its check letter stands for."""
    worth = F.array(*[F.lit(w) for w in _CF_WORTH])
    total = F.lit(0)
    for i in range(1, 16):
        x = F.substring(text, i, 1)
        total = total + (F.get(worth, F.ascii(x) - 48) if i % 2 else letter_value(x))
    return total


def iban_length(country: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(y) for x in IBAN_LENGTHS.items() for y in x]), country)


@stepwise
def iban_ok(s: Column):
    """Registered length and remainder 1 modulo 97."""
    v = yield compact(s)
    length = F.coalesce(F.length(v) == iban_length(F.left(v, F.lit(2))), F.lit(False))
    account = yield F.substr(v, F.lit(5))
    numbers = account
    for i, letter in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10):
        numbers = F.replace(numbers, F.lit(letter), F.lit(str(i)))
    numbers = F.when(account.rlike("[A-Z]"), numbers).otherwise(account)
    country = [(F.ascii(F.substring(v, i, 1)) - 55).cast("string") for i in (1, 2)]
    rest = yield from mod97.steps(F.concat(numbers, *country, F.substring(v, 3, 2)))
    return _shaped(v, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", length & (rest == 1))


@stepwise
def cf_ok(s: Column):
    """Italian tax code of 16 characters (letters may stand for digits): check character."""
    shape = "^[A-Z]{6}[0-9LMNPQRSTUV]{2}[A-EHLMPR-T][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$"
    v = yield F.upper(s)
    return _shaped(v, shape, cf_total(v) % 26 == F.ascii(F.substring(v, 16, 1)) - 65)


def piva_ok(s: Column) -> Column:
    """Italian VAT number: 11 digits, the last of which checks the others."""
    return _shaped(s, "^[0-9]{11}$", _luhn(s))


@stepwise
def nino_ok(s: Column):
    """UK national insurance number: letters that are issued, and a suffix from A to D."""
    v = yield compact(s)
    return _shaped(v, "^[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z][0-9]{6}[A-D]$", ~F.left(v, F.lit(2)).isin("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"))


def ssn_ok(s: Column) -> Column:
    """US social security number: no area 000, 666 or 9xx, no group 00, no serial 0000."""
    return _shaped(s, "^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$", digits(s).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


@stepwise
def itin_ok(s: Column):
    """US taxpayer number: starts with 9, group in 50-65, 70-88, 90-92 or 94-99."""
    group = yield F.substring(digits(s), 4, 2).try_cast("int")
    inside = group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)
    return _shaped(s, "^9[0-9]{2}-?[0-9]{2}-?[0-9]{4}$", inside)


@stepwise
def nhs_ok(s: Column):
    """NHS number: 10 digits, modulo 11."""
    d = yield digits(s)
    x = yield d.try_cast("long")
    # a remainder of 10 equals no digit
    return _shaped(d, "^[0-9]{10}$", (11 - weighted(x, 10, (10, 9, 8, 7, 6, 5, 4, 3, 2)) % 11) % 11 == digit(x, 0))


@stepwise
def aba_ok(s: Column):
    """US routing number: prefix in use, weights 3-7-1 modulo 10."""
    d = yield s
    x = yield d.try_cast("long")
    prefix = yield F.call_function("div", x, F.lit(10**7))
    used = prefix.between(0, 12) | prefix.between(21, 32) | prefix.between(61, 72) | (prefix == 80)
    return _shaped(d, "^[0-9]{9}$", used & (weighted(x, 9, (3, 7, 1) * 3) % 10 == 0))


@stepwise
def sin_ok(s: Column):
    """Canadian SIN: 9 digits, Luhn, first digit neither 0 nor 8."""
    d = yield digits(s)
    return _shaped(d, "^[1-79][0-9]{8}$", _luhn(d))


@stepwise
def abn_ok(s: Column):
    """Australian business number: 11 digits, modulo 89."""
    d = yield digits(s)
    x = yield d.try_cast("long")
    return _shaped(d, "^[1-9][0-9]{10}$", (weighted(x, 11, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)) - 10) % 89 == 0)


@stepwise
def tfn_ok(s: Column):
    """Australian tax file number: 8 or 9 digits, modulo 11."""
    d = yield digits(s)
    x = yield d.try_cast("long")
    nine, eight = weighted(x, 9, (1, 4, 3, 7, 5, 8, 6, 9, 10)), weighted(x, 8, (10, 7, 8, 4, 6, 3, 5, 1))
    return _shaped(d, "^[0-9]{8,9}$", F.when(F.length(d) == 9, nine % 11 == 0).otherwise(eight % 11 == 0))


def mrz_ok(field: Column, check: Column) -> Column:
    """Travel document field against its check digit: weights 7-3-1, < is 0, A is 10."""
    chars = F.filter(F.split(F.upper(field), ""), lambda x: x != "")
    worth = lambda x: F.when(x == "<", 0).otherwise(_letters_value(x))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    parts = F.transform(chars, lambda x, i: worth(x) * F.element_at(weights, (i % 3 + 1).cast("int")))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return _shaped(F.concat(field, check), "^[A-Za-z0-9<]+[0-9]$", total % 10 == check.try_cast("int"))


def postcode_ok(s: Column) -> Column:
    """UK postcode in one of its official shapes."""
    shape = "^(GIR ?0AA|[A-PR-UWYZ]([0-9]{1,2}|[A-HK-Y][0-9]([0-9]|[ABEHMNPRVWXY])?|[0-9][A-HJKPS-UW]) ?[0-9][ABD-HJLNP-UW-Z]{2})$"
    return F.upper(s).rlike(shape)


@stepwise
def nanp_ok(s: Column):
    """North American number: area and exchange from 200, not N11, not 555-01xx."""
    d = yield F.regexp_replace(digits(s), "^1(?=[0-9]{10}$)", "")
    return d.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}[0-9]{4}$") & ~d.rlike("^[0-9]{3}55501[0-9]{2}$")


def secret_plausible(s: Column) -> Column:
    """A value behind a weak label: long, mixed, or with a symbol."""
    mixed = s.rlike("[A-Za-z]") & s.rlike("[0-9]")
    return (F.length(s) >= 16) | mixed | s.rlike("[^A-Za-z0-9]")
