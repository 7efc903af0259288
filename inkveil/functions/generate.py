"""Values that pass their checks, made from a key: the checks of ``validators`` solved for the check digits.

Every function takes a key column and gives a string column; equal keys give equal values, whatever the partitioning. Digits
come from the MD5 of the key and a name, so other engines can make the same ones. ``KINDS`` lists all kinds, each with its check and
a neighbour that must fail it.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import spread
from . import validators as V
from .validators import add_column, nested, stepwise

#: Hex digits of a hash that make one number: below 2**52.
_HEX = 13


def number(key: Column, name: str | Column, below: int) -> Column:
    """A whole number from 0 to below that, by key and name."""
    seen = F.md5(F.concat_ws(":", key.cast("string"), F.lit(name)))
    return F.conv(F.left(seen, F.lit(_HEX)), 16, 10).cast("long") % below


def digits(key: Column, name: str | Column, n: int) -> Column:
    """n digits; above 12 they come from two numbers."""
    if n > 12:
        return F.concat(digits(key, name, 12), digits(key, name + "+", n - 12))
    return F.lpad(number(key, name, 10**n).cast("string"), n, "0")


@stepwise
def letters(key: Column, name: str, n: int, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    """n letters of an alphabet, all from one number; at most ten."""
    size, listed = len(alphabet), F.array(*[F.lit(c) for c in alphabet])
    x = yield number(key, name, size**n)
    return F.concat(*[F.get(listed, (F.floor(x / size**i) % size).cast("int")) for i in range(n)])


def _text(x: Column) -> Column:
    return x.cast("string")


def parts(key: Column, name: str, *below: int) -> Generator[Column, Column, list[Column]]:
    """Numbers below these, all from one hash."""
    x = yield number(key, name, prod(below))
    return [F.call_function("div", x, F.lit(prod(below[i + 1 :]))) % n for i, n in enumerate(below)]


def _pick(choices: str | tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), i.cast("int"))


def _padded(x: Column, n: int) -> Column:
    return F.lpad(_text(x), n, "0")


def luhn_digit(payload: Column, n: int) -> Column:
    """The digit behind a number of n digits that makes their Luhn sum whole."""
    total = F.lit(0)
    for i in range(n):
        d = V.digit(payload, i)
        # a doubled digit of two figures counts as their sum
        total = total + (d * 2 - F.when(d > 4, 9).otherwise(0) if i % 2 == 0 else d)
    return _text((10 - total % 10) % 10)


def _first_that(name: str, make: Callable[[Column], Generator], otherwise: str) -> Generator[Column, Column, Column]:
    """The first of eight tries that is not null; a modulus leaves some payloads without a check digit. Later tries are not made."""
    first = yield from make(F.lit(f"{name}0"))
    names = F.array(*[F.lit(f"{name}{i}") for i in range(1, 8)])
    later = F.aggregate(names, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, nested(make(x))))
    return F.coalesce(first, later, F.lit(otherwise))


@stepwise
def card(key: Column, prefix: str = "4", length: int = 16):
    n = length - 1
    body = yield F.concat(F.lit(prefix), digits(key, f"card{prefix}", n - len(prefix)))
    x = yield body.cast("long")
    return F.concat(body, luhn_digit(x, n))


@stepwise
def iban(key: Column, country: str = "DE"):
    own = yield digits(key, f"iban{country}", V.IBAN_LENGTHS[country] - 4)
    return (yield from _iban_of(country, own, own))


def _iban_of(country: str, own: Column, numbers: Column) -> Generator[Column, Column, Column]:
    """With check digits; ``numbers`` is the account with its letters read as two digits each."""
    rest = yield from V.mod97.steps(F.concat(numbers, F.lit("".join(str(int(c, 36)) for c in country) + "00")))
    return F.concat(F.lit(country), _padded(98 - rest, 2), own)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@stepwise
def iban_it(key: Column):
    (cin,) = yield from parts(key, "cin", 26)
    own = yield digits(key, "ibanIT", 22)
    return (yield from _iban_of("IT", F.concat(_pick(_ALPHABET, cin), own), F.concat(_text(cin + 10), own)))


@stepwise
def iban_gb(key: Column):
    bank = yield from parts(key, "bank", 26, 26, 26, 26)
    own = yield digits(key, "ibanGB", 14)
    return (yield from _iban_of("GB", F.concat(*[_pick(_ALPHABET, x) for x in bank], own), F.concat(*[_text(x + 10) for x in bank], own)))


def _cf_letter(body: Column) -> Column:
    return F.char(65 + V.cf_total(body) % 26)


@stepwise
def tax_code(key: Column, foreign: bool = False, letters_for_digits: int = 0):
    """Italian tax code; ``foreign``: born abroad; ``letters_for_digits``: so many digits from the end are letters, as for namesakes."""
    consonants = "BCDFGHLMNPRSTVZ"
    month, sex, day, town, number_of = yield from parts(key, "born", 12, 2, 28, 9, 600 if foreign else 1000)
    place = F.concat(F.lit("Z"), _text(100 + number_of)) if foreign else F.concat(_pick("ABCDEFGHL", town), _padded(number_of, 3))
    person = yield from letters.steps(key, "cf", 6, consonants)
    body = F.concat(person, digits(key, "year", 2), _pick("ABCDEHLMPRST", month), _padded(1 + day + 40 * sex, 2), place)
    for at in (15, 14, 13, 11, 10, 8, 7)[:letters_for_digits]:
        b = yield body
        letter = F.translate(F.substring(b, at, 1), "0123456789", "LMNPQRSTUV")
        body = F.concat(F.left(b, F.lit(at - 1)), letter, F.substr(b, F.lit(at + 1)))
    whole = yield body
    return F.concat(whole, _cf_letter(whole))


@stepwise
def vat_number(key: Column):
    body = yield digits(key, "vat", 10)
    x = yield body.cast("long")
    return F.concat(body, luhn_digit(x, 10))


@stepwise
def nhs(key: Column):
    def make(name: Column):
        x = yield number(key, name, 10**9)
        check = yield (11 - V.weighted(x, 9, (10, 9, 8, 7, 6, 5, 4, 3, 2)) % 11) % 11
        return F.when(check != 10, F.concat(_padded(x, 9), _text(check)))

    return (yield from _first_that("nhs", make, "9434765919"))


@stepwise
def abn(key: Column):
    x = yield number(key, "abn", 10**9)
    # the first two digits, the first less one, stand for what is missing to a multiple of 89
    rest = yield (89 - V.weighted(x, 9, (3, 5, 7, 9, 11, 13, 15, 17, 19)) % 89) % 89
    return F.concat(_text(rest + 10), _padded(x, 9))


@stepwise
def tfn(key: Column, length: int = 9):
    weights, last = ((1, 4, 3, 7, 5, 8, 6, 9), 10) if length == 9 else ((10, 7, 8, 4, 6, 3, 5), 1)

    def make(name: Column):
        x = yield number(key, name, 10 ** (length - 1))
        check = yield (V.weighted(x, length - 1, weights) * (1 if last == 10 else 10)) % 11
        return F.when(check != 10, F.concat(_padded(x, length - 1), _text(check)))

    return (yield from _first_that(f"tfn{length}", make, "123456782" if length == 9 else "81854402"))


@stepwise
def sin(key: Column):
    x = yield number(key, "sin", 7 * 10**7) + 10**7
    return F.concat(_text(x), luhn_digit(x, 8))


@stepwise
def routing(key: Column):
    office, region, rest = yield from parts(key, "aba", 12, 3, 10**6)
    x = yield (office + _pick((1, 21, 61), region)) * 10**6 + rest
    return F.concat(_padded(x, 8), _text((10 - V.weighted(x, 8, (3, 7, 1, 3, 7, 1, 3, 7)) % 10) % 10))


@stepwise
def ssn(key: Column):
    area, group, serial = yield from parts(key, "ssn", 665, 99, 9999)
    return F.concat_ws("-", _padded(area + 1, 3), _padded(group + 1, 2), _padded(serial + 1, 4))


@stepwise
def itin(key: Column):
    groups = tuple(str(g) for g in (*range(50, 66), *range(70, 89), 90, 91, 92, *range(94, 100)))
    area, group, rest = yield from parts(key, "itin", 100, len(groups), 10**4)
    return F.concat_ws("-", F.concat(F.lit("9"), _padded(area, 2)), _pick(groups, group), _padded(rest, 4))


@stepwise
def nino(key: Column):
    first, second, rest, last = yield from parts(key, "nino", 14, 19, 10**6, 4)
    return F.concat(_pick("ACEHJLMOPRSWXY", first), _pick("ABCEGHJKLMNPRSTWXYZ", second), _padded(rest, 6), _pick("ABCD", last))


@stepwise
def postcode(key: Column):
    inner = "ABDEFGHJLNPQRSTUWXYZ"
    area, more, district, sector, one, two = yield from parts(key, "postcode", 23, 24, 9, 10, 20, 20)
    out = F.concat(_pick("ABCDEFGHIJKLMNOPRSTUWYZ", area), _pick(("", *"ABCDEFGHKLMNOPQRSTUVWXY"), more), _text(district + 1))
    return F.concat(out, F.lit(" "), _text(sector), _pick(inner, one), _pick(inner, two))


@stepwise
def mrz_number(key: Column):
    """Nine characters of a document number and their check digit."""
    one, two, x = yield from parts(key, "doc", 26, 26, 10**7)
    x = yield x
    total = (one + 10) * 7 + (two + 10) * 3 + V.weighted(x, 7, (1, 7, 3, 1, 7, 3, 1))
    return F.concat(_pick(_ALPHABET, one), _pick(_ALPHABET, two), _padded(x, 7), _text(total % 10))


@stepwise
def phone_us(key: Column):
    a, b, c, d, e, rest = yield from parts(key, "phone", 8, 8, 10, 8, 7, 10**5)
    area = F.concat(_text(a + 2), _pick("02345678", b), _text(c))
    return F.concat(area, _text(d + 2), _pick("0234678", e), _padded(rest, 5))


def next_last(value: Column) -> Column:
    """The value with its last digit or letter moved on by one."""
    last = F.right(value, F.lit(1))
    return F.concat(F.left(value, F.length(value) - 1), F.translate(last, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "1234567890BCDEFGHIJKLMNOPQRSTUVWXYZA"))


def _at(value: Column, place: int, text: str) -> Column:
    return F.concat(F.left(value, F.lit(place - 1)), F.lit(text), F.substr(value, F.lit(place + len(text))))


@dataclass(frozen=True)
class Kind:
    make: Callable[[Column], Column]
    check: Callable[[Column], Column]
    #: A value one step away that the check must refuse.
    neighbour: Callable[[Column], Column] = next_last


KINDS: dict[str, Kind] = {
    "card_visa": Kind(card.given(prefix="4"), V.luhn_ok),
    "card_mastercard": Kind(card.given(prefix="53"), V.luhn_ok),
    "card_amex": Kind(card.given(prefix="37", length=15), V.luhn_ok),
    "iban_it": Kind(iban_it, V.iban_ok),
    "iban_de": Kind(iban.given(country="DE"), V.iban_ok),
    "iban_fr": Kind(iban.given(country="FR"), V.iban_ok),
    "iban_gb": Kind(iban_gb, V.iban_ok),
    "iban_sd": Kind(iban.given(country="SD"), V.iban_ok),
    "tax_code": Kind(tax_code, V.cf_ok),
    "tax_code_foreign": Kind(tax_code.given(foreign=True), V.cf_ok),
    "tax_code_letters": Kind(tax_code.given(letters_for_digits=3), V.cf_ok),
    "vat_number": Kind(vat_number, V.piva_ok),
    "nhs": Kind(nhs, V.nhs_ok),
    "abn": Kind(abn, V.abn_ok),
    "tfn": Kind(tfn, V.tfn_ok),
    "tfn_old": Kind(tfn.given(length=8), V.tfn_ok),
    "sin": Kind(sin, V.sin_ok),
    "routing": Kind(routing, V.aba_ok),
    "ssn": Kind(ssn, V.ssn_ok, lambda v: _at(v, 5, "00")),
    "itin": Kind(itin, V.itin_ok, lambda v: _at(v, 5, "66")),
    "nino": Kind(nino, V.nino_ok, lambda v: _at(v, 9, "E")),
    "postcode": Kind(postcode, V.postcode_ok, lambda v: F.concat(F.left(v, F.length(v) - 1), F.lit("C"))),
    "mrz_number": Kind(mrz_number, lambda v: V.mrz_ok(F.left(v, F.lit(9)), F.right(v, F.lit(1)))),
    "phone_us": Kind(phone_us, V.nanp_ok, lambda v: _at(v, 5, "11")),
}


def value(key: Column, kind: Column) -> Column:
    """The value of the kind that a column names; the others are not made."""
    return F.coalesce(*[F.when(kind == n, own.make(key)) for n, own in KINDS.items()])


def _listed(kinds: tuple[str, ...]) -> list[Kind]:
    return [kind for name, kind in KINDS.items() if name in kinds]


def made(df: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[DataFrame]:
    """(key, kind, value, neighbour) of each kind, in the order of ``KINDS``: a row for each row of ``df``, in columns that Spark compiles."""
    rows = spread(df.select(key))
    out = []
    for name, kind in KINDS.items():
        if name in kinds:
            own = add_column(rows.withColumn("kind", F.lit(name)), "value", kind.make, F.col(key))
            out.append(own.withColumn("neighbour", kind.neighbour(F.col("value"))))
    return out


def checked(df: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[DataFrame]:
    """(key, kind, is_neighbour, value, valid) of each kind: two rows for each row of ``df``, of a value and of its neighbour."""
    out = []
    for kind, rows in zip(_listed(kinds), made(df, key, kinds), strict=True):
        both = rows.select(key, "kind", F.posexplode(F.array("value", "neighbour")).alias("is_neighbour", "value"))
        out.append(add_column(both, "valid", kind.check, F.col("value")).withColumn("is_neighbour", F.col("is_neighbour") == 1))
    return out


def values(df: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(key, kind, value, valid, neighbour, neighbour_valid): a row for each kind and row of ``df``."""
    out = None
    for kind, rows in zip(_listed(kinds), made(df, key, kinds), strict=True):
        # one expression for a value and its neighbour
        rows = rows.withColumn("_valid", F.transform(F.array("value", "neighbour"), lambda v: kind.check(v)))  # noqa: B023
        rows = rows.select(key, "kind", "value", F.get("_valid", F.lit(0)).alias("valid"), "neighbour", F.get("_valid", F.lit(1)).alias("neighbour_valid"))
        out = rows if out is None else out.unionByName(rows)
    return out
