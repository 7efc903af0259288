"""The steps of the engine, in the words of public standards: a shape, and what must hold besides."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as V
from .engine import DIGIT, LONG_WORD, Bound, Candidate, Step, Verdict, always, bound, when
from .names import NAME_STEPS
from .options import Options

#: Codes of the Italian provinces.
PROVINCES = (
    "AG AL AN AO AP AQ AR AT AV BA BG BI BL BN BO BR BS BT BZ CA CB CE CH CL CN CO CR CS CT CZ EN FC FE FG FI FM FR GE GO GR IM IS KR LC LE LI "
    "LO LT LU MB MC ME MI MN MO MS MT NA NO NU OR PA PC PD PE PG PI PN PO PR PT PU PV PZ RA RC RE RG RI RM RN RO SA SI SO SP SR SS SU SV TA TE "
    "TN TO TP TR TS TV UD VA VB VC VE VI VR VT VV"
).split()

_B, _E = r"(?<![\w{])", r"(?![\w}])"
_VALUE = r"[^\s,;\"'{}]{6,}"
_STRONG = (
    "password|passwd|passphrase|pwd|parola d'ordine|api[ _-]?key|apikey|access[ _-]?key|secret(?:[ _-]?key)?|client[ _-]?secret|token|access[ _-]?token|"
    "auth[ _-]?token|bearer[ _-]?token|connection[ _-]?string|licen[cs]e[ _-]?key|private[ _-]?key|otp|chiave api|chiave di licenza|token di accesso"
)
_WEAK = "chiave|credenziali|codice di accesso|codice|key|credential[s]?|code"
#: How issuers say that their tokens begin, which characters follow, and how many.
_ISSUED: list[tuple[str, str, int, int]] = [
    ("AIza", "A-Za-z0-9_-", 35, 35),
    ("AKIA ASIA", "A-Z0-9", 16, 16),
    ("ghp_ gho_ ghr_ ghs_ ghu_", "A-Za-z0-9", 36, 251),
    ("github_pat_", "A-Za-z0-9_", 60, 244),
    ("glpat-", "A-Za-z0-9_-", 20, 64),
    ("npm_", "A-Za-z0-9", 36, 36),
    ("rk_live_ rk_test_ sk_live_ sk_test_", "A-Za-z0-9", 16, 247),
    ("sk-", "A-Za-z0-9_-", 20, 300),
    ("xapp- xoxa- xoxb- xoxp- xoxr- xoxs-", "A-Za-z0-9-", 10, 250),
]
#: Secrets that a standard gives their form: a signed token in three parts (RFC 7519), the token of a header (RFC 6750), a key in text armour (RFC 7468).
_B64URL = "[A-Za-z0-9_-]"
_FORMED = [
    rf"eyJ{_B64URL}{{8,}}\.{_B64URL}{{8,}}\.{_B64URL}{{4,}}",
    r"Bearer [\w.~+/-]{20,}=*",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----",
]


def _token_shapes() -> str:
    """One pattern for all issuers; a token ends where its alphabet does."""
    issued = [rf"(?:{'|'.join(begins.split())})[{letters}]{{{least},{most}}}(?![{letters}])" for begins, letters, least, most in _ISSUED]
    return "|".join([*issued, *_FORMED])


_SECRET_SHAPES = _token_shapes()
_SECRET_STARTS = (*(x.lower() for begins, *_ in _ISSUED for x in begins.split()), "eyj", "bearer ", "-----begin")


def _ctx(c: Candidate, chars: int, words: str) -> Column:
    return c.context(chars).rlike(rf"(?iU)(?<!\w)(?:{words})(?!\w)")


def _or_suspect(check, why: str):
    return when(lambda c: check(c.value), "suspect", why)


def _url(c: Candidate, o: Options) -> Verdict:
    tail = F.regexp_extract(c.value, r"[.,;:!?)\]}'\"»]*$", 0)
    return Verdict(F.lit("replace"), F.left(c.value, F.length(c.value) - F.length(tail)), tail=tail)


def _iban(c: Candidate, o: Options) -> Bound:
    """The candidate is cut to the length of its country; what is over goes back to the text."""
    need = V.iban_length(F.upper(F.left(c.value, F.lit(2))))
    # the number of letters and digits up to each character: where they reach the country's length
    chars = F.filter(F.split(c.value, ""), lambda x: x != "")
    reached = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), need.alias("need"), F.lit(0).alias("cut")),
        lambda a, x: bound(
            a.n + F.when(x.rlike("[A-Za-z0-9]"), 1).otherwise(0),
            lambda n: F.struct(
                (a["at"] + 1).alias("at"), n.alias("n"), a["need"].alias("need"), F.when((a["cut"] == 0) & (n == a["need"]), a["at"] + 1).otherwise(a["cut"]).alias("cut")
            ),
        ),
        lambda a: F.when(a["need"].isNull(), F.length(c.value)).otherwise(a["cut"]),
    )

    def judged(cut: Column) -> Column:
        value, tail = F.left(c.value, cut), F.substr(c.value, cut + 1)
        lines = F.length(F.regexp_replace(value, "[^\n]", "")) <= 1
        good = F.coalesce(lines & ~tail.rlike("^[A-Za-z0-9]") & bound(value, V.iban_ok), F.lit(False))
        return bound(good, lambda g: F.struct(g.alias("good"), F.when(g, value).otherwise(c.value).alias("value"), F.when(g, tail).otherwise(F.lit("")).alias("tail")))

    return Bound(bound(reached, judged), lambda r: Verdict(F.when(r.good, F.lit("replace")).otherwise(F.lit("leave")), r.value, tail=r.tail))


def _piva(c: Candidate, o: Options) -> Verdict:
    number = F.regexp_replace(c.value, r"^(?i)IT\s?", "")
    wanted = c.value.rlike("(?i)^IT") | _ctx(c, 24, r"p\.?\s?iva|partita iva|vat(?: no| number)?|c\.?\s?f\.?|codice fiscale")
    decision = F.when(~wanted, F.lit("leave")).when(V.piva_ok(number), F.lit("replace")).otherwise(F.lit("suspect"))
    return Verdict(decision, c.value, why=F.lit("check digit"), key=number)


def _ssn(c: Candidate, o: Options) -> Verdict:
    contact = _ctx(c, 40, "tel|phone|telephone|mobile|cell|fax|call|telefono|cellulare")
    itin = V.itin_ok(c.value)
    decision = F.when(contact, F.lit("leave")).when(itin | V.ssn_ok(c.value), F.lit("replace")).otherwise(F.lit("suspect"))
    return Verdict(
        decision, c.value, label=F.when(itin, F.lit("ITIN")).otherwise(F.lit("SSN")), kind=F.when(itin, F.lit("itin")).otherwise(F.lit("ssn")), why=F.lit("excluded range")
    )


def _routing_sin(c: Candidate, o: Options) -> Verdict:
    d = V.digits(c.value)
    routing = _ctx(c, 40, "routing|aba|rtn|transit") & V.aba_ok(d)
    sin = _ctx(c, 40, "sin|social insurance|nas|assurance sociale") & V.sin_ok(d)
    return Verdict(
        F.when(routing | sin, F.lit("replace")).otherwise(F.lit("leave")), c.value,
        label=F.when(routing, F.lit("ROUTING_NUMBER")).otherwise(F.lit("SIN")), kind=F.when(routing, F.lit("routing_number")).otherwise(F.lit("sin")),
    )


def _abn_tfn(c: Candidate, o: Options) -> Verdict:
    d = V.digits(c.value)
    abn = _ctx(c, 40, "abn|business number") & V.abn_ok(d)
    tfn = _ctx(c, 40, "tfn|tax file") & V.tfn_ok(d)
    return Verdict(
        F.when(abn | tfn, F.lit("replace")).otherwise(F.lit("leave")), c.value,
        label=F.when(abn, F.lit("ABN")).otherwise(F.lit("TFN")), kind=F.when(abn, F.lit("abn")).otherwise(F.lit("tfn")),
    )


def _mrz(c: Candidate, o: Options) -> Verdict:
    last = F.element_at(F.split(F.regexp_replace(c.value, r"\s+$", ""), "\n"), -1)
    first = F.element_at(F.split(c.value, "\n"), 1)
    ok = F.lit(False)
    for line in (last, first):
        for start, end in ((1, 10), (14, 20), (22, 28)):
            ok = ok | F.coalesce(V.mrz_ok(F.substring(line, start, end - start), F.substring(line, end, 1)), F.lit(False))
    decision = F.when(~c.value.contains("<<"), F.lit("leave")).when(ok, F.lit("replace")).otherwise(F.lit("suspect"))
    return Verdict(decision, c.value, why=F.lit("check digits"))


def phone_plausible(c: Candidate) -> Column:
    """In this order: shapes that are dates or numbering are none; then prefixes; then context and national shapes."""
    v, d = c.value, V.digits(c.value)
    n = F.length(d)
    ctx = _ctx(c, 24, r"tel|tel\.|telefono|phone|mobile|cell|cellulare|fax|call|ph|mob|recapito|whatsapp")
    prefix = v.rlike(r"^\s*(?:\+|00)")
    separators = v.rlike(r"[\s./-]")
    date = v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$") | v.rlike(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$")
    ints = F.transform(F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))
    steps = F.transform(F.slice(ints, 2, F.greatest(F.size(ints) - 1, F.lit(0))), lambda x, i: x - F.get(ints, i) == 1)
    numbering = (F.size(ints) >= 3) & F.forall(F.slice(steps, F.greatest(F.size(steps) - 1, F.lit(1)), F.lit(2)), lambda s: s)
    rest = F.regexp_replace(d, "^(?:00)", "")
    prefixed = F.when(v.rlike(r"^\s*00"), separators & ~rest.rlike("^0") & F.length(rest).between(6, 14)).otherwise(
        ~d.rlike("^0") & F.when(d.rlike("^39"), n.between(8, 13)).otherwise(n.between(6, 14))
    )
    mobile = d.rlike("^3[1-9]") & ((n == 10) | ((n == 9) & ctx))
    landline = d.rlike("^0[1-9]") & n.between(8, 11) & separators
    return (
        F.when(date, F.lit(False))
        .when(v.contains("/") & ~ctx & ~prefix, F.lit(False))
        .when(numbering, F.lit(False))
        .when(prefix, prefixed)
        .when(ctx & n.between(6, 13), F.lit(True))
        .otherwise(mobile | landline)
    )


def _amount(c: Candidate) -> Column:
    currency = c.value.rlike("€|(?i)eur") | c.follows(5).rlike(r"(?i)^\s?(?:€|eur)")
    many = F.length(F.regexp_replace(c.value, "[^.,]", "")) > 1
    return currency | many | _ctx(c, 24, r"totale|importo|saldo|prezzo|imponibile|total|amount|balance|price|€|eur")


def _document(c: Candidate, o: Options) -> Verdict:
    words = r"(?iU)(?<!\w)(?:carta d.identit|passaporto|passport|patente|documento|identity card|driving licen[cs]e|driver.s licen[cs]e|id card)"
    near = F.right(c.before, F.lit(300)).rlike(words) | F.left(c.after, F.lit(120)).rlike(words)
    return Verdict(F.when(near, F.lit("replace")).otherwise(F.lit("suspect")), c.value, why=F.lit("no document is named near"))


def _historic_plate(c: Candidate, o: Options) -> Verdict:
    province = F.upper(F.left(c.value, F.lit(2))).isin(*PROVINCES)
    modern = c.value.rlike(r"^(?:[A-HJ-NPR-TV-Z]{2}[ -]?\d{3}[ -]?[A-HJ-NPR-TV-Z]{2}|[a-hj-npr-tv-z]{2}[ -]?\d{3}[ -]?[a-hj-npr-tv-z]{2})$")
    historic = province & _ctx(c, 40, r"targa|targato|targata|autovettura|veicolo|auto|vehicle")
    return Verdict(F.when(modern | historic, F.lit("replace")).otherwise(F.lit("leave")), c.value)


def _detect(kind: str):
    def judge(c: Candidate, o: Options) -> Verdict:
        small = F.regexp_extract(c.value, r"\d+", 0).try_cast("int")
        return Verdict(F.when(small.isNull() | (small <= 120), F.lit("detect")).otherwise(F.lit("leave")), c.value, kind=F.lit(kind))

    return judge


def _address(c: Candidate, o: Options) -> Verdict:
    """A province code at the end must be a real one, or goes back to the text; capitals need a number."""
    code = F.regexp_extract(c.value, r"\s*\(?([A-Z]{2})\)?$", 1)
    fake = (code != "") & ~code.isin(*PROVINCES) & c.value.rlike(r"\([A-Z]{2}\)$")
    tail = F.when(fake, F.regexp_extract(c.value, r"\s*\([A-Z]{2}\)$", 0)).otherwise(F.lit(""))
    body = F.left(c.value, F.length(c.value) - F.length(tail))
    loud = ~body.rlike("[a-zà-ý]{3}") & ~body.rlike(r"\d")
    stop = body.rlike(r"(?U)^\S+\s+(?:Email|Mail|Libera|Breve|Generale|Definitiva)(?!\w)")
    return Verdict(F.when(loud | stop, F.lit("leave")).otherwise(F.lit("replace")), body, tail=tail)


def _cf_ocr_template() -> str:
    return "AAAAAA99A99A999A"


def cf_repaired(v: Column) -> Column:
    """The tax code with letters and digits that scanners confuse put right; null if it can't be one."""
    up = F.upper(v)
    to_letter, to_digit = ("0125678", "OIZSGTB"), ("OQDILZSGTB", "0001125678")
    parts = []
    for i, kind in enumerate(_cf_ocr_template(), 1):
        x = F.substring(up, i, 1)
        parts.append(F.translate(x, *to_letter) if kind == "A" else F.translate(x, *to_digit))
    return F.concat(*parts)


def _cf_ocr(c: Candidate, o: Options) -> Bound:
    def verdict(fixed: Column) -> Verdict:
        pairs = F.zip_with(F.split(fixed, ""), F.split(F.upper(c.value), ""), lambda a, b: F.when(a != b, 1).otherwise(0))
        changes = F.aggregate(pairs, F.lit(0), lambda a, x: a + x)
        ok = F.coalesce(changes.between(1, 2) & V.cf_ok(fixed), F.lit(False))
        return Verdict(F.when(ok, F.lit("replace")).otherwise(F.lit("leave")), c.value, key=fixed)

    return Bound(cf_repaired(c.value), verdict)


def _iban_ocr(c: Candidate, o: Options) -> Bound:
    up = F.upper(c.value)
    head = F.concat(F.translate(F.left(up, F.lit(2)), "0125678", "OIZSGTB"), F.translate(F.substring(up, 3, 2), "OQDILZSGTB", "0001125678"))

    def verdict(fixed: Column) -> Verdict:
        ok = F.coalesce((fixed != F.upper(c.value)) & F.left(c.value, F.lit(2)).rlike("[A-Za-z]") & V.iban_ok(fixed), F.lit(False))
        return Verdict(F.when(ok, F.lit("replace")).otherwise(F.lit("leave")), c.value, key=fixed)

    return Bound(F.concat(head, F.substr(up, F.lit(5))), verdict)


def _glued_iban(c: Candidate, o: Options) -> Bound:
    """A label word glued to the number: the first cut after which the rest checks."""
    n = F.length(c.value)
    cuts = F.filter(
        F.sequence(F.lit(1), F.greatest(n - 15, F.lit(1))),
        lambda k: F.left(c.value, k).rlike("^[A-Za-z]+$") & F.substr(c.value, k + 1).rlike("^[A-Za-z]{2}[0-9]{2}") & bound(F.substr(c.value, k + 1), V.iban_ok),
    )
    cut = F.coalesce(F.get(cuts, F.lit(0)), F.lit(0))
    return Bound(cut, lambda k: Verdict(F.when(k > 0, F.lit("replace")).otherwise(F.lit("leave")), F.substr(c.value, k + 1), head=F.left(c.value, k)))


def _glued_grouped_iban(c: Candidate, o: Options) -> Bound:
    """A label word glued to a number in groups: the first cut after which the rest, without its separators, checks; of a last group too many, the number alone."""
    n = F.length(c.value)
    start = F.length(F.regexp_extract(c.value, "^[A-Za-z]+", 0))
    cuts = F.filter(
        F.sequence(F.lit(1), F.greatest(start - 2, F.lit(1))),
        lambda k: F.substr(c.value, k + 1).rlike("^[A-Za-z]{2}[0-9]{2}[ -]") & bound(F.substr(c.value, k + 1), V.iban_ok),
    )
    cut = F.coalesce(F.get(cuts, F.lit(0)), F.lit(0))
    return Bound(cut, lambda k: Verdict(F.when(k > 0, F.lit("replace")).otherwise(F.lit("leave")), F.substr(c.value, k + 1, n), head=F.left(c.value, k)))


def _number_alone(c: Candidate, o: Options) -> Bound:
    """The number behind its short sign; the sign goes back to the text."""
    number = F.regexp_extract(c.value, r"\d{1,8}/\d{2,4}$", 0)
    return Bound(number, lambda v: Verdict(F.lit("replace"), v, head=F.left(c.value, F.length(c.value) - F.length(v))))


_MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
_DOMAIN = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
_LOCAL = r"[A-Za-z0-9._%+-]{1,64}"
_AT = r"(?:\s?[\[({]\s?(?:at|chiocciola)\s?[\])}]\s?| chiocciola )"
_DOT = r"(?:\s?[\[({]\s?(?:dot|punto)\s?[\])}]\s?| punto | dot )"

STEPS: list[Step] = [
    Step("secret_shape", "secrets", "SECRET", "CORE", "secrets", 10, rf"(?<![\w-])(?:{_SECRET_SHAPES})", always),
    Step("recovery_phrase", "secrets", "SECRET", "CORE", "secrets", 10, r"(?i)((?:seed|recovery|mnemonic|frase di recupero)(?: phrase)?\s?[:=]\s?)((?-i:[a-z]{3,9}(?: [a-z]{3,9}){11,23}))(?![a-z ])", always, True),
    Step("secret_labelled", "secrets", "SECRET", "CORE", "secrets", 10, rf"(?iU)((?<!\w)(?:{_STRONG})\s?[:=]\s?)({_VALUE})", always, True),
    Step("secret_weak", "secrets", "SECRET", "CORE", "secrets", 10, rf"(?iU)((?<!\w)(?:{_WEAK})\s?[:=]\s?)({_VALUE})", when(lambda c: V.secret_plausible(c.value)), True),
    Step("short_code", "secrets", "SECRET", "CORE", "secrets", 10, r"(?iU)((?<!\w)(?:pin|puk|cvv2?|cvc2?|otp|codice di sicurezza|security code|unlock code)\s?[:=]?\s?)(\d{3,8})(?!\d)", always, True),
    Step("url", "urls", "URL", "CORE", "urls", 20, r"(?iU)(?<![\w@])(?:(?:https?|ftps?)://|www\.)[^\s<>\"{}]+", _url),
    Step("email", "emails", "EMAIL", "CORE", "emails", 30, rf"(?<![A-Za-z0-9._%+-]){_LOCAL}@{_DOMAIN}(?![A-Za-z0-9])", always),
    Step("email_newline", "emails", "EMAIL", "CORE", "emails", 31, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{0,63}}[A-Za-z0-9_%+-]@\r?\n{_DOMAIN}(?![A-Za-z0-9])", always),
    Step("email_spaced", "emails", "EMAIL", "CORE", "emails", 32, rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:[ \t]{{1,2}}@[ \t]{{0,2}}|@[ \t]{{1,2}}){_DOMAIN}(?![A-Za-z0-9])", always),
    Step("email_hidden", "emails", "EMAIL", "CORE", "emails", 33, rf"(?i)(?<![A-Za-z0-9._%+-])(?:{_LOCAL}{_AT}[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})[A-Za-z]{{2,24}}|{_LOCAL} at [A-Za-z0-9-]+(?:\s?[\[({{]\s?(?:dot|punto)\s?[\])}}]\s?[A-Za-z0-9-]+)+)(?![A-Za-z0-9])", always),
    Step("mrz", "mrz", "MRZ", "EN", "fiscal", 39, r"(?<![A-Z0-9<])[A-Z0-9<]{28,44}(?:\r?\n[A-Z0-9<]{28,44}){1,2}(?![A-Z0-9<])", _mrz),
    Step("codice_fiscale", "codice_fiscale", "CODICE_FISCALE", "IT", "fiscal", 40, rf"(?i){_B}[A-Z]{{6}}\d{{2}}[A-EHLMPR-T]\d{{2}}[A-Z]\d{{3}}[A-Z]{_E}", lambda c, o: Verdict(F.lit("replace"), c.value)),
    Step("codice_fiscale_letters", "codice_fiscale", "CODICE_FISCALE", "IT", "fiscal", 40, rf"(?i){_B}[A-Z]{{6}}[0-9L-NP-V]{{2}}[A-EHLMPR-T][0-9L-NP-V]{{2}}[A-Z][0-9L-NP-V]{{3}}[A-Z]{_E}", when(lambda c: V.cf_ok(c.value) & ~c.value.rlike(r"^.{6}\d{2}.\d{2}.\d{3}.$"))),
    Step("iban", "iban", "IBAN", "CORE", "fiscal", 41, rf"(?i){_B}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{_E}", _iban),
    Step("iban_grouped", "iban", "IBAN", "CORE", "fiscal", 41, rf"(?i){_B}[A-Z]{{2}}\d{{2}}(?:[ -]|\r?\n)[A-Z0-9]{{1,30}}(?:(?:[ -]|\r?\n)[A-Z0-9]{{1,30}}){{0,8}}{_E}", _iban),
    Step("iban_glued", "iban", "IBAN", "CORE", "fiscal", 41, rf"(?i){_B}[A-Z]{{3,20}}\d{{2}}[A-Z0-9]{{11,30}}{_E}", _glued_iban),
    Step("card", "cards", "CARD", "CORE", "fiscal", 42, r"(?<!\d)(?<!\d\.)(?<![\w{])[3-6]\d{3}(?:[ .-]?\d{2,6}){2,4}(?![\w}])", when(lambda c: V.luhn_ok(c.value))),
    Step("bban", "bban", "BBAN", "IT", "fiscal", 43, rf"(?i){_B}[A-Z][ -]?\d{{5}}[ -]?\d{{5}}[ -]?[A-Z0-9]{{12}}{_E}", when(lambda c: _ctx(c, 40, "bban|conto|c/c|coordinate|banca|account"))),
    Step("abi_cab", "bban", "BBAN", "IT", "fiscal", 43, r"(?iU)(?<!\w)ABI\s?[:.]?\s?\d{5}\s?[,;-]?\s?CAB\s?[:.]?\s?\d{5}(?:\s?[,;-]?\s?(?:CIN\s?[:.]?\s?[A-Z]|(?:c/c|conto)(?: n\.?)?\s?[:.]?\s?[0-9A-Z]{6,12})(?!\w)){0,2}", always),
    Step("account", "bban", "BBAN", "IT", "fiscal", 43, r"(?iU)((?<!\w)(?:conto corrente|c/c|conto n\.?|account (?:no\.?|number)|numero (?:di )?conto)\s?(?:n\.?)?\s?[:.]?\s?)(\d(?:[ .-]?\d){7,15})(?!\w)", always, True),
    Step("codice_fiscale_ocr", "codice_fiscale", "CODICE_FISCALE", "IT", "fiscal", 44, rf"(?i){_B}[A-Z0-9]{{16}}{_E}", _cf_ocr),
    Step("iban_ocr", "iban", "IBAN", "CORE", "fiscal", 45, rf"(?i){_B}(?=[A-Z0-9]?[A-Z])[A-Z0-9]{{15,34}}{_E}", _iban_ocr),
    Step("partita_iva", "partita_iva", "PARTITA_IVA", "IT", "fiscal", 46, rf"(?i){_B}(?:IT\s?)?\d{{11}}{_E}", _piva),
    Step("ssn", "ssn", "SSN", "EN", "fiscal", 47, rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}", _ssn),
    Step("nino", "nino", "NINO", "EN", "fiscal", 47, rf"(?i){_B}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}", _or_suspect(V.nino_ok, "letters that are not issued")),
    Step("nhs", "nhs_number", "NHS_NUMBER", "EN", "fiscal", 48, rf"{_B}\d{{3}}[ -]?\d{{3}}[ -]?\d{{4}}{_E}", when(lambda c: _ctx(c, 40, "nhs|nhs (?:no|number)") & V.nhs_ok(c.value))),
    Step("routing_sin", "routing_number", "ROUTING_NUMBER", "EN", "fiscal", 49, rf"{_B}\d{{3}}[ -]?\d{{3}}[ -]?\d{{3}}{_E}", _routing_sin),
    Step("abn_tfn", "abn", "ABN", "EN", "fiscal", 49, rf"{_B}(?:\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{3}}|\d{{3}} ?\d{{3}} ?\d{{2,3}}){_E}", _abn_tfn),
    Step("birth_date", "dates", "DATE", "IT", "dates", 50, rf"(?iU){_B}(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{1,2}}°? (?:{_MONTHS}) \d{{4}}){_E}", when(lambda c: c.context(40).rlike(r"(?iU)(?<!\w)(?:nato|nata|nascita|born|date of birth|dob)(?!\w)[^\n]{0,20}$"))),
    Step("document", "documents", "DOC_ID", "IT", "documents", 52, rf"{_B}(?:[A-Z]{{2}}\d{{5}}[A-Z]{{2}}|[A-Z]{{2}} ?\d{{7}}|[A-Z]{{2}}\d{{7}}[A-Z]|[A-Z]\d[A-Z0-9]\d{{6}}[A-Z]){_E}", _document),
    Step("record", "pratica", "PRATICA", "ATTI", "records", 54, r"(?iU)((?<!\w)(?:R\.?G\.?(?:\s?N\.?R\.?|\s?E\.?)?(?:\s?(?:n\.?|num\.?))?|prot(?:ocollo|\.)(?:\s?(?:n\.?|num\.?))?|rep(?:ertorio|\.)(?:\s?n\.?)?|racc(?:olta|\.)(?:\s?n\.?)?|cron(?:ologico|\.)(?:\s?n\.?)?)\s?:?\s?)(\d{1,8}/\d{2,4}|\d{2,8})(?![\d/])", always, True),
    Step("record_first", "pratica", "PRATICA", "ATTI", "records", 54, r"(?iU)(?<![\w/])(?:n\.?|num\.?|nr\.?)\s?(\d{1,8}/\d{2,4})(?=\s?(?:R\.\s?G\.|RG(?!\w)|R\.G\.N\.R\.|RGNR|R\.G\.E\.|RGE(?!\w)|prot(?:ocollo)?(?!\w)|rep(?:ertorio)?(?!\w)|cron(?:ologico)?(?!\w)))", _number_alone),
    Step("record_plain", "pratica", "PRATICA", "ATTI", "records", 54, r"(?U)((?<!\w)RG(?:NR|E)?\s?(?:n\.?\s?)?:?\s?)(\d{1,8}/\d{2,4})(?![\d/])", always, True),
    Step("iban_glued_grouped", "iban", "IBAN", "CORE", "fiscal", 41, rf"(?i){_B}[A-Z]{{3,20}}\d{{2}}(?:[ -][A-Z0-9]{{4}}){{2,7}}(?:[ -][A-Z0-9]{{1,3}})?{_E}", _glued_grouped_iban),
    Step("land", "catasto", "CATASTO", "ATTI", "records", 55, r"(?iU)(?<!\w)(?:foglio|fg\.?)\s?(?:n\.?\s?)?\d{1,5}\s?[,;-]?\s?(?:particella|part\.?|mappale|mapp\.?|p\.lla)\s?(?:n\.?\s?)?\d{1,5}(?:\s?[,;-]?\s?(?:subalterno|sub\.?)\s?\d{1,4})?(?!\w)", always),
    Step("plate", "targhe", "TARGA", "ATTI", "records", 56, rf"{_B}(?:[A-Za-z]{{2}}[ -]?\d{{3}}[ -]?[A-Za-z]{{2}}|[A-Z]{{2}}[ -]?\d{{5,6}}){_E}", _historic_plate),
    Step("age", "age", "AGE", "IT", "quasi_ids", 58, r"(?iU)(?<!\w)(?:di anni \d{1,3}|\d{1,3} anni di età|età(?: di)?:? \d{1,3}|aged? \d{1,3}|\d{1,3} years old)(?!\w)", _detect("age")),
    Step("sex", "sex", "SEX", "IT", "quasi_ids", 58, r"(?iU)(?<!\w)(?:sesso|sex|gender)\s?:\s?(?:maschile|femminile|male|female|m|f)(?!\w)", _detect("sex")),
    Step("phone", "phones", "PHONE", "CORE", "phones", 60, r"(?<![\w{.+])(?:\+|00)?\(?\d(?:[ ./-]?\(?\d\)?){5,14}(?![\w}])", when(phone_plausible)),
    Step("phone_labelled", "phones", "PHONE", "CORE", "phones", 61, r"(?iU)((?<!\w)(?:tel|cell|fax|mob|ph)\.{1,3})(\+?\d(?:[ ./-]?\d){5,14})(?!\w)", always, True),
    Step("amount", "amounts", "AMOUNT", "IT", "amounts", 65, rf"(?:€ ?|(?i:EUR) ?)?{_B}\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}{_E}(?: ?€| ?(?i:EUR)(?![A-Za-z]))?", when(_amount)),
    Step("address", "addresses", "ADDRESS", "IT", "addresses", 70, r"(?U)(?<![\w{])(?:[Vv]ia|VIA|[Vv]iale|VIALE|[Pp]iazza|PIAZZA|[Pp]iazzale|[Cc]orso|CORSO|[Ll]argo|[Vv]icolo|[Ss]trada|[Cc]ontrada|[Ll]ocalità)\s(?:(?:d[aeio]l?l?[aeio']?|degli|dei)\s?)?(?:[A-ZÀ-Ý][\w'.]*|[IVXLC]+)(?:\s(?:(?:d[aeio]l?l?[aeio]?|degli|e)\s)?[A-ZÀ-Ý][\w'.]*){0,3}(?:,?\s?(?:n\.?\s?)?\d{1,4}(?:/?[A-Za-z])?(?![\w/]))?(?:,?\s?-?\s?\d{5}\s[A-ZÀ-Ý][\w']+(?:\s[A-ZÀ-Ý][\w']+){0,2})?(?:\s\([A-Z]{2}\))?", _address),
    Step("address_en", "addresses", "ADDRESS", "EN", "addresses", 71, r"(?<![\w{])\d{1,5}[A-Za-z]?\s(?:[A-Z][A-Za-z'.]*\s){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Close|Way|Highway|Hwy)\b\.?(?:\s(?:North|South|East|West|NE|NW|SE|SW|N|S|E|W)\b)?(?:,\s[A-Z][A-Za-z'.]*(?![\w])(?:\s[A-Z][A-Za-z'.]*(?![\w])){0,2}){0,3}(?:,?\s(?:[A-Z]{2}\s)?\d{5}(?:-\d{4})?|,?\s[A-Z]{1,2}\d[A-Z0-9]?\s?\d[A-Z]{2})?", always),
    Step("postcode", "addresses", "POSTCODE", "EN", "addresses", 71, rf"{_B}[A-Z]{{1,2}}\d[A-Z0-9]? ?\d[A-Z]{{2}}{_E}", when(lambda c: _ctx(c, 40, "postcode|post code|deliver to|delivery|ship to|address|send to") & V.postcode_ok(c.value))),
]

_DIGIT = (DIGIT,)
#: What a text must have for a step to find anything; see ``Step.needs``. Steps that are not listed look at every text.
_NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "secret_shape": (_SECRET_STARTS, ("_", "-", "=AIza", "=AKIA", "=ASIA", "=yJ", "=Bearer ")),
    "recovery_phrase": (("seed", "recovery", "mnemonic", "frase di recupero"), (":", "=")),
    "secret_labelled": (("passw", "passphrase", "pwd", "parola d'ordine", "key", "secret", "token", "connection", "otp", "chiave"), (":", "=")),
    "secret_weak": (("chiave", "credenzial", "codice", "key", "credential", "code"), (":", "=")),
    "short_code": (("pin", "puk", "cvv", "cvc", "otp", "codice di sicurezza", "security code", "unlock code"), _DIGIT),
    "url": (("://", "www."), (":", "ww")),
    "email": (("@",),),
    "email_newline": (("@",),),
    "email_spaced": (("@",),),
    "email_hidden": ((r"re:chiocciola|at\s?[\])}]|(?:dot|punto)\s?[\])}]",), ("cc", "]", ")", "}")),
    "mrz": (("<<",),),
    "codice_fiscale": (_DIGIT,),
    "codice_fiscale_letters": ((LONG_WORD,),),
    "codice_fiscale_ocr": ((LONG_WORD,),),
    "iban_ocr": ((LONG_WORD,),),
    "iban": (_DIGIT,),
    "iban_grouped": (_DIGIT,),
    "iban_glued": (_DIGIT,),
    "iban_glued_grouped": (_DIGIT,),
    "record_first": (("/",), _DIGIT),
    "record_plain": (("=RG",), ("/",), _DIGIT),
    "card": (_DIGIT,),
    "bban": (_DIGIT,),
    "abi_cab": (("abi",), ("cab",), _DIGIT),
    "account": (("conto", "c/c", "account"), _DIGIT),
    "partita_iva": (_DIGIT,),
    "ssn": (_DIGIT, ("-",)),
    "nino": (_DIGIT,),
    "nhs": (_DIGIT,),
    "routing_sin": (_DIGIT,),
    "abn_tfn": (_DIGIT,),
    "birth_date": (_DIGIT,),
    "document": (_DIGIT,),
    "record": (_DIGIT,),
    "land": (("foglio", "fg"), _DIGIT),
    "plate": (_DIGIT,),
    "age": (("anni", "età", "age", "years old"), _DIGIT),
    "sex": (("sesso", "sex", "gender"), (":",)),
    "phone": (_DIGIT,),
    "phone_labelled": (("tel.", "cell.", "fax.", "mob.", "ph."), _DIGIT),
    "amount": (_DIGIT,),
    "address": (("via", "piazz", "corso", "largo", "vicolo", "strada", "contrada", "località"),),
    "address_en": (_DIGIT,),
    "postcode": (_DIGIT,),
    "suspect_phone": (("tel", "phone", "cell", "mobile", "fax"), _DIGIT),
    "suspect_cf": (_DIGIT,),
    "suspect_iban": (_DIGIT,),
    "suspect_digits": (_DIGIT,),
}
STEPS = [replace(s, needs=_NEEDS.get(s.name, ()), replaces=s.name not in ("age", "sex")) for s in STEPS] + NAME_STEPS

_LABEL_PHONE = r"(?iU)((?<!\w)(?:tel|telefono|phone|cell|mobile|fax)\.?\s?:?\s?)([0-9A-Z][0-9A-Z ./-]{5,18}[0-9A-Z])(?!\w)"


def _count(v: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(v, f"[^{pattern}]", ""))


def _suspect(rule, why: str):
    def judge(c: Candidate, o: Options) -> Verdict:
        return Verdict(F.when(F.coalesce(rule(c.value), F.lit(False)), F.lit("suspect")).otherwise(F.lit("leave")), c.value, why=F.lit(why))

    return judge


#: Looks at what is left after all steps; never replaces.
SUSPECT_STEPS: list[Step] = [
    Step("suspect_phone", "phones", "PHONE", "CORE", "phones", 99, _LABEL_PHONE, _suspect(lambda v: (_count(v, "0-9") >= 5) & v.rlike("[A-Za-z]"), "phone with letters"), True),
    Step("suspect_cf", "codice_fiscale", "CODICE_FISCALE", "IT", "fiscal", 99, rf"{_B}[A-Z0-9]{{16}}{_E}", _suspect(lambda v: _count(v, "A-Z").between(6, 11) & _count(v, "0-9").between(5, 10), "almost a tax code")),
    Step("suspect_iban", "iban", "IBAN", "CORE", "fiscal", 99, rf"(?i){_B}[A-Z]{{2}}[0-9A-Z]{{2}}[0-9A-Z]{{11,30}}{_E}", _suspect(lambda v: (_count(v, "A-Za-z") >= 3) & (_count(v, "0-9") >= 8) & (F.length(v) != 16), "almost an IBAN")),
    Step("suspect_digits", "cards", "CARD", "CORE", "fiscal", 99, rf"{_B}\d{{15,16}}{_E}", _suspect(lambda v: F.length(v).isin(15, 16), "as long as a card")),
]
SUSPECT_STEPS = [replace(s, needs=_NEEDS.get(s.name, ()), replaces=False) for s in SUSPECT_STEPS]
