"""Queries of the recognisers: texts made from keys by one SQL expression that both sides run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.engine import Step, redact
from ..operators.options import PACKS, no_redaction, only
from ..operators.steps import STEPS, SUSPECT_STEPS
from .checks import TAX_CODE, cf_sql, luhn_sql, weighted_sql

_O = "cast(o_orderkey as string)"
_ALL = ("secrets", "urls", "emails", "fiscal", "phones", "addresses", "names", "documents", "records", "quasi_ids", "dates", "amounts")


def steps(*names: str) -> list[Step]:
    chosen = [s for s in STEPS if s.name in names]
    if len(chosen) != len(set(names)):
        raise ValueError(f"unknown steps among {names}")
    return chosen


def _pad(n: int, a: int = 7919, b: int = 31) -> str:
    return f"lpad(cast((o_orderkey * {a} + {b}) % {10**n} as string), {n}, '0')"


def _iban(k: str = "o_orderkey") -> str:
    """A German IBAN of 22 characters with its right check digits; every fifth has wrong ones."""
    check = f"(98 - (({k} % 97) * (1000000 % 97) + 131400) % 97)"
    check = f"CASE WHEN o_orderkey % 5 = 0 THEN ({check} + 1) % 97 ELSE {check} END"
    return f"'DE' || lpad(cast({check} as string), 2, '0') || lpad(cast({k} as string), 18, '0')"


_CARD = "cast(400000 + o_orderkey % 9 as string) || " + _pad(10)
_SSN = f"substr({_pad(9)}, 1, 3) || '-' || substr({_pad(9)}, 4, 2) || '-' || substr({_pad(9)}, 6, 4)"
_ssn_ok = f"substr({_pad(9)}, 1, 3) NOT IN ('000', '666') AND substr({_pad(9)}, 1, 1) <> '9' AND substr({_pad(9)}, 4, 2) <> '00' AND substr({_pad(9)}, 6, 4) <> '0000'"
_g = f"substr({_pad(9)}, 4, 2)::INT"
_itin_ok = f"substr({_pad(9)}, 1, 1) = '9' AND ({_g} BETWEEN 50 AND 65 OR {_g} BETWEEN 70 AND 88 OR {_g} BETWEEN 90 AND 92 OR {_g} BETWEEN 94 AND 99)"
_LETTERS = f"substr({TAX_CODE}, 1, 12) || translate(substr({TAX_CODE}, 13, 3), '0123456789', 'LMNPQRSTUV') || substr({TAX_CODE}, 16, 1)"
_N10, _N9, _N11 = _pad(10), _pad(9), _pad(11)
_nhs_sum = f"(11 - {weighted_sql(_N10, range(10, 1, -1))} % 11) % 11"
_ODD = "o_orderkey % 2 = 1"


def _either(a: str, b: str, test: str = _ODD) -> str:
    return f"CASE WHEN {test} THEN {a} ELSE {b} END"


#: name, steps, text before, candidate, text after (SQL of both sides), label, SQL condition of a replacement,
#: what stays of the candidate in front and behind.
CASES: list[tuple] = [
    ("rec_email_text", ["email"], "'mail to '", f"'c' || {_O} || '@example.com'", "' today'", "EMAIL", "true"),
    ("rec_email_newline", ["email_newline"], "'mail to '", f"'c' || {_O} || '@' || chr(10) || 'example.org'", "' today'", "EMAIL", "true"),
    ("rec_email_spaced", ["email_spaced"], "'mail to '", f"'c' || {_O} || {_either(repr(' @ '), repr('@ '))} || 'example.org'", "', please'", "EMAIL", "true"),
    ("rec_email_obfuscated", ["email_hidden"], "'mail to '", f"'c' || {_O} || {_either(repr(' [at] mail [dot] com'), repr(' at mail.com'))}", "', please'", "EMAIL", _ODD),
    ("rec_url", ["url"], "'see '", f"{_either(repr('https://a.example/'), repr('www.b.example/'))} || {_O}", "'), then'", "URL", "true"),
    ("rec_card", ["card"], "'card '", _CARD, "' paid'", "CARD", luhn_sql(f"({_CARD})")),
    ("rec_iban", ["iban"], "'pay to '", _iban(), "' now'", "IBAN", "o_orderkey % 5 <> 0"),
    ("rec_iban_grouped", ["iban_grouped"], "'pay to '", f"regexp_replace({_iban()}, '^(....)(....)(....)(....)(....)(..)', '{{0}}')", "'. End'", "IBAN", "o_orderkey % 5 <> 0"),
    ("rec_iban_glued", ["iban_glued"], "'pay to '", f"'IBAN' || {_iban()}", "' now'", "IBAN", "o_orderkey % 5 <> 0", "'IBAN'"),
    ("rec_iban_glued_grouped", ["iban_glued_grouped"], "'pay to '", f"'IBAN' || regexp_replace({_iban()}, '^(....)(....)(....)(....)(....)(..)', '{{0}}')", "' now'", "IBAN", "o_orderkey % 5 <> 0", "'IBAN'"),
    ("rec_secret_kv", ["secret_labelled"], "'the password: '", f"{_either(repr('x9-'), repr(chr(34) + 'x9-'))} || {_pad(8)} || {_either(repr(''), repr(chr(34)))}", "' is set'", "SECRET", _ODD),
    ("rec_secret_weak", ["secret_weak"], "'chiave: '", _either("'abc' || " + _pad(5), "'abcdefgh'"), "' fine'", "SECRET", _ODD),
    ("rec_secret_shape", ["secret_shape"], "'key '", f"{_either(repr('ghp_'), repr('ghx_'))} || lpad({_O}, 36, 'a')", "' end'", "SECRET", _ODD),
    ("rec_recovery_phrase", ["recovery_phrase"], "'seed phrase: '", _either("rtrim(repeat('apple river ', 6))", "rtrim(repeat('apple river ', 5))"), "'. 1'", "SECRET", _ODD),
    ("rec_short_code", ["short_code"], _either("'PIN '", "'PINE '"), _pad(5), "' end'", "SECRET", _ODD),
    ("rec_piva", ["partita_iva"], _either("'partita iva '", "'numero '"), _N11, "' fine'", "PARTITA_IVA", f"{_ODD} AND {luhn_sql(_N11)}"),
    ("rec_ssn", ["ssn"], "'number '", _SSN, "' end'", "SSN", f"({_ssn_ok}) OR ({_itin_ok})"),
    ("rec_nino", ["nino"], "'number '", f"chr(cast(65 + o_orderkey % 26 as int)) || 'B' || {_pad(6)} || 'C'", "' end'", "NINO", "chr((65 + o_orderkey % 26)::INT) NOT IN ('D', 'F', 'I', 'Q', 'U', 'V') AND chr((65 + o_orderkey % 26)::INT) <> 'G'"),
    ("rec_nhs", ["nhs"], _either("'NHS number '", "'order number '"), _N10, "' end'", "NHS_NUMBER", f"{_ODD} AND {_nhs_sum} <> 10 AND {_nhs_sum} = substr({_N10}, 10, 1)::INT"),
    ("rec_routing", ["routing_sin"], _either("'routing '", "'invoice '"), _N9, "' end'", "ROUTING_NUMBER", f"{_ODD} AND (substr({_N9}, 1, 2)::INT BETWEEN 0 AND 12 OR substr({_N9}, 1, 2)::INT BETWEEN 21 AND 32 OR substr({_N9}, 1, 2)::INT BETWEEN 61 AND 72 OR substr({_N9}, 1, 2) = '80') AND {weighted_sql(_N9, (3, 7, 1) * 3)} % 10 = 0"),
    ("rec_sin", ["routing_sin"], _either("'SIN '", "'file '"), _N9, "' end'", "SIN", f"{_ODD} AND substr({_N9}, 1, 1) NOT IN ('0', '8') AND {luhn_sql(_N9)}"),
    ("rec_abn_tfn", ["abn_tfn"], _either("'tax file '", "'file '"), _N9, "' end'", "TFN", f"{_ODD} AND {weighted_sql(_N9, (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0"),
    ("rec_account", ["account"], _either("'account number: '", "'amount '"), _N10, "' end'", "BBAN", _ODD),
    ("rec_abi_cab", ["abi_cab"], "'banca '", f"'ABI ' || {_pad(5)} || ' CAB ' || {_either(_pad(5, 31, 7), _pad(4, 31, 7))}", "' fine'", "BBAN", _ODD),
    ("rec_birth_date", ["birth_date"], _either("'nato il '", "'emesso il '"), "lpad(cast(1 + o_orderkey % 28 as string), 2, '0') || '/05/1980'", "' a Roma'", "DATE", _ODD),
    ("rec_amount", ["amount"], _either("'totale '", "'codice '"), f"cast(1 + o_orderkey % 900 as string) || ',' || {_pad(2)}", "' fine'", "AMOUNT", _ODD),
    ("rec_docket", ["record"], _either("'R.G. n. '", "'pagina '"), f"cast(10 + o_orderkey % 9000 as string) || '/2020'", "' del giudice'", "PRATICA", _ODD),
    ("rec_docket_first", ["record_first"], "'causa n. '", f"cast(10 + o_orderkey % 9000 as string) || '/2020'", _either("' R.G. del giudice'", "' del giudice'"), "PRATICA", _ODD),
    ("rec_docket_plain", ["record_plain"], _either("'causa RG '", "'causa '"), f"cast(10 + o_orderkey % 9000 as string) || '/2020'", "' del giudice'", "PRATICA", _ODD),
    ("rec_bban", ["bban"], _either("'coordinate '", "'lotto '"), f"'X ' || {_pad(5)} || ' ' || {_pad(5, 31, 7)} || ' 000' || {_pad(9)}", "' fine'", "BBAN", _ODD),
    ("rec_codice_fiscale", ["codice_fiscale"], "'il codice '", TAX_CODE, "', grazie'", "CODICE_FISCALE", "true"),
    ("rec_codice_fiscale_letters", ["codice_fiscale_letters"], "'il codice '", _LETTERS, "', grazie'", "CODICE_FISCALE", cf_sql(f"({_LETTERS})")),
    ("rec_abn", ["abn_tfn"], _either("'ABN '", "'lot '"), _N11, "' end'", "ABN", f"{_ODD} AND substr({_N11}, 1, 1) <> '0' AND ({weighted_sql(_N11, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0"),
    ("rec_land_registry", ["land"], "'sito al '", _either("'foglio ' || cast(1 + o_orderkey % 99 as string) || ' particella ' || cast(1 + o_orderkey % 77 as string)", "'foglio ' || cast(1 + o_orderkey % 99 as string)"), "', in catasto'", "CATASTO", _ODD),
    ("rec_plate", ["plate"], "'veicolo '", f"{_either(repr('AB'), repr('IO'))} || {_pad(3)} || 'CD'", "' blu'", "TARGA", _ODD),
    ("rec_document", ["document"], _either("'passaporto '", "'lotto '"), f"'YA' || {_pad(7)}", "' valido'", "DOC_ID", _ODD),
    ("rec_phone", ["phone"], _either("'tel. '", "'numero '"), f"'06 ' || {_either(_pad(7), repr('12') )}", "' grazie'", "PHONE", _ODD),
    ("rec_phone_labelled", ["phone_labelled"], _either("'tel..'", "'del..'"), f"'3331' || {_pad(6)}", "' grazie'", "PHONE", _ODD),
    ("rec_address_en", ["address_en"], "'lives at '", f"cast(1 + o_orderkey % 300 as string) || {_either(repr(' Green Hill Road'), repr(' green hill road'))}", "' now'", "ADDRESS", _ODD),
    ("rec_address", ["address"], "'abita in '", f"{_either(repr('Via Garibaldi '), repr('via libera '))} || cast(1 + o_orderkey % 300 as string)", "'. Fine'", "ADDRESS", _ODD),
    ("rec_postcode", ["postcode"], _either("'postcode '", "'model '"), "'M' || cast(1 + o_orderkey % 9 as string) || ' 4BT'", "' end'", "POSTCODE", _ODD),
    ("rec_name_title", ["name_title"], _either("'Sig. '", "'segue '"), "'Verdi'", "' presente'", "NAME", _ODD),
    ("rec_name_dear", ["name_dear"], "'Dear '", _either("'Emma'", "'Customer'"), "', thanks'", "NAME", _ODD),
    ("rec_name_field", ["name_field"], _either("'Nome: '", "'Nota: '"), "'Verdi'", "', fine'", "NAME", _ODD),
    ("rec_mrz", ["mrz"], "'x' || chr(10)", f"'P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<' || chr(10) || {_pad(9)} || {_either('cast((10 - 0) % 10 as string)', repr('<'))} || 'UTO7408122F1204159ZE184226B<<<<<'", "chr(10) || 'y'", "MRZ", "true"),
]
# the blanks of a grouped IBAN, written in each dialect's own replacement syntax
_GROUPS = {"spark": "$1 $2 $3 $4 $5 $6", "duckdb": r"\1 \2 \3 \4 \5 \6"}


#: Texts with something that stays, by key, and what is told of it.
_KEPT = [
    ("'di anni ' || cast(o_orderkey % 90 as string) || ', sesso: M'", "age,sex"),
    ("cast(o_orderkey % 90 as string) || ' years old'", "age"),
    ("'tel. 333 12A' || " + _pad(4), "phones"),
    ("'codice RSSMRA8A' || " + _pad(2) + " || 'H501ZZ'", "codice_fiscale"),
    ("'conto DE12ABCD' || " + _pad(10), "iban"),
    ("'numero ' || " + _pad(15), "cards"),
    ("'numero ' || " + _pad(14), ""),
]
KEPT = f"CASE o_orderkey % {len(_KEPT)} " + " ".join(f"WHEN {i} THEN {text}" for i, (text, _) in enumerate(_KEPT)) + " END"


def queries() -> dict:
    def query(case: tuple):
        def run(spark, sf_dir: str):
            orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
            candidate = case[3].replace("{0}", _GROUPS["spark"])
            texts = orders.select("o_orderkey", F.expr(f"{case[2]} || {candidate} || {case[4]}").alias("text"))
            found = redact(texts, "text", only(*_ALL, packs=PACKS), steps=steps(*case[1]))
            return found.select("o_orderkey", "redacted", F.col("report.total").alias("total"))

        return run

    def documents(spark, sf_dir: str):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        found = redact(docs, "text", only("emails", numbered=False), steps=steps("email"))
        return found.select("doc_id", "redacted", F.col("report.total").alias("total"))

    def negative(spark, sf_dir: str):
        """Conversations hold nothing personal: nothing may change."""
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
        found = redact(rows, "text", only("emails", "urls", "fiscal"), steps=steps("email", "url", "card", "iban", "ssn"))
        return found.select("conv_id", "turn", "redacted", F.col("report.total").alias("total"))

    def kept(spark, sf_dir: str):
        """Ages, sexes and what only looks like a value: reported, never replaced."""
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        texts = orders.select("o_orderkey", F.expr(KEPT).alias("text"))
        chosen = [*steps("age", "sex"), *SUSPECT_STEPS]
        found = redact(texts, "text", only(*_ALL, packs=PACKS), steps=chosen)
        told = F.concat_ws(",", F.transform("report.detected", lambda d: d.kind), F.transform("report.suspects", lambda d: d.kind))
        return found.select("o_orderkey", F.col("redacted"), F.col("report.total").alias("total"), told.alias("told"))

    def everything_off(spark, sf_dir: str):
        """With every switch off no text may change and nothing may be told."""
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        found = redact(docs, "text", no_redaction())
        return found.select("doc_id", "redacted", (F.col("report.total") + F.col("report.suspects_total") + F.col("report.detected_total")).alias("told"))

    def full(spark, sf_dir: str):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        found = redact(docs, "text")
        return found.select("doc_id", "redacted", F.col("report.total").alias("total"), F.col("report.suspects_total").alias("suspects"))

    own = {case[0]: query(case) for case in CASES}
    return own | {"rec_email": documents, "negative_corpus": negative, "redact_full": full, "kept_and_told": kept, "everything_off": everything_off}


def oracle_sql() -> dict:
    out = {}
    for case in CASES:
        name, _, before, candidate, after, label, condition = case[:7]
        candidate = candidate.replace("{0}", _GROUPS["duckdb"])
        kept = case[7] if len(case) > 7 else "''"
        placeholder = f"'{{{{{label}_1}}}}'"
        if name == "rec_ssn":
            placeholder = f"CASE WHEN {_itin_ok} THEN '{{{{ITIN_1}}}}' ELSE '{{{{SSN_1}}}}' END"
        out[name] = (
            f"SELECT o_orderkey, CASE WHEN {condition} THEN {before} || {kept} || {placeholder} || {after} ELSE {before} || {candidate} || {after} END AS redacted, "
            f"CASE WHEN {condition} THEN 1 ELSE 0 END AS total FROM orders"
        )
    pattern = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
    out["rec_email"] = (
        f"SELECT doc_id, regexp_replace(text, '{pattern}', '{{{{EMAIL}}}}', 'g') AS redacted, len(regexp_extract_all(text, '{pattern}'))::INT AS total FROM documents"
    )
    told = f"CASE o_orderkey % {len(_KEPT)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_KEPT)) + " END"
    out["kept_and_told"] = f"SELECT o_orderkey, {KEPT} AS redacted, 0 AS total, {told} AS told FROM orders"
    out["everything_off"] = "SELECT doc_id, text AS redacted, 0 AS told FROM documents"
    out["negative_corpus"] = "SELECT conv_id, turn, text AS redacted, 0 AS total FROM conversations"
    return out
