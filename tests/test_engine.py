"""The redaction engine: a golden text, negatives, term lists, detect-only, numbering, suspects."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.operators.engine import annotations, flatten_numbers, redact
from inkveil.operators.options import KINDS, Options, from_dict, from_form, no_redaction, only, terms
from inkveil.plans.recognisers import steps


def run(spark, texts, options=None, names=()):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = redact(df, "t", options or only("emails", "fiscal", "secrets", "phones"), steps=steps(*names) if names else None)
    return [(r.redacted, r.report) for r in found.orderBy("i").collect()]


def test_golden(spark):
    text = "Write to ann@example.com or ANN@EXAMPLE.COM, card 4111 1111 1111 1111, not 4111111111111112."
    (out, report), = run(spark, [text], names=("email", "card"))
    assert out == "Write to {{EMAIL_1}} or {{EMAIL_1}}, card {{CARD_1}}, not 4111111111111112."
    assert report.counts == {"emails": 2, "cards": 1} and report.total == 3


def test_null_empty_and_clean_text_are_unchanged(spark):
    got = run(spark, [None, "", "On 12/05/2024 the board met, 1 2 3 4."], names=("email", "card", "phone"))
    assert [g[0] for g in got] == [None, "", "On 12/05/2024 the board met, 1 2 3 4."]
    assert all(g[1].total == 0 for g in got)


def test_quoted_secret_and_dotted_numbers_stay(spark):
    texts = ['token = "0123456789abcdef0123"', "host 10.20.30.40 up", "{{NAME_3}} wrote"]
    assert [g[0] for g in run(spark, texts, names=("secret_labelled", "phone", "email"))] == texts


def test_never_beats_always_and_detect_only_keeps(spark):
    options = only("emails", always=("alpha", "a@x.org"), never=("a@x.org",), detect_only=("emails",))
    (out, report), = run(spark, ["alpha a@x.org b@x.org"], options, names=("email",))
    assert out == "{{TERM_1}} a@x.org b@x.org"
    assert report.detected_counts == {"emails": 1} and report.counts == {"terms": 1}


def test_iban_surplus_goes_back(spark):
    (out, _), = run(spark, ["IBAN IT60 X054 2811 1010 0000 0123 456 end"], names=("iban_grouped",))
    assert out == "IBAN {{IBAN_1}} end"


def test_excluded_ranges_are_suspects(spark):
    (out, report), = run(spark, ["id 000-12-3456"], names=("ssn",))
    assert out == "id 000-12-3456"
    assert [(s.kind, s.sample) for s in report.suspects] == [("ssn", "00•••••••56")]


def test_flatten(spark):
    df = spark.createDataFrame([("{{DOC_ID_12}} {{NAME}} {{NAME_1}}",)], "t string")
    assert df.select(flatten_numbers(F.col("t"))).first()[0] == "{{DOC_ID}} {{NAME}} {{NAME}}"


def test_names(spark):
    text = "Dear John Smith, the patient Mario Rossi called. Banca Rossi SpA did not."
    (out, _), = run(spark, [text], only("names"), names=("name_dear", "name_declared_role", "name_runs"))
    assert out == "Dear {{NAME_1}}, the patient {{NAME_2}} called. Banca Rossi SpA did not."


def test_options():
    assert terms(["b", "Ab", "AB", "abcd"]) == ("abcd", "Ab")
    assert only("emails").emails and not only("emails").urls
    assert not no_redaction().any_switch() and Options().any_switch()
    assert from_dict({"dates": "on", "prose": "", "segnala": "x"}).dates
    assert from_form({"amounts": False}, "legal_mail").dates and not from_form({"amounts": False}, "legal_mail").amounts
    for bad in (lambda: only("nothing"), lambda: Options(packs=("XX",)), lambda: Options(detect_only=("zzz",)), lambda: from_form({}, "none")):
        with pytest.raises(ValueError):
            bad()
    assert len(set(KINDS)) == len(KINDS)


def test_numbers_are_linear_in_the_findings():
    import time

    from inkveil.operators.engine import REF, _number

    def text(n):
        return " ".join("{{EMAIL" + REF + "a." + "abcdefghij"[i % 10] * (i + 1) + "}}" for i in range(n))

    n = 2000
    refs = ["a." + "abcdefghij"[i % 10] * (i + 1) for i in range(n)]
    start = time.perf_counter()
    out = _number(text(n), refs, [f"k{i % 500}" for i in range(n)])
    assert time.perf_counter() - start < 2 and out.split()[501] == "{{EMAIL_2}}" and out.split()[-1] == "{{EMAIL_500}}"


def test_annotations_are_what_redact_decides(spark):
    options = Options(always=("alpha",), never=("b@x.org",))
    texts = ["alpha a@x.org b@x.org 000-12-3456 and 4111111111111112 there", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = annotations(df, "i", "t", options).collect()
    reports = {r.i: r.report for r in redact(df, "t", options).collect()}
    assert Counter(r.i for r in rows if r.decision == "replace") == Counter({i: p.total for i, p in reports.items() if p.total})
    assert sorted((s.kind, s.sample) for s in reports[0].suspects) == sorted((r.kind, r.sample) for r in rows if r.decision == "suspect")
    assert {r.kind for r in rows if r.decision == "replace"} == {"terms", "emails"} and any(r.decision == "suspect" for r in rows)


def test_conditions_of_steps_never_change_a_result(spark):
    """The whole program with and without the necessary conditions, over documents and over every query's own texts."""
    from dataclasses import replace

    from inkveil.operators.steps import STEPS, SUSPECT_STEPS
    from inkveil.plans.recognisers import CASES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").limit(40)
    made = [orders.select(F.expr(f"{c[2]} || {c[3].replace('{0}', '$1 $2 $3 $4 $5 $6')} || {c[4]}").alias("text")) for c in CASES]
    odd = spark.createDataFrame([("PASſWORD: abc12345 end",), ("İl pin 12345",), ("PIN ١٢٣٤",), ("EiKey: abc123x9",), ("a.b at c dot] d",), ("x [AT ] mail. com",)], "text string")
    for more in (*made, odd):
        docs = docs.unionByName(more)
    docs = docs.distinct().repartition(4).cache()
    options = Options(dates=True, amounts=True, packs=("CORE", "IT", "EN", "ATTI"))
    whole = [*STEPS, *SUSPECT_STEPS]
    assert sum(bool(s.needs) for s in whole) > 50
    with_needs = redact(docs, "text", options, steps=whole).select("text", "redacted", F.to_json("report").alias("report"))
    without = redact(docs, "text", options, steps=[replace(s, needs=()) for s in whole]).select("text", "redacted", F.to_json("report").alias("report"))
    assert Counter(map(tuple, with_needs.collect())) == Counter(map(tuple, without.collect()))


def test_arrow_results_are_given_out_in_pieces():
    import pyarrow as pa

    from inkveil.operators.engine import PIECE, by_pieces

    texts = [None if i % 7 == 0 else f"t{i}" for i in range(2 * PIECE + 3)]
    batches = [(pa.array(texts), pa.array([[str(i)] for i in range(len(texts))])), (pa.array([], pa.string()), pa.array([], pa.list_(pa.string())))]
    pieces = list(by_pieces(lambda t, r: None if t is None else t + r[0], batches))
    assert [len(p) for p in pieces] == [PIECE, PIECE, 3]
    assert [x for p in pieces for x in p.to_pylist()] == [None if t is None else f"{t}{i}" for i, t in enumerate(texts)]


def test_rows_keep_their_order_over_pieces(spark):
    from inkveil.operators.engine import PIECE
    from inkveil.operators.steps import STEPS

    n = 5 * PIECE + 7
    rows = spark.range(0, n, 1, 1).withColumn("text", F.when(F.col("id") % 5 != 0, F.concat(F.lit("oggi Marco Rossi firma "), F.col("id").cast("string"))))
    got = redact(rows, "text", steps=[s for s in STEPS if s.name == "name_runs"]).select("id", "redacted").collect()
    assert {r.id: r.redacted for r in got} == {i: None if i % 5 == 0 else f"oggi {{{{NAME_1}}}} firma {i}" for i in range(n)}


def test_words_are_looked_for_only_where_their_steps_ask(spark):
    from inkveil.operators.engine import LONG_WORD, MOST_CONDITIONS, begin, find_conditions
    from inkveil.operators.steps import STEPS, SUSPECT_STEPS

    texts = ["the password is lost", "the password: lost", "foglio nove", "foglio 9", "dear client", "abcdefghijklmno", "abcdefghijklmn opq", None]
    work, known = find_conditions(begin(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t"), [*STEPS, *SUSPECT_STEPS])
    known, rows = dict(known), work.orderBy("i").collect()

    def has(i: int, x: str) -> bool:
        return bool(rows[i][f"_has{known[x] // MOST_CONDITIONS}"] >> known[x] % MOST_CONDITIONS & 1)

    assert [has(i, "passw") for i in (0, 1)] == [False, True]
    assert [has(i, "foglio") for i in (2, 3)] == [False, True]
    assert has(4, "client")  # no step with this word has a quick condition
    assert [has(i, LONG_WORD) for i in (5, 6, 7)] == [True, False, False]
    assert not any(s.needs == () for s in [*STEPS, *SUSPECT_STEPS] if s.mark is None)


def test_guards_of_words_never_change_a_result(spark):
    from dataclasses import replace

    from inkveil.operators.steps import STEPS, SUSPECT_STEPS

    texts = [
        "key AIza" + "b" * 35 + " x", "key AKIA" + "B" * 16, "ASIA" + "C" * 16, "ghp_" + "d" * 36, "glpat-" + "e" * 20, "xapp-" + "f" * 10, "npm_" + "g" * 36,
        "eyJ" + "h" * 9 + "." + "i" * 9 + "." + "j" * 5, "Bearer " + "k" * 20, "bearer " + "k" * 20, "-----BEGIN PRIVATE KEY-----abc-----END PRIVATE KEY-----",
        "seed phrase: " + "apple " * 12 + ".", "seed phrase= " + "apple " * 12 + ".", "Sesso : F", "sesso F", "see www.example.org now", "FTP://x.example/y",
        "ann at mail [dot] com", "ann chiocciola mail punto it", "ann (at) mail.com", "parla l'On. Rossi", "l'Ing. Verdi e l'ing.Bianchi", "éon. Rossi", "station. Rossi", "Sig.ra Verdi",
        "cf RSSMRA85MI0A562S x", "cf RSSMRA8LM1LA5LIS x", "cf R55MRA85M10A562S x", "iban GB82WEST1234S698765432", "iban DEB9370400440532013OOO", "iban NOOOOOOOOOOOOOO", "ITbO" + "X" * 23,
        "abc@x.org", "ſecretKey: abc123x9", "İl pin 1234", "", None,
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2).cache()
    options = Options(dates=True, amounts=True, packs=("CORE", "IT", "EN", "ATTI"))
    whole = [*STEPS, *SUSPECT_STEPS]
    got, wanted = (
        Counter(map(tuple, redact(docs, "text", options, steps=own).select("text", "redacted", F.to_json("report").alias("report")).collect()))
        for own in (whole, [replace(s, needs=()) for s in whole])
    )
    assert got == wanted and sum(text != redacted for text, redacted, _ in got) > 20
