"""Spans: offsets of the engine's notes, recovery from a redacted text, the sweep over overlaps, nearest labels."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import spans
from inkveil.operators.engine import annotations, redact
from inkveil.operators.options import Options, only
from inkveil.plans.recognisers import steps

NAMES = ("email", "card", "iban", "url", "phone", "secret_labelled", "name_before_mail")
OPTIONS = only("emails", "urls", "fiscal", "phones", "secrets", "names")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = [
        (10_001, "Scrivi a mario.rossi@example.it. Grazie."), (10_002, "a@b.it a@b.it a@b.it"), (10_003, None), (10_004, ""), (10_005, "nothing here"),
        (10_006, "Enzo Sbragia a@x.org, 4111 1111 1111 1111 and https://a.example/x?y=1 end"), (10_007, "a@x.org"), (10_008, "è a@x.org. b@y.org. c@z.org."),
        (10_009, "x" * 3000 + " a@x.org " + "y" * 3000), (10_010, ". . a@x.org . . b@x.org . ."),
    ]
    return rows.unionByName(spark.createDataFrame(own, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def truth(docs):
    found = annotations(docs, "doc_id", "text", OPTIONS, steps(*NAMES), keep=("text",), places=True).filter("decision = 'replace'")
    return [r.asDict() for r in found.collect()]


def test_offsets_cut_out_the_values(truth):
    assert len(truth) > 25
    for r in truth:
        value = r["text"][r["start"] : r["end"]].strip(" \t\n\r")
        assert len(value) == len(r["sample"]) and (len(value) <= 4 or value[:2] + value[-2:] == r["sample"][:2] + r["sample"][-2:])
    assert {r["text"][r["start"] : r["end"]] for r in truth if r["doc_id"] == 10_006} == {"Enzo Sbragia", "a@x.org", "4111 1111 1111 1111", "https://a.example/x?y=1"}


def test_terms_and_shields_keep_offsets_right(spark):
    df = spark.createDataFrame([(1, "alpha b@x.org beta gamma a@x.org end")], "i int, t string")
    options = only("emails", always=("beta",), never=("b@x.org", "gamma"))
    got = annotations(df, "i", "t", options, steps("email"), keep=("t",), places=True).collect()
    assert sorted(r.t[r.start : r.end] for r in got) == ["a@x.org", "beta"]
    plain = annotations(df, "i", "t", options, steps("email"))
    assert "start" not in plain.columns


def test_recovered_spans_are_the_notes_own(docs, truth):
    for numbered in (True, False):
        out = redact(docs, "text", only("emails", "urls", "fiscal", "phones", "secrets", "names", numbered=numbered), steps=steps(*NAMES))
        got = spans.recover_spans(out, "doc_id", options=OPTIONS, steps=steps(*NAMES)).collect()
        found = sorted((r.doc_id, r.start, r.end, r.label) for r in got)
        expected = sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in truth)
        # placeholders that touch are one span here and two there
        joined = [x for x in found if "+" not in x[3]]
        assert set(joined) <= set(expected) and sum(x[3].count("+") + 1 for x in found) == len(expected)


def test_texts_that_do_not_fit_have_no_spans(spark):
    rows = [(1, "abc", "x {{EMAIL_1}} c"), (2, "abc", None), (3, "abc", "abc"), (4, "a{{NAME}}b", "a{{NAME}}b"), (5, "abXcd", "{{NAME_1}}X{{DOC_ID_2}}"), (6, "q", "{{NAME}}")]
    got = spans.recover_spans(spark.createDataFrame(rows, "k int, text string, redacted string"), "k", options=OPTIONS, steps=steps("email")).collect()
    assert sorted(tuple(r) for r in got) == [(4, 1, 9, "NAME"), (5, 0, 2, "NAME"), (5, 3, 5, "DOC_ID"), (6, 0, 1, "NAME")]


def test_a_long_list_is_aligned_in_linear_time():
    import time

    text = "".join(f"n{i}@x.org, " for i in range(3000))
    redacted = "".join(f"{{{{EMAIL_{i + 1}}}}}, " for i in range(3000))
    begun = time.perf_counter()
    ways = spans.more_ways(text, redacted, [False] * 3000)
    found = spans.choose([(g, s, e, label, "," not in piece) for g, s, e, label, piece in ways], [0] + [2] * 3000)
    assert [text[a:b] for a, b, _ in found] == [f"n{i}@x.org" for i in range(3000)] and time.perf_counter() - begun < 8


def test_anchors_inside_values_are_told_apart():
    text, redacted = "to m.r@e.it. and k.", "to {{EMAIL_1}}. and {{NAME_1}}."
    whole = [w for w in spans.more_ways(text, redacted, [False, False]) if w[4] == "m.r@e.it"]
    assert whole and spans.first_way("a.b@c.it.", "{{EMAIL}}.")[0][4] == "a.b@c.it"
    text, redacted = "a.b@c.it.d@e.it.", "{{EMAIL_1}}.{{EMAIL_2}}."
    assert [w[4] for w in spans.first_way(text, redacted)] == ["a", "b@c.it.d@e.it"]
    ways = [(g, s, e, label, piece in ("a.b@c.it", "d@e.it")) for g, s, e, label, piece in spans.more_ways(text, redacted, [False, False])]
    assert [text[a:b] for a, b, _ in spans.choose(ways, [0, 1, 1])] == ["a.b@c.it", "d@e.it"]


def swept(rows):
    out, last = [], None
    for s, e in sorted(rows):
        if last is None or s >= last:
            out.append((s, e))
            last = e
    return out


def test_overlaps_in_both_forms(spark):
    r = random.Random(2)
    rows = [(k, s, s + r.randint(0, 9)) for k in (1, 2, None) for s in (r.randint(0, 300) for _ in range(200))]
    rows += rows[:50] + [(3, None, 4), (4, 1, None), (5, 7, 7), (5, 7, 7), (5, -3, 7)]
    df = spark.createDataFrame(rows, "k int, start int, end int").withColumn("_note", F.lit("x"))
    expected = {k: swept([(s, e) for x, s, e in rows if x == k and s is not None and e is not None]) for k in {x[0] for x in rows}}
    long = spans.resolve_overlaps(df.repartition(7), "k")
    assert long.columns == df.columns
    got = [tuple(x)[:3] for x in long.collect()]
    assert sorted(got, key=str) == sorted([(k, s, e) for k, own in expected.items() for s, e in own], key=str)
    lists = df.filter("start IS NOT NULL AND end IS NOT NULL").groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    for k, kept in lists.select("k", spans.keep_first(F.col("s"))).collect():
        assert [tuple(x) for x in kept] == expected[k]
    assert spans.resolve_overlaps(df.filter("false"), "k").collect() == []


def test_a_document_of_a_million_spans(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + F.when(F.col("id") % 2 == 0, 3).otherwise(1)).alias("end"))
    assert spans.resolve_overlaps(df, "k").count() == n // 2


def nearest(row, labels, within):
    k, s, e = row
    behind = [(x[2], -x[1], x[3]) for x in labels if x[0] == k and x[1] <= s]
    ahead = [(-x[1], x[2], x[3]) for x in labels if x[0] == k and x[1] > s]
    b, a = max(behind, default=None), max(ahead, default=None)
    gb, ga = b and max(0, s - b[0]), a and max(0, -a[0] - e)
    first = b is not None and (a is None or gb <= ga)
    gap, name = (gb, b[2]) if first else (ga, a and a[2])
    return (*row, name, gap) if gap is not None and gap <= within else (*row, None, None)


def test_nearest_labels(spark):
    r = random.Random(3)
    own = [(k, s, s + r.randint(1, 9)) for k in (1, 2, 3) for s in (r.randint(0, 2000) for _ in range(80))] + [(9, 1, 2)]
    labels = [(k, s, s + r.randint(1, 12), r.choice("abc")) for k in (1, 2) for s in (r.randint(0, 2000) for _ in range(40))] + [(4, 1, 2, "z")]
    a = spark.createDataFrame(own, "k int, start int, end int")
    b = spark.createDataFrame(labels, "k int, start int, end int, label string")
    got = spans.nearest_label(a, b, "k", 40).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(nearest(x, labels, 40)) for x in own)
    assert any(x.label is None for x in got) and spans.nearest_label(a.filter("false"), b, "k", 40).collect() == []


def test_nearest_labels_over_blocks(spark, monkeypatch):
    """Labels reach over many blocks, and the spans of one document are dealt to many tasks."""
    r = random.Random(4)
    own = [(k, s, s + r.randint(1, 90)) for k in (1, None) for s in (r.randint(-50, 3000) for _ in range(60))]
    labels = [(k, s, s + r.choice([3, 3, 400]), r.choice("abc")) for k in (1, None) for s in (r.randint(-50, 3000) for _ in range(9))]
    a = spark.createDataFrame(own, "k int, start int, end int")
    b = spark.createDataFrame(labels + [(1, None, 3, "z"), (1, 3, None, "z")], "k int, start int, end int, label string")
    for width, within in ((7, 30), (128, 700)):
        monkeypatch.setattr(spans, "BLOCK", width)
        got = spans.nearest_label(a, b, "k", within).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(nearest(x, labels, within)) for x in own)
    alone = spark.createDataFrame([(1, None, 4)], "k int, start int, end int")
    assert [tuple(x) for x in spans.nearest_label(alone, b, "k", 40).collect()] == [(1, None, 4, None, None)]
    one = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    found = spans.nearest_label(one, b, "k", 40).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 1


def test_default_program_gives_offsets(spark):
    df = spark.createDataFrame([(1, "Marco Rossi, tel. 333 1234567, IBAN IT60X0542811101000000123456, Via Garibaldi 3, marco@rossi.it")], "i int, t string")
    got = annotations(df, "i", "t", Options(), keep=("t",), places=True).filter("decision = 'replace'").collect()
    assert len(got) >= 4 and all(r.sample[:2] == r.t[r.start : r.end].strip()[:2] for r in got)
