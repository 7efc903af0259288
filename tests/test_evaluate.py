"""Evaluation against brute force: fuzzy residue, masks."""

import random

import pytest

from inkveil.operators import fuzzy


def plain_edits(value, text):
    """Least edits to any substring: the whole table, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(value, 1):
        row, above = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return min(row) if min(row) <= len(value) // 5 else None


def damaged(r, value, alphabet):
    out = list(value)
    for _ in range(r.randint(0, len(value) // 4 + 1)):
        i, what = r.randrange(len(out)), r.random()
        if what < 0.4:
            out[i] = r.choice(alphabet)
        elif what < 0.7 and len(out) > 2:
            del out[i]
        else:
            out.insert(i, r.choice(alphabet))
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["AB", "ABCD", "ABCDEFGH01234"])
def test_search_equals_the_whole_table(alphabet):
    r, hits = random.Random(len(alphabet)), 0
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 80)))
        values = []
        for _ in range(r.randint(1, 6)):
            n = r.randint(2, 30)
            at = r.randrange(len(text) - n) if len(text) > n else None
            values.append(damaged(r, text[at : at + n], alphabet) if at is not None and r.random() < 0.7 else "".join(r.choice(alphabet) for _ in range(n)))
        found = fuzzy.nearest_edits(values, text)
        assert found == [plain_edits(v, text) for v in values]
        hits += sum(x is not None for x in found)
    assert hits > 200


def test_odd_values():
    assert fuzzy.nearest_edits([], "ABC") == [] and fuzzy.nearest_edits(["", "A", "Z", "AB"], "XAB") == [None, 0, None, 0]
    assert fuzzy.nearest_edits(["ABCDE"], "") == [None]
    # a long text costs a pass over its q-grams
    assert fuzzy.nearest_edits(["QWERTYUIOP"], "AB" * 200_000 + "QWERTXUIOP" + "CD" * 200_000) == [1]


SUSPECTS = "struct<suspects:array<struct<kind:string,sample:string,why:string>>>"


def test_outcomes(spark, monkeypatch):
    value = "AB12-3456-7890"
    rows = [
        (1, f"x {value} y", "x {{IBAN}} y", []),
        (2, "x AB12 3456 7O9O y", "x AB12 3456 7O9O y", []),
        (3, "x AB12 3456 7O90 y", "x AB12 3456 7O90 y", [("i", "AB••••••••••90", "")]),
        (4, "nothing", "nothing", []),
        (5, None, None, None),
        (6, "x AB12 3456 7O90 y", "x AB12 3456 7O90 y", [("i", "AB••90", ""), ("i", "AB", ""), ("i", "ZZ••••••••••90", "")]),
        (7, "x AB12 34\nE\\E 7890", "x AB12 34\nE\\E 7890", [("i", "\\E••••90", "")]),
    ]
    results = spark.createDataFrame([(k, t, a, (s,)) for k, t, a, s in rows], f"doc_id int, text string, redacted string, report {SUSPECTS}")
    gold = [(r[0], value) for r in rows] + [(1, "--"), (1, value), (8, value), (None, value), (2, None), *[(4, f"v{i:04d}") for i in range(50)]]
    for group in (1000, 3):
        monkeypatch.setattr(fuzzy, "GROUP", group)
        got = fuzzy.fuzzy_outcomes(spark.createDataFrame(gold, "doc_id int, value string"), results).collect()
        found = sorted((r.doc_id, r.text_edits, r.redacted_edits, r.outcome) for r in got if r.value == value and r.doc_id != 5)
        assert found == [(1, 0, None, "redacted"), (1, 0, None, "redacted"), (2, 2, 2, "lost"), (3, 1, 1, "flagged"), (4, None, None, "not read"), (6, 1, 1, "lost"), (7, 2, 2, "lost")]
        assert [(r.text_edits, r.outcome) for r in got if r.doc_id == 5] == [(None, "not read")]
        assert [(r.text_edits, r.outcome) for r in got if r.value == "--"] == [(None, "not read")] and len(got) == 59


def test_edits_of_many_rows_at_once_are_those_of_each_pair():
    values = ["A", "AB", "ABC1ABC1A", "ABC1ABC1AB", "12345678901234567890AB", "A1" * 31 + "B", "B2" * 32, "C3" * 45, ""]
    texts = ["", "A", "XXABCIABC1ABXX", "12345678901Z34567890AB", "A1" * 30 + "A1B", "x".upper() * 500 + "B2" * 31 + "2B" + "C3" * 44, "1234567890123456789"]

    def each(v: str, t: str) -> int | None:
        return fuzzy.least_edits(v, t, fuzzy.allowed(v)) if len(v) > 1 else (0 if v and v in t else None)

    expected = [[each(v, t) for v in values] for t in texts]
    assert fuzzy.nearest_edits_of_rows((values, t) for t in texts) == expected
    one = fuzzy.nearest_edits_of_rows(([v], t) for t in texts for v in values)
    assert [x[0] for x in one] == [x for row in expected for x in row]
    assert any(x for row in expected for x in row)
    pairs = [(v, t) for v in values[1:7] for t in texts] * 200
    found = fuzzy.least_edits_of_pairs([v for v, _ in pairs], [t for _, t in pairs]).tolist()
    assert found == [fuzzy.least_edits(v, t, len(v) - 1) if fuzzy.least_edits(v, t, len(v) - 1) is not None else len(v) for v, t in pairs]


def test_bloom_filter_never_refuses_what_was_put_in(spark):
    from pyspark.sql import functions as F

    from inkveil.operators import bloom

    inside, bits = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("w")), bloom.filter_bits(3000)
    assert bits == 65_536 and bloom.filter_bits(0) == 32_768 and bloom.filter_bits(10**12) == bloom.MOST_BITS
    both = spark.range(9000).select("id", F.concat(F.lit("w"), "id").alias("w")).withColumn("maps", bloom.bloom_filter(inside, "w", bits).scalar())
    got = both.withColumn("maybe", bloom.may_contain(F.col("maps"), F.col("w"), bits)).groupBy(F.col("id") < 3000).agg(F.sum(F.col("maybe").cast("int")), F.count("*")).collect()
    counts = {r[0]: (r[1], r[2]) for r in got}
    assert counts[True] == (3000, 3000) and counts[False][0] < 0.03 * 6000
    nothing = spark.range(5).withColumn("maps", bloom.bloom_filter(inside.filter("false"), "w", 32_768).scalar())
    assert not any(r[0] for r in nothing.select(bloom.may_contain(F.col("maps"), F.lit("w1"), 32_768)).collect())


def test_unknown_names_with_and_without_the_filter(spark):
    from inkveil.operators import evaluate

    values = [("Adyam Qur",), ("Adyam  Qur",), ("Mario Qur",), ("Qur de Rossi",), ("Di Qur",), ("Qur",), ("a b c d",), (None,), ("X Y",), ("O'Mario Zed",)] + [(f"n{i} m{i}",) for i in range(300)]
    df = spark.createDataFrame(values, "value string")
    known = spark.createDataFrame([("MARIO",), ("rossi",), (None,), ("n7",), ("di",), ("m250",)], "entry string")
    got = {f: sorted(r[0] for r in evaluate.unknown_names(df, known, filtered=f).collect()) for f in (True, False)}
    # words of fewer than three letters never count, listed or not
    assert got[True] == got[False] == sorted(["Adyam Qur", "Di Qur", "X Y", *[f"n{i} m{i}" for i in range(300) if i != 250]])


def test_overlaps_equal_all_pairs(spark):
    from inkveil.operators import evaluate

    r = random.Random(5)
    draw = lambda n, w: [(r.choice([1, 2, 3, None]), s, s + r.randint(0, w)) for s in (r.randint(0, 300) for _ in range(n))]
    wide, removed = draw(150, 9) + [(9, 1, 5)], draw(40, 12)
    schema = "doc_id int, start int, end int"
    got = evaluate.overlaps(spark.createDataFrame(wide, schema), spark.createDataFrame(removed, schema)).collect()
    expected = {(k, s, e): any(x == k and s < b and a < e for x, a, b in removed) for k, s, e in wide}
    assert {tuple(x)[:3]: x.caught for x in got} == expected and len(got) == len(expected) and len(set(expected.values())) == 2


def test_overlaps_are_dealt_by_their_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    from inkveil.operators import evaluate, tables

    monkeypatch.setattr(tables, "SORTED_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    got = evaluate.overlaps(rows, rows)
    assert got.groupBy(F.spark_partition_id()).count().count() > 15 and got.filter("caught").count() == 1000
