"""The SQL surface: every check equals its column form, detect in a LATERAL join; generated values."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions import generate, sql
from inkveil.functions import validators as V


def test_checks_in_sql_equal_the_columns(spark):
    names = sql.register(spark)
    assert len(names) == 17
    keys = spark.range(40).withColumn("id", F.col("id") * 7 - 9)
    made = generate.values(keys, "id").select(F.explode(F.array("value", "neighbour")).alias("s"))
    odd = ["", " ", "x", "4111 1111-1111 1111", "de89 3704 0044 0532 0130 00", "GIR 0AA", "943-476-5919", "L898902C36", "<<<<<<0", "1 212 555 0123", "abc-1", None, "1" * 40]
    rows = made.unionByName(spark.createDataFrame([(x,) for x in odd], "s string")).distinct().cache()
    columns = {n: getattr(V, n) for n in sql.CHECKS if n != "mrz_ok"} | {"mrz_ok": lambda s: V.mrz_ok(F.substring(s, F.lit(1), F.length(s) - 1), F.right(s, F.lit(1)))}
    plain = rows.select("s", *[F.coalesce(f(F.col("s")), F.lit(False)).alias(n) for n, f in columns.items()]).collect()
    rows.createOrReplaceTempView("values_to_check")
    asked = spark.sql("SELECT s, " + ", ".join(f"coalesce({n}(s), false) AS {n}" for n in columns) + " FROM values_to_check").collect()
    assert sorted(map(str, plain)) == sorted(map(str, asked))
    assert all(any(r[n] for r in plain) for n in columns)
    assert spark.sql("SELECT iban_ok(NULL)").first()[0] is None


def test_detect_in_a_lateral_join(spark):
    sql.register(spark)
    texts = [(1, "Write to a@x.org, IBAN DE89 3704 0044 0532 0130 00, card 4111111111111111 or 4111111111111112; www.x.org/a."), (2, None), (3, "nothing")]
    spark.createDataFrame(texts, "k int, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT k, d.* FROM some_texts, LATERAL detect(text) d ORDER BY k, start").collect()
    assert [(r.kind, r.value, r.decision) for r in got] == [
        ("emails", "a@x.org", "replace"), ("iban", "DE89 3704 0044 0532 0130 00", "replace"), ("cards", "4111111111111111", "replace"),
        ("cards", "4111111111111112", "suspect"), ("urls", "www.x.org/a", "replace"),
    ]
    assert all(texts[0][1][r.start : r.end] == r.value for r in got)


def test_values_depend_on_the_key_alone(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    rows = generate.values(keys.repartition(3), "k", ("nhs", "tax_code", "abn")).collect()
    own = {(r.k, r.kind, r.value) for r in rows}
    assert len(rows) == 12 and len(own) == 9 and all(r.valid and not r.neighbour_valid for r in rows)


@pytest.mark.parametrize("kind", ["nhs", "tfn", "tfn_old"])
def test_a_payload_without_a_check_digit_is_passed_over(spark, kind):
    rows = generate.values(spark.range(3000), "id", (kind,)).agg(F.min("valid"), F.max("neighbour_valid"), F.countDistinct("value")).first()
    assert rows[0] and not rows[1] and rows[2] > 2500


def test_few_files_become_many_tasks(spark):
    """Work on the values of a small file is dealt to all cores, in a plan that holds each check once."""
    one = spark.range(600).coalesce(1)
    made = generate.values(one, "id")
    assert made.rdd.getNumPartitions() > 4 and made.count() == 600 * len(generate.KINDS)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[1-79][0-9]{8}") == 1


def test_value_of_a_named_kind(spark):
    made = generate.values(spark.range(40), "id", ("nhs", "iban_it", "tfn_old"))
    assert made.filter(generate.value(F.col("id"), F.col("kind")) != F.col("value")).count() == 0 and made.filter("valid AND NOT neighbour_valid").count() == 120
    assert spark.range(1).select(generate.value(F.col("id"), F.lit("none"))).first()[0] is None
