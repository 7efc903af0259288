"""Values and checks of many rows are columns that Spark compiles, and say the same as one nested column."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions import generate
from inkveil.functions import validators as V
from inkveil.plans import variety


@pytest.mark.parametrize("name", ["iban_gb", "nhs"])
def test_steps_equal_the_nested_column(spark, name):
    kind = generate.KINDS[name]
    (checked,) = generate.checked(spark.range(-50, 150), "id", (name,))
    alike = F.col("valid").eqNullSafe(kind.check(F.col("value"))) & (F.col("is_neighbour") | (F.col("value") == kind.make(F.col("id"))))
    assert checked.filter(alike & (F.col("valid") != F.col("is_neighbour"))).count() == 400


def test_odd_values_are_judged_alike(spark):
    odd = ["", " ", "x", "0" * 40, "9" * 19, "de89 3704 0044 0532 0130 00", "ÄÄ12" + "1" * 14, "ZZ" + "9" * 20, "943-476-5919", "12345678901234567890123", None]
    rows, alike = spark.createDataFrame([(x,) for x in odd], "s string"), F.lit(True)
    for name in ("iban_ok", "nhs_ok", "aba_ok", "tfn_ok"):
        rows = V.add_column(rows, name, getattr(V, name), F.col("s"))
        alike = alike & F.col(name).eqNullSafe(getattr(V, name)(F.col("s")))
    assert rows.filter(alike).count() == len(odd)


def test_counts_are_compiled(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    counted = variety.generated_values(spark, str(tmp_path))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    # what is left to be interpreted: later tries of three kinds, and the field of a travel document
    assert plan.count("transform(") <= 10
