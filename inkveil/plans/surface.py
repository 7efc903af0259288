"""Queries in Spark SQL alone, over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import sql
from .checks import CHECKS
from .evaluation import email_sql

#: Check in SQL behind each query of the checks.
_SAME = {
    "val_luhn": "luhn_ok", "val_iban": "iban_ok", "val_cf": "cf_ok", "val_piva": "piva_ok", "val_nhs": "nhs_ok", "val_nino": "nino_ok", "val_itin": "itin_ok",
    "val_aba": "aba_ok", "val_sin": "sin_ok", "val_abn": "abn_ok", "val_tfn": "tfn_ok", "val_mrz": "mrz_ok", "val_postcode": "postcode_ok", "val_nanp": "nanp_ok",
}


def sql_checks(spark, sf_dir: str) -> DataFrame:
    """How many of the numbers made from order keys each SQL function accepts, in one pass over the orders."""
    sql.register(spark)
    made = {name: candidate for name, candidate, _, _ in CHECKS if name in _SAME}
    own = ", ".join(f"{_SAME[name]}({candidate}) AS {name}" for name, candidate in made.items())
    pairs = ", ".join(f"'{name}', {name}" for name in made)
    judged = f"SELECT stack({len(made)}, {pairs}) AS (validator, valid) FROM (SELECT {own} FROM parquet.`{sf_dir}/orders.parquet`)"
    return spark.sql(f"SELECT validator, count(*) AS tried, count_if(valid) AS accepted FROM ({judged}) GROUP BY validator")


def sql_detect(spark, sf_dir: str) -> DataFrame:
    """E-mail addresses of all documents, by a LATERAL join."""
    sql.register(spark)
    return spark.sql(
        f"SELECT doc_id, d.start, d.`end`, d.value FROM parquet.`{sf_dir}/documents.parquet`, LATERAL detect(text) d WHERE d.kind = 'emails'"
    )


def queries() -> dict:
    return {"sql_checks": sql_checks, "sql_detect": sql_detect}


def oracle_sql() -> dict:
    parts = [f"SELECT '{n}' AS validator, ({test})::INT AS ok FROM (SELECT {candidate} AS s, o_orderkey FROM orders)" for n, candidate, _, test in CHECKS if n in _SAME]
    checks = f"SELECT validator, count(*) AS tried, sum(ok)::BIGINT AS accepted FROM ({' UNION ALL '.join(parts)}) GROUP BY validator"
    return {"sql_checks": checks, "sql_detect": f'SELECT doc_id, start::INT AS start, (start + len(m))::INT AS "end", m AS value FROM ({email_sql()})'}
