"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

Everything is a built-in expression over the whole text; no user function runs. The metrics are
length, symbol, stop-word and line ratios. Each row of ``RULES`` names a metric and the closed
interval in which it must lie. A document is kept when no base rule and no row of the table fails.

Defined cases: a null or blank text has no words, fails the base rules and is not kept. Texts of any
length are read whole. Repeated rows are judged one by one. Extra columns pass through
``filter_documents``, and are ignored by ``measure``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it with as was on are be "
    "de la le et les des un une du que qui dans est pour "
    "der die das und ein eine den von mit zu ist im "
    "el los las y en por con del se no su"
).split()

#: (metric, least, most): a document outside an interval is not kept; None leaves that side open.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.5, 12.0),
    ("symbols_per_word", None, 0.1),
    ("marks_per_word", None, 0.3),
    ("upper_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("bare_word_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.3),
    ("ellipsis_line_ratio", None, 0.3),
]


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _repeat_words(windows: Column, ordered: Column) -> Column:
    """Words covered by the windows that occur twice or more: ``ordered`` has (hash, place) sorted."""
    twins = F.filter(
        ordered,
        lambda s, i: (s.h == F.get(ordered, i - 1).h) | (s.h == F.get(ordered, i + 1).h),
    )
    places = F.array_sort(F.transform(twins, lambda s: s.p))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        places,
        start,
        lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")),
        lambda a: a.n,
    )
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeated, covered).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: the columns ``keep``, the base counts and every metric of the table."""
    base = docs.select(*[F.col(k).alias(f"_keep_{k}") for k in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = base.select("*", words(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_all_lines"))
    w = F.col("_w")
    counted = split.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        _length_without(F.col("_t"), r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter("_all_lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        F.when(
            F.size(w) >= 3,
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("_stop"),
        F.size(F.filter(w, lambda x: ~x.rlike("[\\p{L}]"))).alias("_bare"),
        (F.length("_t") - F.length(F.translate("_t", "!?", ""))).alias("_marks"),
        F.regexp_count("_t", F.lit("\\p{Lu}")).alias("_upper"),
        F.regexp_count("_t", F.lit("\\p{L}")).alias("_letters"),
    )
    ordered = counted.select(
        "*",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ).alias("_ordered"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).alias("_dots"),
    )
    return ordered.select(
        *[F.col(f"_keep_{k}").alias(k) for k in keep],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeat_words(F.col("_h"), F.col("_ordered")).alias("n_repeat_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _ratio(F.col("_marks"), F.col("n_words")).alias("marks_per_word"),
        _ratio(F.col("_upper"), F.col("_letters")).alias("upper_ratio"),
        _ratio(F.col("_stop"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("_bare"), F.col("n_words")).alias("bare_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("_dots"), F.col("_n_lines")).alias("ellipsis_line_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def passes(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for metric, least, most in rules:
        if least is not None:
            verdict = verdict & (F.col(metric) >= F.lit(float(least)))
        if most is not None:
            verdict = verdict & (F.col(metric) <= F.lit(float(most)))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, metrics, ``base_failed`` and ``kept`` for each document."""
    return measure(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes(rules))


def filter_documents(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("_text"))
    judged = judge(packed, "_text", rules, keep=("_doc",))
    # The filter must stay above the projections: pushed below them, it would hold every metric's
    # whole expression once for each use. A row number in the condition keeps it where it is.
    numbered = judged.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter("kept AND _row >= 0").select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_rules() -> str:
    parts = []
    for metric, least, most in RULES:
        parts += [f"{metric} >= {float(least)!r}"] if least is not None else []
        parts += [f"{metric} <= {float(most)!r}"] if most is not None else []
    return " AND ".join(parts)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters,
         len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, x))) AS stop,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS bare, len(l) AS nl,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS symbols_per_word,
         CASE WHEN n_words > 0 THEN marks::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS marks_per_word,
         CASE WHEN letters > 0 THEN up::DOUBLE / letters ELSE 0.0 END::DOUBLE AS upper_ratio,
         CASE WHEN n_words > 0 THEN stop::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS stop_word_ratio,
         CASE WHEN n_words > 0 THEN bare::DOUBLE / n_words ELSE 0.0 END::DOUBLE AS bare_word_ratio,
         CASE WHEN nl > 0 THEN n_dup_lines::DOUBLE / nl ELSE 0.0 END::DOUBLE AS dup_line_ratio,
         CASE WHEN nl > 0 THEN dots::DOUBLE / nl ELSE 0.0 END::DOUBLE AS ellipsis_line_ratio
  FROM c),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
