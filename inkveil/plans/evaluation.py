"""Queries of the evaluation: values that survive with wrong characters, masks and windows, spans, overlaps, nearest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import blocks
from ..functions.text import finished
from ..operators import evaluate, fuzzy, spans
from ..operators.engine import annotations, redact
from ..operators.options import only
from ..operators.steps import STEPS, SUSPECT_STEPS
from ..operators.tables import spread

_CHECK = "(98 - ((o_orderkey % 97) * (1000000 % 97) + 131400) % 97)"
_IBAN = f"('DE' || lpad(cast({_CHECK} as string), 2, '0') || lpad(cast(o_orderkey as string), 18, '0'))"
_WRONG = f"(substr({_IBAN}, 1, 9) || cast((cast(substr({_IBAN}, 10, 1) as int) + 1) % 10 as string) || substr({_IBAN}, 11, 12))"
#: As a scanner reads it: right, with a letter for a digit, with a wrong digit, with every second character unread, or in groups with a wrong digit.
_READ = (
    f"CASE o_orderkey % 5 WHEN 0 THEN {_IBAN} WHEN 1 THEN substr({_IBAN}, 1, 9) || 'B' || substr({_IBAN}, 11, 12) WHEN 2 THEN {_WRONG} "
    + "WHEN 3 THEN "
    + " || '#' || ".join(f"substr({_IBAN}, {i}, 1)" for i in range(1, 23, 2))
    + f" ELSE substr({_WRONG}, 1, 4) || ' ' || substr({_WRONG}, 5, 4) || '-' || substr({_WRONG}, 9, 14) END"
)
_TEXT = f"'pay to ' || {_READ} || ' now, order ' || cast(o_orderkey as string)"


def fuzzy_outcomes(spark, sf_dir: str) -> DataFrame:
    """Where each account number of a scan went: redacted, flagged, lost or never read."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    texts = orders.select("o_orderkey", F.expr(_TEXT).alias("text"))
    steps = [s for s in [*STEPS, *SUSPECT_STEPS] if s.name in ("iban", "suspect_iban")]
    results = redact(texts, "text", only("fiscal", numbered=False), steps=steps)
    gold = orders.select("o_orderkey", F.expr(_IBAN).alias("value"))
    judged = fuzzy.fuzzy_outcomes(gold, results, "o_orderkey")
    return judged.select("o_orderkey", "value", "text_edits", "redacted_edits", "outcome")


_SAMPLE = f"(substr({_IBAN}, 5, 2) || '••••' || substr({_IBAN}, 11, 2))"


def mask_matches(spark, sf_dir: str) -> DataFrame:
    """Every window of a number that a mask may stand for."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", F.expr(f"{_IBAN} || ' ' || cast(o_orderkey * 7919 as string)").alias("text"), F.expr(_SAMPLE).alias("sample"))
    found = rows.withColumn("windows", fuzzy.mask_windows(F.col("text"), F.col("sample")))
    return found.select("o_orderkey", "sample", F.size("windows").alias("n"), F.array_join("windows", "|").alias("windows"))


_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"


def email_spans(spark, sf_dir: str) -> DataFrame:
    """Where the e-mail addresses of all documents lie, from the engine's own notes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotations(docs, "doc_id", "text", only("emails"), [s for s in STEPS if s.name == "email"], places=True)
    return found.select("doc_id", "start", "end", "label")


def recovered_spans(spark, sf_dir: str) -> DataFrame:
    """The same from the two texts alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    steps = [s for s in STEPS if s.name == "email"]
    return spans.recover_spans(redact(docs, "text", only("emails"), steps), "doc_id", options=only("emails"), steps=steps)


_MARKED = "l_suppkey AS k, l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 20000 AS start, (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 20000 + cast(l_quantity as int) AS \"end\""


def _spark(sql: str) -> list[str]:
    return [x.strip() for x in sql.replace('"end"', "`end`").split(", ")]


def overlap_sweep(spark, sf_dir: str) -> DataFrame:
    """Spans of each supplier that a sweep keeps."""
    marked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_spark(_MARKED))
    return spans.resolve_overlaps(marked, "k").select("k", "start", "end")


_LABELS = "p_partkey % 10 AS k, p_size * 400 AS start, p_size * 400 + 6 AS \"end\""


def _labelled(spark, sf_dir: str) -> DataFrame:
    marked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_returnflag", *_spark(_MARKED.replace("l_suppkey", "l_suppkey % 10")))
    labels = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand", *_spark(_LABELS)).groupBy("k", "start", "end").agg(F.min("p_brand").alias("label"))
    return spans.nearest_label(marked, labels, "k", 120)


def nearest_labels(spark, sf_dir: str) -> DataFrame:
    """The label nearest to each span of the same document, within 120 characters."""
    return _labelled(spark, sf_dir).select("l_orderkey", "l_linenumber", "start", "label", "label_gap")


def losses_by_label(spark, sf_dir: str) -> DataFrame:
    """Spans and lost ones (here: returned) by the nearest label."""
    lost = F.sum((F.col("l_returnflag") == "R").cast("int"))
    return _labelled(spark, sf_dir).groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("spans"), lost.alias("lost"))


def first_examples(spark, sf_dir: str) -> DataFrame:
    """Five parts of each brand that came back, and how many there are."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select("l_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name")
    found = evaluate.first_examples(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "p_partkey")
    return found.select("p_brand", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def handed_out(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations as they are handed out: every third is emptied, every second carries a caveat."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.when(F.col("turn") % 3 == 0, F.lit(" \n")).otherwise(F.col("text"))
    caveat = F.when(F.col("turn") % 2 == 0, F.lit("read from an image"))
    return turns.select("conv_id", "turn", finished(text, "(empty)", caveat, F.col("role")).alias("document"))


#: A Markdown text by key: a heading, a list, numbers, a quote, a table, code and paragraphs, as SQL of both sides.
_NL = "chr(10)"
_PAGE = (
    f"repeat('#', cast(o_orderkey % 6 + 1 as int)) || ' Order ' || cast(o_orderkey as string) || {_NL} || repeat('- item' || {_NL}, cast(o_orderkey % 4 as int)) || 'A paragraph' || {_NL} || 'of two lines' || {_NL} "
    f"|| repeat('1. number' || {_NL}, cast(o_orderkey % 3 as int)) || '> said' || {_NL} || '|a|b|' || {_NL} || '|-|-|' || {_NL} || repeat('|1|2|' || {_NL}, cast(o_orderkey % 5 as int)) || '---' || {_NL} "
    f"|| '```' || {_NL} || '# no heading' || {_NL} || '- no item' || {_NL} || CASE WHEN o_orderkey % 2 = 0 THEN '```' || {_NL} || 'end' ELSE '' END"
)


def blocks_by_kind(spark, sf_dir: str) -> DataFrame:
    """Blocks of Markdown texts by kind, with their levels and table cells added up."""
    pages = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_PAGE).alias("text"))
    found = pages.select(F.inline(blocks(F.col("text"))))
    cells = F.size(F.flatten("cells"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels"), F.sum(cells).alias("cells"), F.sum(F.length("text")).alias("chars"))


def queries() -> dict:
    own = (blocks_by_kind, first_examples, handed_out, fuzzy_outcomes, mask_matches, email_spans, recovered_spans, overlap_sweep, nearest_labels, losses_by_label)
    return {f.__name__: f for f in own}


def _plain(text: str) -> str:
    return f"upper(regexp_replace({text}, '[^0-9A-Za-z]', '', 'g'))"


def _least(text: str, value: str, n: int, k: int) -> str:
    """Least edits between a value of n characters and all windows of n - k to n + k characters, or null above k."""
    windows = f"flatten(list_transform(range({n - k}, {n + k + 1}), lambda w: list_transform(range(1, len({text}) - w + 2), lambda i: levenshtein(substr({text}, i, w), {value}))))"
    return f"(SELECT CASE WHEN m <= {k} THEN m::INT END FROM (SELECT list_min({windows}) AS m))"


def email_sql() -> str:
    """(doc_id, m, start) of all e-mail addresses: lengths of the pieces between them and of those before, added up."""
    return (
        "SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: len(p))), 0) AS start "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS ms, string_split_regex(text, '{_EMAIL}') AS ps FROM documents), range(1, len(ms) + 1) AS r(i)"
    )


def oracle_sql() -> dict:
    k = 22 // fuzzy.CHARS_PER_EDIT
    mask = "(substr(x, 1, 2) || repeat('•', len(x) - 4) || right(x, 2))"
    cover = (
        f"len(list_filter(range(1, len(after) - len(sample) + 2), lambda i: substr(after, i, 2) = left(sample, 2) AND substr(after, i + len(sample) - 2, 2) = right(sample, 2) "
        f"AND levenshtein({_plain('substr(after, i, len(sample))')}, value) <= {k})) > 0"
    )
    outcomes = (
        f"WITH rows AS (SELECT o_orderkey, {_IBAN} AS value, {_READ} AS x, {_TEXT} AS text FROM orders), "
        f"results AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN replace(text, x, '{{{{IBAN}}}}') ELSE text END AS after, CASE WHEN o_orderkey % 5 = 1 THEN {mask} END AS sample FROM rows), "
        f"plain AS (SELECT *, {_plain('text')} AS a, {_plain('after')} AS b FROM results), "
        f"near AS (SELECT *, {_least('a', 'value', 22, k)} AS text_edits, {_least('b', 'value', 22, k)} AS redacted_edits FROM plain) "
        "SELECT o_orderkey, value, text_edits, redacted_edits, CASE WHEN text_edits IS NULL THEN 'not read' WHEN redacted_edits IS NULL THEN 'redacted' "
        f"WHEN sample IS NOT NULL AND {cover} THEN 'flagged' ELSE 'lost' END AS outcome FROM near"
    )
    windows = (
        f"SELECT o_orderkey, sample, len(w)::INT AS n, array_to_string(w, '|') AS windows FROM (SELECT *, "
        "list_transform(list_filter(range(1, len(text) - 6), lambda i: substr(text, i, 2) = left(sample, 2) AND substr(text, i + 6, 2) = right(sample, 2)), lambda i: substr(text, i, 8)) AS w "
        f"FROM (SELECT o_orderkey, {_IBAN} || ' ' || cast(o_orderkey * 7919 as string) AS text, {_SAMPLE} AS sample FROM orders))"
    )
    emails = f"SELECT doc_id, start::INT AS start, (start + len(m))::INT AS \"end\", 'EMAIL' AS label FROM ({email_sql()})"
    sweep = (
        f"WITH RECURSIVE marked AS (SELECT {_MARKED} FROM lineitem), "
        'rows AS (SELECT k, start, "end", row_number() OVER (PARTITION BY k ORDER BY start, "end", l_orderkey, l_linenumber) AS rn FROM marked), '
        'swept AS (SELECT k, rn, start, "end", "end" AS last, true AS kept FROM rows WHERE rn = 1 UNION ALL '
        'SELECT r.k, r.rn, r.start, r."end", CASE WHEN r.start >= s.last THEN r."end" ELSE s.last END, r.start >= s.last FROM swept s JOIN rows r ON r.k = s.k AND r.rn = s.rn + 1) '
        'SELECT k, start, "end" FROM swept WHERE kept'
    )
    near = (
        f"WITH spans AS (SELECT l_returnflag, {_MARKED.replace('l_suppkey', 'l_suppkey % 10')} FROM lineitem), "
        f'labels AS (SELECT k, start, "end", min(p_brand) AS label FROM (SELECT p_brand, {_LABELS} FROM part) GROUP BY k, start, "end"), '
        'around AS (SELECT s.*, greatest(s.start - b."end", 0) AS gb, b.label AS lb, greatest(a.start - s."end", 0) AS ga, a.label AS la FROM spans s '
        "ASOF LEFT JOIN labels b ON s.k = b.k AND s.start >= b.start ASOF LEFT JOIN labels a ON s.k = a.k AND s.start < a.start), "
        "chosen AS (SELECT *, CASE WHEN lb IS NOT NULL AND (la IS NULL OR gb <= ga) THEN gb WHEN la IS NOT NULL THEN ga END AS gap, "
        "CASE WHEN lb IS NOT NULL AND (la IS NULL OR gb <= ga) THEN lb ELSE la END AS name FROM around), "
        "judged AS (SELECT *, CASE WHEN gap <= 120 THEN name END AS label, CASE WHEN gap <= 120 THEN gap END AS label_gap FROM chosen) "
    )
    examples = (
        "WITH d AS (SELECT DISTINCT p_brand, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') "
        "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:5], ',') AS examples FROM d GROUP BY p_brand"
    )
    documents = (
        "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '(empty)' ELSE text END || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '> read from an image' ELSE '' END "
        "|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || role AS document FROM conversations"
    )
    k = "o_orderkey"
    kinds = [
        ("heading", "1", f"{k} % 6 + 1", "0", f"len('Order ' || {k}::VARCHAR)"),
        ("bullet", f"{k} % 4", "0", "0", f"4 * ({k} % 4)"),
        ("number", f"{k} % 3", "0", "0", f"6 * ({k} % 3)"),
        ("paragraph", f"1 + ({k} + 1) % 2", "0", "0", f"24 + 3 * (({k} + 1) % 2)"),
        ("quote", "1", "1", "0", "4"),
        ("table", "1", "2", f"2 + 2 * ({k} % 5)", "0"),
        ("rule", "1", "0", "0", "0"),
        ("code", "1", "0", "0", f"22 + {k} % 2"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, sum({n})::BIGINT AS n, sum({level})::BIGINT AS levels, sum({cells})::BIGINT AS cells, sum({chars})::BIGINT AS chars FROM orders"
        for kind, n, level, cells, chars in kinds
    )
    return {
        "blocks_by_kind": parts,
        "first_examples": examples,
        "handed_out": documents,
        "fuzzy_outcomes": outcomes,
        "mask_matches": windows,
        "email_spans": emails,
        "recovered_spans": emails,
        "overlap_sweep": sweep,
        "nearest_labels": near + "SELECT l_orderkey, l_linenumber, start, label, label_gap FROM judged",
        "losses_by_label": near + "SELECT coalesce(label, 'none') AS label, count(*) AS spans, count(*) FILTER (l_returnflag = 'R') AS lost FROM judged GROUP BY 1",
    }
