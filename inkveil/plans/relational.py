"""Queries over annotations, evaluations and conversions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators as V
from ..operators import evaluate as E
from ..operators import lexicon
from ..operators.engine import annotations, flatten_numbers, mask, redact
from ..operators.options import only
from ..sources import sinks
from .checks import luhn_sql
from .recognisers import steps

_CARD_SQL = "regexp_replace(card, '[^0-9]', '', 'g')"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
#: Word boundaries stand for the recogniser's lookarounds, which DuckDB lacks: they keep two cards in a row apart and
#: leave the inside of longer numbers alone. Cards behind a digit and a dot or in braces, which they let pass, do not occur.
_CARD = r"\b[3-6]\d{3}(?:[ .-]?\d{2,6}){2,4}\b"
#: Annotations of the documents in SQL: e-mails, and cards that pass the Luhn check.
_ANNOTATIONS = f"""
  SELECT doc_id, 'emails' AS kind, lower(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) AS value_key
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents)
  UNION ALL
  SELECT doc_id, 'cards', {_CARD_SQL} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS card FROM documents)
  WHERE {luhn_sql(_CARD_SQL)} AND len({_CARD_SQL}) BETWEEN 13 AND 19"""


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _found(spark, sf_dir: str, *keep: str):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", *keep)
    return annotations(docs, "doc_id", options=only("emails", "fiscal"), steps=steps("email", "card"), keep=keep).filter("decision = 'replace'")


def report_counts(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value_key").alias("values"))


def report_pivot(spark, sf_dir):
    return _found(spark, sf_dir, "source").groupBy("source").pivot("kind", ["cards", "emails"]).agg(F.count(F.lit(1))).na.fill(0)


def report_cube(spark, sf_dir):
    return _found(spark, sf_dir, "lang").cube("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


def top_kinds(spark, sf_dir):
    found = _found(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))
    return found.withColumn("mean", F.col("n") / F.col("documents")).orderBy(F.desc("n"), "kind").limit(40)


def top_values(spark, sf_dir):
    ranked = _found(spark, sf_dir).groupBy("kind", "value_key").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value_key"))
    return ranked.withColumn("rank", rank).filter("rank <= 5")


def _mails(spark, sf_dir, numbered=True, **more):
    text = "'a c' || cast(o_orderkey % 5 as string) || '@x.com b c' || cast((o_orderkey * 3) % 5 as string) || '@x.com c C' || cast(o_orderkey % 5 as string) || '@X.COM d'"
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("text"))
    return redact(rows, "text", only("emails", numbered=numbered, **more), steps=steps("email"))


def number_by_appearance(spark, sf_dir):
    return _mails(spark, sf_dir).select("o_orderkey", "redacted")


def flatten(spark, sf_dir):
    return _mails(spark, sf_dir).select("o_orderkey", flatten_numbers(F.col("redacted")).alias("flat"))


def terms_always(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr("'project alpha ' || o_orderpriority || ' of Project  ALPHA'").alias("text"))
    found = redact(rows, "text", only(always=("Project Alpha",)))
    return found.select("o_orderkey", "redacted", F.element_at("report.counts", "terms").alias("terms"))


def terms_never(spark, sf_dir):
    return _mails(spark, sf_dir, never=("c1@x.com",)).select("o_orderkey", "redacted")


def segnala_detect_only(spark, sf_dir):
    found = _mails(spark, sf_dir, detect_only=("emails",))
    return found.select("o_orderkey", "redacted", F.col("report.total").alias("total"), F.col("report.detected_total").alias("detected"))


def suspects_iban(spark, sf_dir):
    text = "'to DEXX' || lpad(cast(o_orderkey as string), 15, '0') || ' end'"
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("text"))
    from ..operators.steps import SUSPECT_STEPS

    found = redact(rows, "text", only("fiscal"), steps=[s for s in SUSPECT_STEPS if s.name == "suspect_iban"])
    return found.select("o_orderkey", F.col("report.suspects_total").alias("suspects"), F.element_at("report.suspects", 1)["sample"].alias("sample"))


def mask_sample(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", mask(F.expr("substr(c_name, 1, cast(1 + c_custkey % 18 as int))")).alias("sample"))


def payload(spark, sf_dir):
    found = _mails(spark, sf_dir)
    return found.select("o_orderkey", sinks.payload(F.col("redacted"), F.col("report.total").alias("total")).alias("payload"))


def recall_by_category(spark, sf_dir):
    value = "cast(400000 + o_orderkey % 9 as string) || lpad(cast((o_orderkey * 7919 + 31) % 10000000000 as string), 10, '0')"
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(value).alias("value"), F.col("o_orderpriority").alias("category"))
    results = redact(rows.withColumn("text", F.concat(F.lit("card "), "value")), "text", only("fiscal"), steps=steps("card"))
    return E.recall(rows, results.select("doc_id", "redacted", "report"))


def recall_of_valid(spark, sf_dir):
    """As above, but values that fail their own check leave the measure."""
    value = "cast(400000 + o_orderkey % 9 as string) || lpad(cast((o_orderkey * 7919 + 31) % 10000000000 as string), 10, '0')"
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(value).alias("value"), F.col("o_orderpriority").alias("category"))
    rows = rows.filter(V.luhn_ok(F.col("value")))
    results = redact(rows.withColumn("text", F.concat(F.lit("card "), "value")), "text", only("fiscal"), steps=steps("card"))
    return E.recall(rows, results.select("doc_id", "redacted", "report"))


def ratchet_diff(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumn("grp", F.when(F.col("o_orderkey") % 2 == 0, "forms").otherwise("prose"))
    count = lambda df: df.groupBy("grp", F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return E.ratchet(count(rows.filter("o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT'")), count(rows.filter("o_orderkey % 5 = 0")))


def interval_overlap_recall(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    wide = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + 6).cast("long").alias("end"))
    gone = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 7).cast("long").alias("start"), (F.col("l_linenumber") * 7 + 2).cast("long").alias("end"))
    return E.overlaps(wide, gone)


def ab_delta(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders")
    return E.delta(rows.filter("o_orderkey % 3 = 0").select("o_orderkey"), rows.filter("o_orderkey % 2 = 0").select("o_orderkey"), ["o_orderkey"])


def hash_substitution(spark, sf_dir):
    pool = ["Ada", "Ben", "Cleo", "Dan", "Eve"]
    return _read(spark, sf_dir, "customer").select("c_custkey", E.substitute(F.col("c_name"), pool).alias("name"))


def corpus_fingerprint(spark, sf_dir):
    return E.fingerprint(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


def verify_residue(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer")
    before = rows.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.expr("'c' || cast(c_custkey as string)").alias("value"))
    after = rows.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'x c' || cast(c_custkey as string) || ' y' ELSE 'x c' || cast(c_custkey as string) || '0 y' END").alias("text"))
    return E.residue(before, after, ["doc_id", "page"]).select("doc_id", "page", "present")


def insert_fragment(spark, sf_dir):
    docs = _read(spark, sf_dir, "benchmark")
    return docs.select("item_id", E.insert_in_middle(F.col("text"), F.lit("FRAGMENT")).alias("text"))


def false_positive_census(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("text")
    found = redact(docs, "text", only("emails", "fiscal"), steps=steps("email", "card"))
    return found.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum("report.total").alias("replaced"),
        F.sum((F.col("report.total") == 0).cast("int")).alias("untouched"),
    )


def clean_paragraphs(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").filter(F.length("text").between(400, 1200)).select("doc_id", "text")
    found = redact(docs, "text", only("emails", "fiscal"), steps=steps("email", "card")).filter("report.total = 0")
    return found.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("o")).orderBy("o", "doc_id").limit(50)


def full_census(spark, sf_dir):
    """The census over the whole default program with its suspects."""
    found = redact(_read(spark, sf_dir, "documents").select("text"), "text")
    return found.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum("report.total").alias("replaced"),
        F.sum("report.suspects_total").alias("suspects"), F.sum((F.col("report.total") == 0).cast("int")).alias("untouched"),
    )


def full_report(spark, sf_dir):
    """What the whole default program decides, by source, kind and decision."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = annotations(docs, "doc_id", keep=("source",))
    return found.groupBy("source", "kind", "decision").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value_key").alias("values"))


def full_clean_paragraphs(spark, sf_dir):
    """Paragraph-sized documents in which the whole program finds nothing and suspects nothing."""
    docs = _read(spark, sf_dir, "documents").filter(F.length("text").between(400, 1200)).select("doc_id", "text")
    # the row number keeps the filter above the program's steps, through which the optimizer would copy it
    found = redact(docs, "text").withColumn("_row", F.monotonically_increasing_id())
    found = found.filter("report.total = 0 AND report.suspects_total = 0 AND report.detected_total = 0 AND _row >= 0")
    return found.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("o")).orderBy("o", "doc_id").limit(50)


def lexicon_members(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")).alias("token"))
    common = lexicon.table(spark).filter("class = 'common'").select("token")
    return words.join(common, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def lexicon_unknown(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")).alias("token")).filter("token <> ''").distinct()
    common = lexicon.table(spark).filter("class = 'common'").select("token")
    return words.join(common, "token", "left_anti").agg(F.count(F.lit(1)).alias("unknown"), F.min("token").alias("first"), F.max("token").alias("last"))


def iban_lengths(spark, sf_dir):
    codes = ["DE", "FR", "GB", "IT", "ES"]
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("code"))
    return rows.select("n_nationkey", "code", V.iban_length(F.col("code")).alias("chars"))


def html_to_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def noise_strip(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.length(T.strip_comments(F.col("html"))).alias("chars"))


def strip_quotes(spark, sf_dir):
    text = "'> ' || text || chr(10) || '  > again' || chr(10) || '  kept'"
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_quotes(F.expr(text)).alias("text"))


def thread_split(spark, sf_dir):
    text = "role || ' new' || chr(10) || 'On Monday, Ann wrote:' || chr(10) || '> old ' || cast(turn as string) || chr(10) || 'Il giorno 3, Bo ha scritto:' || chr(10) || '>> older'"
    found = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_thread(F.expr(text))).alias("depth", "message"))
    return found.select("conv_id", "turn", "depth", "message")


def merge_markdown(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").withColumn("md", F.concat(F.lit("---\nkey: 1\n---\n\nText of "), "n_name")).withColumn("err", F.when(F.col("n_nationkey") % 7 == 0, "unreadable"))
    return sinks.merge(rows, ["n_regionkey"], "n_nationkey", "n_name", "md", "err")


def compare_pairs(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumn("md", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
    return sinks.compare(rows, ["o_custkey"], "o_orderkey", "md")


def table_markdown(spark, sf_dir):
    cells = F.array(F.array(F.lit("name"), F.lit("key")), F.array(F.concat("n_name", F.lit("|x"))), F.array(F.lit("a\nb"), F.col("n_nationkey").cast("string")))
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.table_to_markdown(cells).alias("markdown"))


def frontmatter(spark, sf_dir):
    counts = F.create_map(F.lit("phones"), F.col("n_nationkey"), F.lit("emails"), F.col("n_regionkey"))
    return _read(spark, sf_dir, "nation").select(
        "n_nationkey", T.frontmatter(F.concat(F.lit('a "'), "n_name", F.lit('".txt')), F.lit("txt"), F.lit("text"), F.col("n_name"), counts).alias("block")
    )


def strip_frontmatter(spark, sf_dir):
    head = F.when(F.col("n_nationkey") % 2 == 0, "---\nkey: 1\n---\n\n").otherwise("---\nno key\n---\n\n")
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.strip_frontmatter(F.concat(head, "n_name")).alias("text"))


_EXT = "CASE n_nationkey % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'eml' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'exe' WHEN 4 THEN 'html' ELSE 'md' END"


def extension_dispatch(spark, sf_dir):
    path = F.expr(f"'/in/' || n_name || '.' || {_EXT}")
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.extension(path).alias("ext"), T.allowed(path).alias("allowed"))


def prose_form(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select("n_nationkey", T.prose(F.expr(f"n_name || '.' || {_EXT}")).alias("prose"))


def output_names(spark, sf_dir):
    path = F.expr("'/in/' || cast(n_regionkey as string) || '/file' || cast(n_nationkey % 4 as string) || CASE WHEN n_nationkey % 3 = 0 THEN '.txt' ELSE '.eml' END")
    return sinks.output_names(_read(spark, sf_dir, "nation").select(F.concat(path, F.lit("")).alias("path"), "n_nationkey")).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


def one_line_headers(spark, sf_dir):
    raw = F.concat(F.lit("  a\r\n\t"), "r_name", F.lit("\u0007  b "))
    return _read(spark, sf_dir, "region").select("r_regionkey", T.one_line(raw).alias("header"))


QUERIES = [
    report_counts, report_pivot, report_cube, top_kinds, top_values, number_by_appearance, terms_always, terms_never, segnala_detect_only, suspects_iban,
    mask_sample, payload, recall_by_category, recall_of_valid, ratchet_diff, interval_overlap_recall, ab_delta, hash_substitution, corpus_fingerprint,
    verify_residue, insert_fragment, false_positive_census, clean_paragraphs, full_census, full_report, full_clean_paragraphs, lexicon_members, lexicon_unknown, iban_lengths, html_to_text, noise_strip,
    strip_quotes, thread_split, merge_markdown, compare_pairs, table_markdown, frontmatter, strip_frontmatter, extension_dispatch, prose_form,
    output_names, one_line_headers,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES} | {"flatten_numbers": flatten}


_A, _B = "o_orderkey % 5", "(o_orderkey * 3) % 5"
_MAILS = f"'a c' || ({_A})::VARCHAR || '@x.com b c' || ({_B})::VARCHAR || '@x.com c C' || ({_A})::VARCHAR || '@X.COM d'"
_VALUE = "(400000 + o_orderkey % 9)::VARCHAR || lpad(((o_orderkey * 7919 + 31) % 10000000000)::VARCHAR, 10, '0')"
_WORDS = "SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS token FROM documents"
_COMMON = ", ".join(f"'{w}'" for w in sorted(lexicon.COMMON))
_NAME2 = "CASE WHEN {v} THEN 2 ELSE 1 END"
_POOL = "['Ada', 'Ben', 'Cleo', 'Dan', 'Eve']"


def _recall(where: str) -> str:
    ok = luhn_sql("value")
    return (
        f"SELECT category, count(*) FILTER ({ok}) AS redacted, count(*) FILTER (false) AS flagged, count(*) FILTER (NOT ({ok})) AS lost "
        f"FROM (SELECT {_VALUE} AS value, o_orderpriority AS category FROM orders) WHERE {where} GROUP BY category"
    )


def oracle_sql() -> dict:
    placeholder = lambda n: "'{{EMAIL_' || (" + n + ") || '}}'"
    second = f"CASE WHEN {_A} = {_B} THEN 1 ELSE 2 END"
    never = (
        f"CASE WHEN {_A} = 1 AND {_B} = 1 THEN {_MAILS} "
        f"WHEN {_A} = 1 THEN 'a c1@x.com b {{{{EMAIL_1}}}} c C1@X.COM d' "
        f"WHEN {_B} = 1 THEN 'a {{{{EMAIL_1}}}} b c1@x.com c {{{{EMAIL_1}}}} d' "
        f"ELSE 'a {{{{EMAIL_1}}}} b ' || {placeholder(second)} || ' c {{{{EMAIL_1}}}} d' END"
    )
    numbered = f"'a {{{{EMAIL_1}}}} b ' || {placeholder(second)} || ' c {{{{EMAIL_1}}}} d'"
    return {
        "report_counts": f"SELECT doc_id, kind, count(*) AS n, count(DISTINCT value_key) AS values FROM ({_ANNOTATIONS}) GROUP BY ALL",
        "report_pivot": f"SELECT source, count(*) FILTER (kind = 'cards') AS cards, count(*) FILTER (kind = 'emails') AS emails FROM ({_ANNOTATIONS}) JOIN documents USING (doc_id) GROUP BY source",
        "report_cube": f"SELECT lang, kind, count(*) AS n FROM ({_ANNOTATIONS}) JOIN documents USING (doc_id) GROUP BY CUBE (lang, kind)",
        "top_kinds": f"SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents, count(*)::DOUBLE / count(DISTINCT doc_id) AS mean FROM ({_ANNOTATIONS}) GROUP BY kind ORDER BY n DESC, kind LIMIT 40",
        "top_values": f"SELECT * FROM (SELECT kind, value_key, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value_key)::INT AS rank FROM (SELECT kind, value_key, count(*) AS n FROM ({_ANNOTATIONS}) GROUP BY ALL)) WHERE rank <= 5",
        "number_by_appearance": f"SELECT o_orderkey, {numbered} AS redacted FROM orders",
        "flatten_numbers": "SELECT o_orderkey, 'a {{EMAIL}} b {{EMAIL}} c {{EMAIL}} d' AS flat FROM orders",
        "terms_always": "SELECT o_orderkey, '{{TERM_1}} ' || o_orderpriority || ' of {{TERM_1}}' AS redacted, 2 AS terms FROM orders",
        "terms_never": f"SELECT o_orderkey, {never} AS redacted FROM orders",
        "segnala_detect_only": f"SELECT o_orderkey, {_MAILS} AS redacted, 0 AS total, 3 AS detected FROM orders",
        "suspects_iban": "SELECT o_orderkey, 0 AS suspects, NULL::VARCHAR AS sample FROM orders WHERE false UNION ALL SELECT o_orderkey, 1, 'DE' || repeat('•', 15) || right(lpad(o_orderkey::VARCHAR, 15, '0'), 2) FROM orders",
        "mask_sample": "SELECT c_custkey, CASE WHEN len(s) <= 4 THEN repeat('•', len(s)) ELSE left(s, 2) || repeat('•', len(s) - 4) || right(s, 2) END AS sample FROM (SELECT c_custkey, trim(substr(c_name, 1, (1 + c_custkey % 18)::INT)) AS s FROM customer)",
        "payload": f"SELECT o_orderkey, '{{\"redacted\":\"' || ({numbered}) || '\",\"total\":3}}' AS payload FROM orders",
        "recall_by_category": _recall("true"),
        "recall_of_valid": _recall(luhn_sql("value")),
        "ratchet_diff": """
            WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'forms' ELSE 'prose' END AS grp, o_orderpriority AS category FROM orders),
            a AS (SELECT grp, category, count(*) AS n FROM o WHERE o_orderkey % 3 = 0 AND category <> '1-URGENT' GROUP BY ALL),
            b AS (SELECT grp, category, count(*) AS n FROM o WHERE o_orderkey % 5 = 0 GROUP BY ALL)
            SELECT grp, category, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now,
                   (grp = 'forms' AND coalesce(b.n, 0) > coalesce(a.n, 0)) OR (grp = 'prose' AND coalesce(b.n, 0) < coalesce(a.n, 0)) AS broken
            FROM a FULL JOIN b USING (grp, category)""",
        "interval_overlap_recall": """
            WITH a AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10)::BIGINT AS s, (l_linenumber * 10 + 6)::BIGINT AS e FROM lineitem),
            r AS (SELECT l_orderkey AS doc_id, l_linenumber * 7 AS s, l_linenumber * 7 + 2 AS e FROM lineitem)
            SELECT DISTINCT doc_id, s AS start, e AS "end", EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND a.s < r.e AND r.s < a.e) AS caught FROM a""",
        "ab_delta": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'gone' END AS change FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0)",
        "hash_substitution": f"SELECT c_custkey, {_POOL}[(('0x' || left(sha256(c_name), 16))::UBIGINT % 5)::INT + 1] AS name FROM customer",
        "corpus_fingerprint": "SELECT left(sha256(string_agg(n_name, chr(10) ORDER BY n_name)), 16) AS fingerprint, count(*) AS names FROM nation",
        "verify_residue": "SELECT c_custkey AS doc_id, 1 AS page, c_custkey % 4 = 0 AND c_custkey >= 10 AS present FROM customer",
        "insert_fragment": "SELECT item_id, left(text, p) || 'FRAGMENT ' || substr(text, p + 1) AS text FROM (SELECT *, (h + instr(substr(text, h + 1), ' '))::INT AS p FROM (SELECT *, (len(text) // 2)::INT AS h FROM benchmark))",
        "false_positive_census": f"WITH a AS (SELECT doc_id, count(*) AS n FROM ({_ANNOTATIONS}) GROUP BY doc_id) SELECT count(*) AS documents, sum(len(text))::BIGINT AS chars, coalesce(sum(n), 0)::BIGINT AS replaced, count(*) FILTER (n IS NULL)::BIGINT AS untouched FROM documents LEFT JOIN a USING (doc_id)",
        "clean_paragraphs": f"SELECT doc_id, md5('7:' || doc_id::VARCHAR) AS o FROM documents WHERE len(text) BETWEEN 400 AND 1200 AND doc_id NOT IN (SELECT doc_id FROM ({_ANNOTATIONS})) ORDER BY o, doc_id LIMIT 50",
        "lexicon_members": f"SELECT token, count(*) AS n FROM ({_WORDS}) WHERE token IN ({_COMMON}) GROUP BY token",
        "lexicon_unknown": f"SELECT count(*) AS unknown, min(token) AS first, max(token) AS last FROM (SELECT DISTINCT token FROM ({_WORDS}) WHERE token <> '' AND token NOT IN ({_COMMON}))",
        "iban_lengths": "SELECT n_nationkey, ['DE', 'FR', 'GB', 'IT', 'ES'][n_nationkey % 5 + 1] AS code, [22, 27, 22, 27, 24][n_nationkey % 5 + 1] AS chars FROM nation",
        "html_to_text": r"""
            SELECT page_id, regexp_replace(trim(replace(replace(replace(replace(replace(replace(replace(replace(
              regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
              '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?i)<br\s*/?>|</p\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
              '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM pages""",
        "noise_strip": r"SELECT page_id, len(regexp_replace(html, '(?s)<!--.*?-->\n?', '', 'g'))::INT AS chars FROM pages",
        "strip_quotes": "SELECT conv_id, turn, regexp_replace('> ' || text || chr(10) || '  > again' || chr(10) || '  kept', '(?m)^[ \\t]*> ?', '', 'g') AS text FROM conversations",
        "thread_split": "SELECT conv_id, turn, unnest([0, 1, 2]) AS depth, unnest([role || ' new', 'old ' || turn::VARCHAR, '> older']) AS message FROM conversations",
        "merge_markdown": """
            SELECT n_regionkey, count(*) AS documents, string_agg('# ' || i || '. ' || n_name || chr(10) || chr(10) || b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_nationkey) AS merged
            FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, CASE WHEN n_nationkey % 7 = 0 THEN '> error: unreadable' ELSE 'Text of ' || n_name END AS b FROM nation) GROUP BY n_regionkey""",
        "compare_pairs": "SELECT o_custkey, '# A' || chr(10) || chr(10) || 'Order ' || min(o_orderkey) || chr(10) || chr(10) || '# B' || chr(10) || chr(10) || 'Order ' || max(o_orderkey) AS compared FROM orders GROUP BY o_custkey HAVING count(*) = 2",
        "table_markdown": r"SELECT n_nationkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || '\|x |  |' || chr(10) || '| a b | ' || n_nationkey || ' |' AS markdown FROM nation",
        "frontmatter": r"""
            SELECT n_nationkey, array_to_string(['---', 'generator: inkveil', 'source: "a \"' || n_name || '\".txt"', 'format: txt', 'engine: text', 'sha256: ' || left(sha256(n_name), 16),
              'redactions:', '  emails: ' || n_regionkey, '  phones: ' || n_nationkey, '---'], chr(10)) || chr(10) || chr(10) AS block FROM nation""",
        "strip_frontmatter": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '---' || chr(10) || 'no key' || chr(10) || '---' || chr(10) || chr(10) || n_name END AS text FROM nation",
        "extension_dispatch": f"SELECT n_nationkey, lower({_EXT}) AS ext, {_EXT} <> 'exe' AS allowed FROM nation",
        "prose_form": f"SELECT n_nationkey, CASE WHEN {_EXT} IN ('eml', 'md') THEN true WHEN {_EXT} = 'xlsx' THEN false END AS prose FROM nation",
        "output_names": """
            WITH f AS (SELECT 'file' || (n_nationkey % 4)::VARCHAR AS stem, CASE WHEN n_nationkey % 3 = 0 THEN 'txt' ELSE 'eml' END AS ext, '/in/' || n_regionkey || '/file' || (n_nationkey % 4)::VARCHAR || CASE WHEN n_nationkey % 3 = 0 THEN '.txt' ELSE '.eml' END AS path FROM nation),
            n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS n, row_number() OVER (PARTITION BY stem, ext ORDER BY path) AS s, first_value(ext) OVER (PARTITION BY stem ORDER BY path) AS fe FROM f)
            SELECT output, count(*) AS n FROM (SELECT CASE WHEN n = 1 THEN stem || '.md' WHEN s = 1 OR (s = 2 AND fe = ext) THEN stem || '-' || ext || '.md' ELSE stem || '-' || ext || '-' || s || '.md' END AS output FROM n) GROUP BY output""",
        "one_line_headers": "SELECT r_regionkey, 'a ' || r_name || ' b' AS header FROM region",
    }
