"""Queries of the name rules: runs of capitalised words met with the lexicon as a table, and the automaton over written shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, lexicon, names
from ..operators.engine import redact
from ..operators.options import only

_GIVEN = "Marco Anna Luca Giulia Pietro Chiara Paolo Emma Walter Lucia"
_SURNAME = "Rossi Bianchi Ferrari Greco Taylor Colombo Esposito Smith Sbragia Marino"


def _pick(words: str, key: str, times: int = 1) -> str:
    """A word by key, the same on both sides."""
    return f"split_part('{words}', ' ', cast(({key} * {times}) % {len(words.split())} + 1 as int))"


def _name(key: str) -> str:
    return f"{_pick(_GIVEN, key)} || ' ' || {_pick(_SURNAME, key, 3)}"


#: Before a document's own text: sentences with a name, a place, an institution, a listed word alone or none.
_SENTENCE = (
    f"CASE doc_id % 6 WHEN 0 THEN 'Oggi ' || {_name('doc_id')} || ' firma. ' WHEN 1 THEN 'Ospedale ' || {_name('doc_id')} || ' chiude. ' "
    f"WHEN 2 THEN 'Scrive ' || {_pick(_GIVEN, 'doc_id')} || ' Qzwx. ' WHEN 3 THEN 'Conti Correnti Aperti. ' "
    f"WHEN 4 THEN {_name('doc_id')} || ' ' || {_pick(_GIVEN, 'doc_id', 7)} || '. ' ELSE '' END"
)
_PATTERN = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[ \t][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)+"
_COUNTED = ("given", "surname", "common", "entity")


def run_evidence(docs: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """One row for each run of two or more capitalised words: key, place, run, words, and how many of them have each class.

    The words meet the lexicon as a table: distinct words are joined with its entries, and only the entries found meet the runs. A
    document's runs stay in its rows, so no word, however frequent, brings rows together.
    """
    runs = docs.select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))).alias("place", "run"))
    words = F.transform(F.split("run", "[ \t]"), F.lower)
    met = lexicon.with_classes(runs.withColumn("id", F.concat_ws(":", "k", "place")), "id", "run", entries)
    has = lambda kind: F.size(F.filter(words, lambda w: F.coalesce(F.element_at("lexicon", w), F.lit(0)).bitwiseAND(lexicon.BIT[kind]) != 0))
    return met.select(F.col("k").alias(key), "place", "run", F.size(words).alias("words"), *[has(kind).alias(kind) for kind in _COUNTED])


def name_evidence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(f"{_SENTENCE} || text").alias("text"))
    found = run_evidence(docs, "doc_id", "text", lexicon.table(spark))
    hits = F.col("given") + F.col("surname")
    verdict = F.when(F.col("entity") > 0, "entity").when(hits >= 2, "name").when(hits == 1, "suspect").otherwise("none")
    return found.withColumn("verdict", verdict)


#: Shape and what is left of it, as SQL of both sides; N is the name of the row.
_SHAPES = [
    ("'Oggi ' || N || ' ha firmato.'", "'Oggi {{NAME}} ha firmato.'"),
    ("'Ospedale ' || N || ' chiude.'", None),
    ("'lo stadio ' || N || ' apre'", None),
    ("'consegnato a ' || N || ' ieri'", "'consegnato a {{NAME}} ieri'"),
    ("'IC ' || N || ', terza'", None),
    ("'Fascicolo Di Salvo Walter, ' || cast(o_orderkey as string)", "'Fascicolo {{NAME}}, ' || cast(o_orderkey as string)"),
    ("'Rocca Di Papa ' || cast(o_orderkey as string)", None),
    ("'Friuli Venezia Giulia ' || cast(o_orderkey as string)", None),
    ("'parla Tommaso Gentile, ' || cast(o_orderkey as string)", "'parla {{NAME}}, ' || cast(o_orderkey as string)"),
    ("'Gentile Cliente ' || cast(o_orderkey as string)", None),
    ("'firma Lucia D' || chr(39) || 'Amico, ' || N", "'firma {{NAME}}, {{NAME}}'"),
    ("'zona: ' || N || ' risponde'", "'zona: {{NAME}} risponde'"),
]
_LISTED = "Rossi Bianchi Ferrari Greco Taylor Colombo Esposito Smith Marino"
_N = f"({_pick(_GIVEN, 'o_orderkey')} || ' ' || {_pick(_LISTED, 'o_orderkey', 5)})"


def _case(side: int) -> str:
    shapes = [(a, b or a)[side].replace("N ||", f"{_N} ||").replace("|| N", f"|| {_N}") for a, b in _SHAPES]
    return f"CASE o_orderkey % {len(shapes)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END"


def name_shapes(spark, sf_dir: str) -> DataFrame:
    """The automaton with a lexicon that stays a table."""
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_case(0)).alias("text"))
    met = names.with_lexicon(texts, "o_orderkey", "text", lexicon.table(spark))
    steps = [s for s in names.name_steps("lexicon") if s.name == "name_runs"]
    return redact(met, "text", only("names", numbered=False), steps=steps).select("o_orderkey", "text", "redacted", F.col("report.total").alias("total"))


def unknown_pool(spark, sf_dir: str) -> DataFrame:
    """Capitalised runs of two or three words none of which is a listed name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(f"{_SENTENCE} || text").alias("text"))
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0))).alias("value"))
    known = lexicon.table(spark).filter("class IN ('given', 'surname')").withColumnRenamed("token", "entry")
    return evaluate.unknown_names(runs, known)


def queries() -> dict:
    return {"name_evidence": name_evidence, "name_shapes": name_shapes, "unknown_pool": unknown_pool}


def oracle_sql() -> dict:
    entries = ", ".join(f"('{t}', '{kind}')" for kind, words in zip(_COUNTED, (lexicon.GIVEN, lexicon.SURNAMES, lexicon.COMMON, lexicon.ENTITY), strict=True) for t in sorted(words))
    counts = ", ".join(f"count(DISTINCT CASE WHEN l.kind = '{kind}' THEN t.i END)::INT AS {kind}" for kind in _COUNTED)
    evidence = (
        f"WITH runs AS (SELECT doc_id, unnest(r) AS run, unnest(range(len(r)))::INT AS place FROM (SELECT doc_id, regexp_extract_all({_SENTENCE} || text, '{_PATTERN}') AS r FROM documents)), "
        "tokens AS (SELECT doc_id, place, run, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT *, string_split_regex(lower(run), '[ \t]') AS w FROM runs)), "
        f"lexicon(w, kind) AS (VALUES {entries}), "
        f"counted AS (SELECT t.doc_id, t.place, any_value(t.run) AS run, count(DISTINCT t.i)::INT AS words, {counts} FROM tokens t LEFT JOIN lexicon l ON l.w = t.w GROUP BY t.doc_id, t.place) "
        "SELECT *, CASE WHEN entity > 0 THEN 'entity' WHEN given + surname >= 2 THEN 'name' WHEN given + surname = 1 THEN 'suspect' ELSE 'none' END AS verdict FROM counted"
    )
    redacted = _case(1)
    shapes = f"SELECT o_orderkey, {_case(0)} AS text, {_case(1)} AS redacted, (len({redacted}) - len(replace({redacted}, '{{{{NAME}}}}', '')))::INT // 8 AS total FROM orders"
    listed = ", ".join(f"'{t}'" for t in sorted(lexicon.GIVEN | lexicon.SURNAMES | lexicon.COMPOUNDS))
    pool = (
        f"WITH runs AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all({_SENTENCE} || text, '{_PATTERN}')), '[ 	]+', ' ', 'g') AS value FROM documents) "
        f"SELECT value FROM runs WHERE len(string_split(value, ' ')) BETWEEN 2 AND 3 AND len(list_filter(string_split(lower(value), ' '), lambda w: len(w) > 2 AND w IN ({listed}))) = 0"
    )
    return {"name_evidence": evidence, "name_shapes": shapes, "unknown_pool": pool}
