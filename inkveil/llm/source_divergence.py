"""Source divergence audit: how far the word use of the sources of a language lies apart, and on which terms.

Every language keeps the terms that occur in at least ``LEAST_DOCS`` of its documents. A source gives each kept
term a share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), and two sources differ by the sum of |p - q|.
Most counts are zero, so this is an inverted index with a baseline: with z the share of a count of zero in a
source, each pair of sources starts at V * |z - z'|, and only postings (source, term, count above zero) correct it.
As a share is never below its own z, the corrections split up exactly:

* a term that one source of the pair has, whatever the other: |p - z'| - |z - z'|. It depends on the term by p alone, so
  postings are first counted by (source, p), and one sorted pass over a source's values and the z' of the others, with
  running sums, gives all its pairs;
* a term that both have: less twice the overlap of [z, p] and [z', p']. Posting lists are read term by term and pairs
  summed up inside the tasks; overlaps of zero are left out.

Terms are counted inside the tasks by (language, source, term) before any shuffle, so a hot source or word is a row
for each task. Terms of a source are ranked by a window whose limit Spark applies before the shuffle. The pairs of
sources of a language are the result itself, so they grow with the square of its sources, as a result must that holds them.
Shares are computed by long division with remainders, exact up to 9 * 10**15 words.

Defined cases: null text, language and source count as ''. A text without terms still makes its group occur. A language
without kept terms has value 0 for all pairs. Texts of any length are read whole, in slices. Repeated rows count each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
#: Characters of a text that are cut into terms at once; entries a task counts before it hands them on; pairs likewise.
SLICE = 1 << 20
MOST_ENTRIES = 600_000
MOST_PAIRS = 1 << 20
#: Pairs of postings that are compared at once.
BLOCK = 1 << 16

#: ASCII letters in lower case, every other ASCII character a blank, all bytes above unchanged.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _pieces(data: bytes):
    """Lists of the terms of a normalised text, a slice at a time; a term is never cut."""
    at = 0
    while at < len(data):
        end = len(data) if at + SLICE >= len(data) else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches):
    """Per task: (lang, source, term, n, docs); the empty term stands for the group itself."""
    counts: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    held = 0

    def handed():
        for (lang, source), (n, docs) in counts.items():
            columns = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            columns += [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            held -= len(n)
            own: set[bytes] = set()
            for terms in _pieces(text.translate(_TABLE)):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n)
            if held >= MOST_ENTRIES:
                yield from handed()
                held = 0
    yield from handed()


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (n + 5 * v)), three digits at a time."""
    whole = n + SMOOTH * v
    top = count + SMOOTH
    quotient, rest = _div(top, whole), top % whole
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + _div(rest, whole), rest % whole
    return quotient + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs that are not negative."""
    return F.call_function("div", a, b)


def _overlaps(batches):
    """Per task: (a, b, overlap) with a < b, summed over the posting lists ``g``, ``p``, ``z`` of its terms."""
    keys, values, held = [], [], 0

    def reduced():
        k, v = np.concatenate(keys), np.concatenate(values)
        unique, place = np.unique(k, axis=0, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, place.ravel(), v)
        return unique, total

    def handed(unique, total):
        return pa.RecordBatch.from_arrays([pa.array(unique[:, 0]), pa.array(unique[:, 1]), pa.array(total)], names=["a", "b", "overlap"])

    for batch in batches:
        postings = batch.column("postings")
        fields = postings.flatten()
        g, p, z = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        lengths = np.diff(postings.offsets.to_numpy())
        # every posting meets the next one of its term, then the one after that, and so on
        end = np.repeat(np.cumsum(lengths), lengths)
        at, apart = np.arange(len(g)), 0
        while len(at):
            apart += 1
            at = at[at + apart < end[at]]
            for i in range(0, len(at), BLOCK):
                x = at[i : i + BLOCK]
                y = x + apart
                over = np.minimum(p[x], p[y]) - np.maximum(z[x], z[y])
                some = np.flatnonzero(over > 0)
                first, second = g[x[some]], g[y[some]]
                keys.append(np.stack([np.minimum(first, second), np.maximum(first, second)], axis=1))
                values.append(over[some])
                held += len(some)
                if held >= MOST_PAIRS:
                    unique, total = reduced()
                    if len(unique) > MOST_PAIRS // 2:
                        yield handed(unique, total)
                        keys, values, held = [], [], 0
                    else:
                        keys, values, held = [unique], [total], len(unique)
    if held:
        yield handed(*reduced())


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), the empty term for the group itself; a written table."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counted = filled.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, part ``term`` the ``top`` terms that the source overuses."""
    counts = term_counts(docs, text, lang, source)
    kept = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialise(kept.drop("docs"), "kept-terms")
    found = materialise(counts.filter("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    zero = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(0))
    # one row a source; in the written table g names it, among all languages
    groups = materialise(groups.withColumn("z", zero.cast("long")).withColumn("g", F.monotonically_increasing_id()), "groups")
    share, lang_share = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    named = found.join(groups, ["lang", "source"]).select("lang", "source", "g", "z", "term", share.alias("p"), lang_share.alias("q"))
    shares = materialise(named, "shares")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return _pairs(groups, shares).select(columns).unionByName(_terms(shares, top).select(columns))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _away(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b, away, own): over a's postings, the sum of |p - z of b|, and their number.

    Shares and the z of the other sources are put in one order; running sums answer for each z.
    """
    asked = pairs.select("a", "b", F.col("zb").alias("at"), F.lit(0).cast("long").alias("n"))
    levels = shares.groupBy(F.col("g").alias("a"), F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.lit(None).cast("long"))
    below = Window.partitionBy("a").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("a")
    weight = F.col("n") * F.col("at")
    sums = [F.sum("n").over(below).alias("n0"), F.sum(weight).over(below).alias("s0"), F.sum("n").over(whole).alias("n1"), F.sum(weight).over(whole).alias("s1")]
    summed = asked.unionByName(levels).select("a", "b", "at", *sums).filter(F.col("b").isNotNull())
    away = F.col("s1") - 2 * F.col("s0") - F.col("at") * (F.col("n1") - 2 * F.col("n0"))
    return summed.select("a", "b", away.alias("away"), F.col("n1").alias("own"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    one = groups.select("lang", "source", F.col("g").alias("a"), F.col("z").alias("za"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("z").alias("zb"))
    pairs = materialise(one.join(other, "lang").filter("a != b"), "pairs")
    single = materialise(_away(pairs, shares), "single")
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "z")).alias("postings")).filter(F.size("postings") > 1)
    met = lists.select("postings").mapInArrow(_overlaps, "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    met = materialise(met, "overlaps")
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in df.columns if c not in "ab"])
    back = turned(single).withColumnsRenamed({"away": "away_back", "own": "own_back"})
    joined = pairs.join(single, ["a", "b"]).join(back, ["a", "b"]).join(met.unionByName(turned(met)), ["a", "b"], "left")
    neither = (F.col("v") - F.col("own") - F.col("own_back")) * F.abs(F.col("za") - F.col("zb"))
    value = neither + F.col("away") + F.col("away_back") - 2 * F.coalesce("overlap", F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS terms FROM documents),
hits AS (SELECT lang, source, k, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS d FROM hits GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term HAVING sum(d) >= LEAST),
sizes AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, s.v, k.n AS lang_n, s.total AS lang_total,
    (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS total
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS p,
    (1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v))::BIGINT AS q FROM dense),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source != a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source != a.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= TOP
""".replace("LEAST", str(LEAST_DOCS)).replace("TOP", str(TOP))
