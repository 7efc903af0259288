"""The training-data operators against brute force, on small tables with odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkveil.llm import components, decontamination, html_extraction, line_dedup, lm_scoring, mixing, quality_rules, simhash, suffix_dedup, token_store, toxicity
from inkveil.llm.token_encoder import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(200)]
    paragraphs = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 70))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(paragraphs) if r.random() < 0.5 else " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))
            if r.random() < 0.3 and p:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            parts.append(p)
        out.append((i * 3, r.choice([" ", "\n"]).join(parts), "en", r.choice(["s1", "s2", "s2", "s2", None]), 0))
    long_text = " ".join(r.choice(vocabulary) for _ in range(20000))
    return out + [(1001, None, None, "s1", None), (1002, "", "en", "s3", 0), (1003, " \n\t ", "en", None, 3), (1004, long_text, "en", "s2", 0), (1005, out[5][1], "en", "s1", 0), (1006, "ab" * 300, "en", "s1", 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing names of extra columns do no harm
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"fp": F.lit("x"), "n_words": F.lit(1), "doc": F.lit(2), "line": F.lit(3), "size": F.lit("y")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    odd = ["it's <|endoftext|> 日本 x", "a  b\n\nc", " x\x01", "×÷ ²", "tab\tx \n", "'", "é" * 50, " lead"]
    texts = [r[1] for r in rows] + odd
    plain = Tokenizer.from_file(PATH)
    got = []
    for _, ids, n in Encoder(PATH).encode(texts):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_store(spark, docs, nothing, rows, tmp_path):
    from tokenizers import Tokenizer

    plain, at, expected, all_ids = Tokenizer.from_file(PATH), 0, {}, {}
    for r in sorted(rows):
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected[r[0]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        all_ids[r[0]] = ids
        at += len(ids)
    path = token_store.write_store(docs, f"file://{tmp_path}/s", PATH, width=2)
    token_store.verify_manifest(spark, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path).collect()}
    assert got == expected
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()} == all_ids
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert token_store.store_digests(nothing, PATH, 2).count() == 0


def test_store_notices_damage(spark, docs, tmp_path):
    path = token_store.write_store(docs, f"file://{tmp_path}/s", PATH, width=2)
    chunks = spark.read.parquet(f"{path}/chunks")
    broken = chunks.withColumn("ids", F.concat(F.substring("ids", 3, 100000), F.substring("ids", 1, 2)))
    with pytest.raises(Exception, match="does not match its hash"):
        token_store.checked_chunks(broken).collect()


def test_crc_shift():
    a, b = b"some bytes", b"and many more" * 9
    whole = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
    assert whole == zlib.crc32(a + b)


def test_lm_scoring(docs, nothing, rows):
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, F.col("source") == "s1")).collect()}
    data = [(r[0], (r[1] or "").lower().encode().split(), r[3] == "s1") for r in rows]
    count = [Counter(), Counter()]
    for _, w, t in data:
        count[not t].update(w)
    total = [sum(c.values()) for c in count]
    vocabulary = sorted(w for w in set(count[0]) | set(count[1]) if count[0][w] + count[1][w] >= 2)
    ids = {w: i + 1 for i, w in enumerate(vocabulary)}
    known = [[total[k] - sum(count[k][w] for w in vocabulary)] + [count[k][w] for w in vocabulary] for k in (0, 1)]
    pairs = [Counter(), Counter()]
    coded = [(i, [ids.get(x, 0) for x in w], t) for i, w, t in data]
    for _, w, t in coded:
        pairs[not t].update(zip(w, w[1:], strict=False))
    kept = {p for p in set(pairs[0]) | set(pairs[1]) if pairs[0][p] + pairs[1][p] >= 2}
    mass = [Counter(), Counter()]
    for k in (0, 1):
        for v, w in kept:
            mass[k][v] += pairs[k][v, w] / max(known[k][v], 1)
    for i, w, _ in coded:
        loss = [0.0, 0.0]
        for k in (0, 1):
            for j, x in enumerate(w):
                p = (known[k][x] + 1) / (total[k] + len(vocabulary) + 1)
                if j:
                    p *= max(1 - 0.7 * mass[k][w[j - 1]], 1e-6)
                    p += 0.7 * pairs[k][w[j - 1], x] / max(known[k][w[j - 1]], 1) if (w[j - 1], x) in kept else 0
                loss[k] -= math.log(p)
            loss[k] /= max(len(w), 1)
        assert got[i].n_tokens == len(w) and got[i].score == pytest.approx(loss[0] - loss[1], abs=1e-5)
    assert lm_scoring.score(nothing, lm_scoring.fit(nothing, F.col("source") == "s1")).count() == 0


def test_lm_scoring_keeps_rare_words_at_every_size(spark):
    # two rare words, beside so much other text that one in a million tokens is more than twice
    few = [(1, "rare pairing", "s1"), (2, "rare pairing", "s1")]
    many = spark.range(10, 2410).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 1000).alias("text"), F.lit("s2").alias("source"))
    docs = spark.createDataFrame(few, "doc_id long, text string, source string").unionByName(many)
    got = lm_scoring.score(docs, lm_scoring.fit(docs, F.col("source") == "s1")).filter("doc_id = 1").first()
    # four tokens of the target and five words with the unknown one; the pair is all that follows its first word
    assert got.target_loss == pytest.approx(-(math.log(3 / 9) + math.log(0.3 * 3 / 9 + 0.7)) / 2)


def test_lm_scoring_is_the_same_without_broadcast_terms(docs):
    whole, few = (sorted(lm_scoring.score(docs, lm_scoring.fit(docs, F.col("source") == "s1", head=most)).collect()) for most in (lm_scoring.HEAD, 8))
    assert [r[:2] for r in whole] == [r[:2] for r in few] and any(r.n_tokens > 1000 for r in few)
    assert [x for r in few for x in r[2:]] == pytest.approx([x for r in whole for x in r[2:]], abs=1e-9)
    other = docs.filter("doc_id % 2 = 1")
    alone = lm_scoring.score(other, lm_scoring.fit(docs, F.col("source") == "s1", head=8)).collect()
    assert [x for r in sorted(alone) for x in r[2:]] == pytest.approx([x for r in whole if r.doc_id % 2 for x in r[2:]], abs=1e-9)


def test_html_extraction(spark):
    pages = [
        (1, "u", "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy now for less and more and more.</div>"
         "<article><h1>Head</h1><p>One &amp; two<br>three.</p><p>Go.</p><div id='comments'><p>First!</p></div></article><footer>&copy; all</footer>"),
        (2, "u", None), (3, "u", ""), (4, "u", "<p>1 < 2"), (5, "u", "<article><p>a</p><p>b <!-- never ends"), (1, "u", "<article>x</article>"),
    ]
    got = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("blocks", F.lit(1)))
    texts = sorted((r.page_id, r.text) for r in got.collect())
    assert texts[:2] == [(1, "Head\n\nOne & two three.\n\nGo."), (1, "x")]
    assert dict(texts[2:]) == {2: "", 3: "", 4: "", 5: "a\n\nb"}
    labelled = html_extraction.labelled_blocks()
    assert len(labelled) > 50 and 0.2 < np.mean([r[-1] for r in labelled]) < 0.8


def test_html_attributes_of_any_length():
    for quote in "\"'":
        page = f"<article><div data-x={quote}{'x' * 5000}<b>SECRET</b> rest{quote}><p>Shown.</p></div></article>"
        assert [b[0] for b in html_extraction.blocks(page)] == ["Shown."]
        # without a closing quote the tag ends where it seems to
        assert [b[0] for b in html_extraction.blocks(f"<p title={quote}{'x' * 5000}>Shown.</p>")] == ["Shown."]


def test_html_reader_is_linear():
    import time

    for page in ("<a b " * 40000, "<div>" * 20000 + "</span>" * 20000 + "x", "<!--" * 50000, "<p>a</p>" * 25000):
        start = time.perf_counter()
        html_extraction.blocks(page)
        assert time.perf_counter() - start < 2


def fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_classes(docs, nothing, rows):
    ordered = sorted((r[0], fingerprint(r[1])) for r in rows)
    links = [(i, j) for i in range(len(ordered)) for j in range(i) if (ordered[i][1] ^ ordered[j][1]).bit_count() <= 3]
    root = roots(len(ordered), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {d: (f"{f:016x}", ordered[root[k]][0]) for k, (d, f) in enumerate(ordered)}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({ordered[k][0] for k in root})
    assert simhash.classes(nothing).count() == 0


def test_trie_join_with_small_parts(spark):
    rng = np.random.default_rng(1)
    points = []
    for x in rng.integers(0, 2**63, 20, dtype=np.uint64).tolist():
        for _ in range(25):
            x ^= 1 << int(rng.integers(64))
            points.append(x)
            x ^= (1 << int(rng.integers(64))) * int(rng.integers(2))
    points = np.array(sorted(set(points)), dtype=np.uint64)
    links = [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 3)]
    signed, classes = points.view(np.int64).tolist(), {}
    for i, r in enumerate(roots(len(points), links)):
        classes.setdefault(r, []).append(signed[i])
    expected = {m: min(c) for c in classes.values() for m in c if len(c) > 1}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(df, 3, max_leaves=8)).collect()}
    assert got == expected


def test_quality_rules(spark, docs, nothing, rows):
    good = " ".join(f"word{i} of the" for i in range(40))
    more = spark.createDataFrame([(1, good), (2, "Er " * 80), (3, good.upper() + "!!" * 200), (4, None), (5, "x*** y### " * 60)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(more).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert got[2].base_failed and got[2].n_repeat_words == 80 and not got[1].base_failed
    measured = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for d, t, *_ in rows:
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + i for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for i in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        m = measured[d]
        assert (m.n_words, m.word_chars, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
    assert [r.doc_id for r in quality_rules.filter_documents(more).collect()] == [1]
    assert quality_rules.filter_documents(docs).columns == docs.columns
    assert quality_rules.filter_documents(nothing).columns == nothing.columns and quality_rules.judge(nothing).count() == 0


def similar(a, b):
    size = line_dedup.SHORT_SHINGLE if max(len(a), len(b)) < line_dedup.SHORT else line_dedup.SHINGLE
    return line_dedup.jaccard(line_dedup.shingles(a, size), line_dedup.shingles(b, size)) >= 0.8


def line_verdicts(rows):
    """Rows (id, text) in order: lines that are not blank, and numbers of those that are removed, of each row."""
    lines, places = {}, []
    for k, (_, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            line = line_dedup.normal(line)
            if line:
                places.append((k, n, lines.setdefault(line, len(lines))))
    every = list(lines)
    root = roots(len(every), [(i, j) for i in range(len(every)) for j in range(i) if similar(every[i], every[j])])
    kept, out = set(), [[0, []] for _ in rows]
    for k, n, line in places:
        out[k][0] += 1
        if root[line] in kept:
            out[k][1].append(n)
        kept.add(root[line])
    return out


def test_line_dedup(docs, nothing, rows):
    ordered = sorted((r[0], r[1]) for r in rows)
    expected = dict(zip((r[0] for r in ordered), line_verdicts(ordered), strict=True))
    got = {r.doc_id: [r.n_lines, r.removed_lines] for r in line_dedup.line_report(docs).collect()}
    assert got == expected and any(v[1] for v in expected.values())
    cut = line_dedup.remove(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    for d, t in ordered:
        assert texts[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected[d][1]))
    assert line_dedup.line_report(nothing).count() == 0 and line_dedup.remove(nothing).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    first, second = "first line of A is in here twice\nonly in A second line there is this", "first line of B differs from all\nfirst line of A is in here twice"
    rows = [(1, first), (1, second), (None, None), (None, "first line of B differs from all"), (2, first), (2, first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [line for r in line_dedup.remove(df).collect() for line in (r.text or "").split("\n") if line]
    assert sorted(left) == ["first line of A is in here twice", "first line of B differs from all", "only in A second line there is this"]
    report = line_dedup.line_report(df).collect()
    assert len(report) == len(rows) and sum(r.n_removed for r in report) == 6 and sum(r.n_lines for r in report) == 9
    named = df.select(F.concat(F.lit("id-"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in line_dedup.line_report(named).collect()} == {"id-1", "id-2", None}


def test_lines_with_one_edit_are_duplicates(spark):
    r = random.Random(8)
    pairs = []
    for length in range(30, 81):
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(length - 12)).strip().ljust(length - 12, "q")
        line = line[: len(line) // 2] + " in year 3 z" + line[len(line) // 2 :]
        at = line.index(" 3 ") + 1
        other = line[:at] + "8" + line[at + 1 :] if length % 2 else line[:5] + "#" + line[6:]
        pairs.append((line, other))
    df = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.line_report(df).filter("n_removed > 0").collect()}
    assert gone == {2 * i + 1 for i in range(len(pairs))}


def test_large_buckets_are_cut(spark, monkeypatch):
    # lines that all share a key, of which some are alike only by way of others
    start = "this is one long line of some shared text with its number "
    lines = [start + f"{i:03d}" + " in it and a long end" for i in range(30)] + [start + "x" * k + " in it and a long end" for k in range(3, 90, 3)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    whole = {r.doc_id: r.n_removed for r in line_dedup.line_report(df).collect()}
    split = line_dedup.split_lines(df, "doc_id", "text")
    large = split.select(F.lit(7).cast("long").alias("key"), F.element_at("names", 1).alias("name"), F.element_at("own", 1).alias("own"))
    for most in (4, 1000):
        found = components.connected_components(line_dedup._large_links(large, most))
        expected = roots(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if similar(lines[i], lines[j])])
        sizes = sorted(n for n in Counter(expected).values() if n > 1)
        assert sorted(r["count"] for r in found.groupBy("root").count().collect()) == sizes
    assert sum(whole.values()) == len(lines) - len(set(expected))
    monkeypatch.setattr(line_dedup, "_CELL_ROWS", 10)
    assert {r.doc_id: r.n_removed for r in line_dedup.line_report(df, max_part=4).collect()} == whole


def test_decontamination(spark, docs, nothing, rows):
    benchmark = [(1, " ".join(words(rows[7][1])[3:16])), (2, "not there at all in any of these documents here now"), (3, "AB!"), (4, None), (5, "..."), (1, "dup")]
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    expected = {}
    for d, t, *_ in rows:
        w, hit, found = norm(t), set(), set()
        for item, text in benchmark:
            x = norm(text)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if x else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[d] = (len(w), len(hit), len(found), digest, bool(hit))
    for most in (decontamination.MAX_BROADCAST_BYTES, 60):  # one slice, and several
        found = decontamination.report(decontamination.scan(docs, items, max_broadcast_bytes=most))
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
        assert got == expected
    assert any(v[4] for v in expected.values())
    clean = decontamination.remove(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, v in expected.items() if not v[4]}
    cut = decontamination.remove(docs, items, how="spans")
    assert not decontamination.report(decontamination.scan(cut, items.filter("item_id = 1"))).filter("n_hit >= 10").count()
    assert decontamination.scan(nothing, items).count() == 0 and decontamination.scan(docs, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("how", ["spans", "documents"])
def test_decontamination_removes_the_same_in_any_number_of_slices(spark, how):
    words = "p q a b c d e f g h i j k l r s".split()
    rows = [(1, " ".join(words), "x"), (1, " ".join(words), "x"), (None, None, None), (2, "", "y"), (3, "A, b. C d e f g h i j!", None), (4, "clean words only", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("spans", F.lit("kept"))
    # windows of both items overlap in the text; the second is above the bound alone
    items = [("1", "a b c d e f g h i j"), ("2", "c d e f g h i j k l"), ("3", "zz " * 300)] + [(f"n{i}", f"none{i} x{i}") for i in range(50)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = {
        "spans": [(1, "p q  r s"), (1, "p q  r s"), (2, ""), (3, "!"), (4, "clean words only"), (None, None)],
        "documents": [(2, ""), (4, "clean words only"), (None, None)],
    }[how]
    for most in (decontamination.MAX_BROADCAST_BYTES, 600, 30):
        got = decontamination.remove(docs, bench, how=how, max_broadcast_bytes=most)
        assert got.columns == docs.columns and {r.spans for r in got.collect()} == {"kept"}
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == expected


def test_decontamination_keeps_rows_apart_in_slices(spark):
    leak, clean = "one two three four five six seven eight nine ten", "nothing of that kind is in here at all"
    big = (1 << 60) + 1
    rows = [(7, leak), (7, clean), (None, clean), (None, leak + " and more"), (7, leak), (big, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, leak if i == 3 else f"item {i} has words of its own and is long enough to be cut") for i in range(9)], "item_id long, text string")
    whole, cut = (sorted(decontamination.scan(docs, items, max_broadcast_bytes=m).collect(), key=str) for m in (decontamination.MAX_BROADCAST_BYTES, 60))
    expected = [(d, len(t.split()), [0, 10] if t.startswith(leak) else [], ["3"] if t.startswith(leak) else []) for d, t in rows]
    assert [tuple(r) for r in cut] == [tuple(r) for r in whole]
    assert sorted(map(str, (tuple(r) for r in cut))) == sorted(map(str, expected))


def test_mixing(docs, nothing, rows):
    got = mixing.plan(docs).collect()
    assert sorted(got) == sorted(mixing.plan(docs).collect())
    sizes, source = {r[0]: len(words(r[1])) for r in rows}, {r[0]: r[3] for r in rows}
    per = Counter()
    for d, s in source.items():
        per[s] += sizes[d]
    names = sorted(per, key=lambda x: (x is None, x or ""))
    weight, full, budget = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(), 1.5 * sum(per.values())
    while True:
        left = [s for s in names if s not in full]
        level = (budget - sum(2 * per[s] for s in full)) / sum(weight[s] for s in left) if left else 0
        new = {s for s in left if weight[s] * level > 2 * per[s]}
        if not new:
            break
        full |= new
    target = {s: 2 * per[s] if s in full else weight[s] * level for s in names}
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (sizes[r.doc_id], per[source[r.doc_id]]) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in names)
    mixed = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id] += len(words(r.text))
    assert all(mixed[r.doc_id] == r.taken for r in got)
    assert mixing.plan(nothing).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_points_of_any_slot(spark):
    slots = [0, 1, 5, 3_470_000_000, 1 << 32, (1 << 33) + 7, (1 << 45) + 12345]
    got = spark.createDataFrame([(x,) for x in slots], "slot long").select(mixing.point(F.col("slot"))).collect()
    assert [r[0] for r in got] == [(x * mixing.GOLDEN_32 + mixing.GOLDEN_32 // 2) % (1 << 32) / (1 << 32) for x in slots]


def removed(texts):
    seen, out = {}, {}
    for d, t in sorted(texts, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            first = seen.setdefault(raw[s : s + 100], (d, s))
            if first < (d, s):
                gone[s : s + 100] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[d] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MAX_GROUP, 2])
def test_suffix_dedup(spark, docs, nothing, rows, most):
    expected = removed([(r[0], r[1]) for r in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.spans(docs, max_group=most).collect()}
    assert got == expected and sum(v[1] for v in expected.values()) > 1000
    assert suffix_dedup.spans(nothing).count() == 0


def test_suffix_order_is_the_order_of_suffixes():
    r = np.random.default_rng(3)
    symbols = r.integers(0, 2, size=(200, 30)).astype(np.int16)
    group = r.integers(0, 9, size=200)
    sorter = suffix_dedup.SuffixOrder(group, symbols)
    order = sorter.sort()
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], symbols[i].tolist(), i))
    common = sorter.extensions(order)
    for k in range(1, 200):
        a, b = order[k - 1], order[k]
        same = symbols[a] == symbols[b]
        assert common[k] == (-1 if group[a] != group[b] else 30 if same.all() else same.argmin())


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(5)
    texts, labels = [], []
    for i in range(1200):
        w = [r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 60)) for _ in range(40)]
        toxic = int(r.random() < 0.2)
        if toxic:
            w[r.randrange(40)] = r.choice(["Scoundrel", "scoundrel,", "rascal"])
        texts.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*texts, (9001, None), (9002, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (9001, None), (5, labels[5][1])], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got) and len(got) == 1202
    right = np.mean([x.predicted == truth[x.doc_id] for x in held])
    assert right > 0.95 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    untrained = toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).first()
    assert untrained.score == 0.5


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 10), (None, 4), (20, 30), (30, 40), (40, 50), (50, 60), (2, 1)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20}
