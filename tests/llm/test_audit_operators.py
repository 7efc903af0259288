"""Vector codes, sharding and the divergence audit against brute force, on small tables with odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import sharding, source_divergence, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


# ---- vector codes


def plain_nearest(x, c):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in c]
    return far.index(min(far)), min(far)


@pytest.mark.parametrize("width, spread", [(1, 3), (2, 2), (3, 5), (4, 1), (4, 400), (7, 40), (32, 9), (4, 1 << 30), (3, 1 << 90), (2, 1 << 700)])
def test_nearest_is_exact_with_ties(width, spread):
    r = random.Random(width * 7 + spread % 1000)
    draw = lambda n: [[r.randint(-spread, spread) for _ in range(width)] for _ in range(n)]
    x, c = draw(300), draw(20)
    c += c[:5] + [list(x[0])]  # repeated entries: the lower index wins
    kind = np.int64 if spread < 1 << 25 else object
    near, far = vector_codes.nearest(np.array(x, kind).reshape(-1, width), np.array(c, kind).reshape(-1, width))
    assert list(zip(near.tolist(), far.tolist(), strict=True)) == [plain_nearest(v, c) for v in x]


def test_bounds_exclude_most_entries():
    r = np.random.default_rng(5)
    rows, _ = vector_codes.survivors(r.integers(-100, 100, (2000, 4)), r.integers(-100, 100, (64, 4)))
    assert len(rows) < 0.2 * 2000 * 64
    rows, _ = vector_codes.survivors(*(np.repeat(r.integers(-100, 100, (n, 2)), 4, axis=1) + r.integers(-9, 9, (n, 8)) for n in (2000, 64)))
    assert len(rows) < 0.2 * 2000 * 64


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(v * 256) if abs(v) < 2**40 else int(v) * 256 for v in np.array(r[1], np.float32).astype(float).tolist()] for r in kept]
    length = len(whole[0])
    fits = [i for i, w in enumerate(whole) if len(w) == length]
    width = length // parts
    cut = lambda w, p: w[p * width : (p + 1) * width]
    books = [[list(cut(w, p)) for w in whole[:entries] if len(w) == length] for p in range(parts)]
    for turn in range(rounds + 1):
        found = {(i, p): plain_nearest(cut(whole[i], p), books[p]) for i in fits for p in range(parts)}
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(whole[i], p) for i in fits if found[i, p][0] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    error = [sum(found[i, p][1] for p in range(parts)) if i in fits else None for i in range(len(kept))]
    error = [e if e is None or e < 1 << 63 else None for e in error]
    label = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        label[r[2]] += e or 0
    known = {r[2] for r, e in zip(kept, error, strict=True) if e is not None}
    code = ["".join(f"{found[i, p][0]:02x}" for p in range(parts)) if i in fits else None for i in range(len(kept))]
    return Counter((r[0], c, e, label[r[2]] if r[2] in known else None, sha) for r, c, e in zip(kept, code, error, strict=True))


def vectors(n=150, width=64, seed=1, spread=0.5):
    r = random.Random(seed)
    rows = [(i * 3, [float(np.float32(r.uniform(-spread, spread))) for _ in range(width)], r.choice([0, 1, 1, 1, None])) for i in range(n)]
    bad = [list(rows[0][1]) for _ in range(4)]
    bad[0][3], bad[1][width - 1], bad[2][0], bad[3][9] = None, float("nan"), float("inf"), float("-inf")
    odd = [(900 + i, b, 1) for i, b in enumerate(bad)] + [(990, None, 1), (None, rows[3][1], None), (None, rows[2][1], 7), (3, rows[1][1], 1), (3, rows[8][1], 1)]
    return rows + odd


def coded(frame):
    return Counter(tuple(r) for r in vector_codes.report(*vector_codes.compress(frame)).collect())


def test_vector_codes(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"code": F.lit("x"), "v": F.lit(1), "error": F.lit(2), "name": F.lit("y")})
    assert coded(frame) == plain_codes(rows)


def test_few_vectors_other_lengths_and_large_components(spark):
    few = vectors(9, 16, 2) + [(5000, [0.5] * 15, 1), (5001, [], 1)]
    assert coded(spark.createDataFrame(few, VECTORS).repartition(3)) == plain_codes(few)
    large = vectors(80, 32, 3)
    for k, v in ((1, 3e38), (40, -2e30), (70, 1e12), (71, 16777217.0)):
        large[k][1][5] = float(np.float32(v))
    assert coded(spark.createDataFrame(large, VECTORS).repartition(3)) == plain_codes(large)


def test_vector_codes_of_nothing_and_of_parts_that_do_not_fit(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert vector_codes.report(*vector_codes.compress(nothing)).collect() == []
    assert coded(spark.createDataFrame([(1, None, 2)], VECTORS)) == Counter()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 17, 2)], VECTORS))


def test_codes_decode_to_entries(spark):
    rows = vectors(100, 32, 4)
    codes, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
    for r in vector_codes.decode(codes, books).collect():
        assert r["vector"] == [v for p, e in enumerate(r["code"]) for v in books.entries[p][e]]


# ---- sharding


def documents(n=3000, seed=3):
    r = random.Random(seed)
    text = lambda: r.choice(["é", "ab", "x "]) * int(r.paretovariate(0.9) * 20 % 5000)
    rows = [(i, text(), "en", r.choice(["hot", "hot", "s1", None]), 0) for i in range(n)]
    copies = [(10_000 + i, "the same text " * 9, None, "hot", 0) for i in range(n // 2)]
    return rows + copies + [(7, None, None, None, None), (7, None, None, None, None), (None, "x", "en", "s", 1), (7, "", "en", "s", 1), (20_000, "q" * 400_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def placed(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"shard": F.lit("x"), "h": F.lit(1), "size": F.lit("y"), "vslot": F.lit(2), "bytes": F.lit(3)})
    return rows, frame, [r.asDict() for r in sharding.place(frame).collect()]


def test_shards_hold_whole_records_in_gapless_places(placed):
    rows, _, got = placed
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    for shard, own in groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert 0 <= shard < 16
        assert [r["slot"] for r in own] == list(range(sum(r["shard"] == shard for r in got)))
    assert {(r["law"], r["grown_shard"], r["version"]) for r in got} == {("bytes", None, 2)}


def test_bytes_are_near_equal(placed):
    full = Counter()
    for r in placed[2]:
        full[r["shard"]] += r["size"]
    rest = sorted(full.values())
    # one text alone is above the mean of all shards; the others share what is left
    assert rest[-1] >= 400_001 and rest[-2] - rest[0] < 0.01 * sum(rest) / 16


def test_slots_never_change_and_runs_agree(placed):
    _, frame, got = placed
    again = sharding.place(frame.limit(10**6).repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"], r["vslot"])
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in again)


def test_map_versions_and_edits(spark, tmp_path):
    path, slots = f"file://{tmp_path}/map", 256
    r = random.Random(8)
    sizes = spark.createDataFrame([(s, r.randint(1, 1000), 3) for s in range(slots) if s % 9], "vslot int, bytes long, rows long")
    weight = dict(sizes.select("vslot", "bytes").collect())
    sharding.store_map(sharding.first_map(spark, 8, slots), path)
    shown = lambda v: {x["vslot"]: x["shard"] for x in sharding.load_map(spark, path, v).collect()}

    def bytes_of(m, n):
        return [sum(weight.get(s, 0) for s, shard in m.items() if shard == j) for j in range(n)]

    for version, shards in ((2, 8), (3, 9), (4, 5)):
        sharding.store_map(sharding.rebalance(sharding.load_map(spark, path), sizes, shards), path)
        before, after = shown(version - 1), shown(version)
        assert set(after) == set(range(slots)) and set(after.values()) == set(range(shards))
        full = bytes_of(after, shards)
        assert max(full) - min(full) < 0.02 * sum(full) / shards
        assert shown(1) == {s: s % 8 for s in range(slots)}
        if shards == 9:
            # what the edit moves is hardly more than the new shard's share
            moved = sum(weight.get(s, 0) for s in after if after[s] != before[s])
            assert moved < 1.3 * sum(weight.values()) / 9
        if shards == 8:
            kept = sum(after[s] == before[s] for s in after)
            assert kept > 0.8 * slots
    settled = {x["vslot"]: x["shard"] for x in sharding.rebalance(sharding.load_map(spark, path), sizes.filter("false"), 5).collect()}
    assert settled == shown(4)


def test_write_shards_and_assign_keep_columns(spark, tmp_path, placed):
    rows, frame, got = placed
    table = sharding.first_map(spark, 4, 64)
    plain = spark.createDataFrame(rows, DOCS).withColumn("_slot", F.lit(1))
    sharding.write_shards(plain, table, f"file://{tmp_path}/out", slots=64)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(back.columns) == {*plain.columns, "shard"} and back.count() == len(rows)


def test_sharding_of_nothing_and_of_little(spark):
    assert sharding.place(spark.createDataFrame([], DOCS)).collect() == []
    one = sharding.place(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert [(r["size"], r["text_crc32"], r["slot"]) for r in one] == [(1, 0, 0)]


# ---- source divergence


def plain_audit(rows, least=30, top=50):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    groups, counts, docs = set(), Counter(), Counter()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [t.translate(lower) for t in terms]
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted((s for x, s in groups if x == lang), key=lambda s: s.encode())

        def shares(count):
            whole = sum(count.values()) + 5 * len(kept)
            return {t: 1 + (10**9 * (count[t] + 5)) // whole for t in kept}

        p = {s: shares(Counter({t: counts[lang, s, t] for t in kept})) for s in sources}
        q = shares(Counter({t: sum(counts[lang, s, t] for s in sources) for t in kept}))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over[:top])]
    return Counter(out)


def spoken(n=400, seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcxyzéßЖ") for _ in range(r.randint(1, 5))) for _ in range(150)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choice(["hot"] * 5 + ["s1", "s2", "S2", "é", None, ""])
        own = [r.choice(words[: r.choice([5, 40, 150])]) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", ", ", "\n", "_9-"]).join(w.upper() if r.random() < 0.2 else w for w in own), lang, source, 0))
    rows += [(n, None, "en", "only null", 0), (n + 1, "a b " * 30_000 + "z" * 70_000, "de", "s1", 0), (n + 2, "x", "rare", "one", 0), (n + 3, "12 !", "rare", "two", 0)]
    return rows + rows[:20]


def test_source_divergence(spark):
    rows = spoken()
    frame = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"term": F.lit("x"), "n": F.lit(1), "p": F.lit(2), "g": F.lit(3), "item": F.lit("y")})
    got = Counter(tuple(r) for r in source_divergence.audit(frame, least_docs=12, top=7).collect())
    assert got == plain_audit(rows, 12, 7)
    assert {r[0] for r in got} == {"", "en", "de", "rare"} and any(r[4] == 0 for r in got)


def summed(batches, keys):
    total = defaultdict(lambda: np.zeros(2, np.int64))
    for b in batches:
        for row in b.to_pylist():
            total[tuple(row[k] for k in keys)] += np.array([row[v] for v in row if v not in keys] * 2)[:2]
    return {k: v.tolist() for k, v in total.items()}


def test_small_pieces_count_the_same(monkeypatch):
    """Counts handed on early, and texts, postings and pairs read in small pieces."""
    rows, r = spoken(120), random.Random(4)
    table = [pa.RecordBatch.from_pylist([{"lang": x[2] or "", "source": x[3] or "", "text": (x[1] or "").encode()} for x in rows])]
    lists = [[(g, z + r.randint(1, 90), z) for g in r.sample(range(30), r.randint(2, 20)) for z in (10 + g % 7,)] for _ in range(60)]
    kind = pa.list_(pa.struct([("g", pa.int64()), ("p", pa.int64()), ("z", pa.int64())]))
    postings = [pa.RecordBatch.from_arrays([pa.array([[dict(zip("gpz", x, strict=True)) for x in one] for one in lists], kind)], names=["postings"])]
    whole = summed(source_divergence._count(table), ("lang", "source", "term")), summed(source_divergence._overlaps(postings), ("a", "b"))
    expected = Counter()
    for one in lists:
        for i, x in enumerate(one):
            for y in one[i + 1 :]:
                expected[tuple(sorted((x[0], y[0])))] += max(0, min(x[1], y[1]) - max(x[2], y[2]))
    assert {k: v[0] for k, v in whole[1].items()} == {k: v for k, v in expected.items() if v}
    for name, value in (("SLICE", 7), ("MOST_ENTRIES", 11), ("MOST_PAIRS", 5), ("BLOCK", 2)):
        monkeypatch.setattr(source_divergence, name, value)
    assert whole == (summed(source_divergence._count(table), ("lang", "source", "term")), summed(source_divergence._overlaps(postings), ("a", "b")))


def test_source_divergence_of_nothing(spark):
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    one = source_divergence.audit(spark.createDataFrame([(1, None, None, None, None), (2, "a", None, "b", None)], DOCS)).collect()
    assert Counter(map(tuple, one)) == Counter({("", "", "pair", "b", 0, 1): 1, ("", "b", "pair", "", 0, 1): 1})


def test_shares_stay_exact_for_large_counts(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        n = r.randint(0, 8 * 10**15)
        rows.append((r.randint(0, n), n, r.randint(1, 10**9)))
    frame = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", source_divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for c, n, v, p in frame.collect():
        assert p == 1 + (10**9 * (c + 5)) // (n + 5 * v)
