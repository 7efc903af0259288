"""The pipeline on a small fixture, stage by stage."""

import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(2)
    text = lambda: " ".join(r.choice(["the", "of", "and"]) if k % 4 == 0 else "w%d" % r.randint(0, 5000) for k in range(80))
    good = {i: text() for i in range(12)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in good.items()]
    rows += [(20, good[3], "en", "s0", 1), (21, "junk*** " * 90, "en", "s1", 1), (22, None, "en", "s1", 0), (23, text() + " leak " + " ".join("q%d" % k for k in range(20)), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join("q%d" % k for k in range(20)))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    ids = [sorted(x.doc_id for x in d.collect()) for d in seen]
    assert ids[0] == [*range(12), 20, 23] and ids[1] == [*range(12), 23] and ids[2] == list(range(12))
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:4])
    assert all(x.text == good[x.doc_id] or good[x.doc_id].startswith(x.text) for x in seen[3].collect())
    mixed = sum(len(x.text.split()) for x in seen[3].collect())
    assert mixed == pytest.approx(1.5 * 80 * 12, rel=0.02)
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    stored = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in seen[4].collect())
    expected = sorted((x.doc_id, len(e := [*tokenizer.encode(x.text, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(e, "<u4").tobytes())) for x in seen[3].collect())
    assert sorted(s[1:] for s in stored) == expected
    for start, _, n, _ in stored:
        assert start == at
        at += n
