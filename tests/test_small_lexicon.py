"""A small lexicon is broadcast as it is; a large one is counted and shuffled, with the same maps."""

from inkveil.operators import lexicon


def test_small_and_large_lexicons_give_the_same_maps(spark, monkeypatch):
    rows = [(1, "Walter Di Salvo e D'Amico"), (2, None), (3, "nessuno qui"), (None, "rossi"), (4, "Dell'Orlando disalvo"), (4, "walter")]
    docs = spark.createDataFrame(rows, "k int, t string")
    steps, own = [], lexicon.written
    monkeypatch.setattr(lexicon, "written", lambda df, name: steps.append(name) or own(df, name))

    def maps():
        return sorted((repr(r.k), repr(r.t), sorted(r.lexicon.items())) for r in lexicon.with_classes(docs, "k", "t", lexicon.table(spark)).collect())

    small = maps()
    # pairs of documents and entries are not counted
    assert steps == ["bits"]
    monkeypatch.setattr(lexicon, "HEAVY", 1)
    assert maps() == small
    assert steps == ["bits", "bits", "entries"]
