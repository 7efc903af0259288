"""Steps that only tell: the text stays, and no row goes through a Python function."""

from dataclasses import replace

from inkveil.operators.engine import redact
from inkveil.operators.options import PACKS, Options
from inkveil.operators.steps import STEPS, SUSPECT_STEPS

TEXTS = ["di anni 40, sesso: M; 33 years old", "tel. 333 12A4567, codice RSSMRA8A12H501ZZ", "conto DE12ABCD0123456789, numero 123456789012345", "di anni 999", "", None, "a {{X_1}} b"]


def test_telling_leaves_texts_to_the_jvm(spark):
    chosen = [*(s for s in STEPS if s.name in ("age", "sex")), *SUSPECT_STEPS]
    assert len(chosen) == 6 and not any(s.replaces for s in chosen)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    options = Options(packs=PACKS)
    got = redact(df, "text", options, steps=chosen)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    # the same as of steps that are not known to leave the text
    other = redact(df, "text", options, steps=[replace(s, replaces=True) for s in chosen])
    assert "ArrowEvalPython" in other._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("i").collect()
    assert rows == other.orderBy("i").collect()
    assert [r.redacted for r in rows] == TEXTS
    assert [[d.kind for d in r.report.detected] for r in rows][:4] == [["age", "age", "sex"], [], [], []]
    assert [r.report.suspects_total for r in rows][:3] == [0, 2, 2]
