"""Blocks of Markdown, records as tables, references, what is added behind redaction, first examples."""

from pyspark.sql import functions as F

from inkveil.functions import blocks, text
from inkveil.operators import evaluate
from inkveil.sources import files


def test_blocks_of_a_page():
    page = "# Head #\n\ntwo\n lines \n| a | b |\n|---|:-:|\n| 1 |\n* x\n  - y\n3) z\n> q\n***\n```py\n# code\n\n```\nafter {{EMAIL_1}}\n```\nopen"
    got = [(b["kind"], b["level"], b["text"]) for b in blocks.read_blocks(page)]
    assert got == [
        ("heading", 1, "Head #"), ("paragraph", 0, "two lines"), ("table", 2, ""), ("bullet", 0, "x"), ("bullet", 2, "y"), ("number", 0, "z"), ("quote", 1, "q"),
        ("rule", 0, ""), ("code", 0, "# code\n"), ("paragraph", 0, "after {{EMAIL_1}}"), ("code", 0, "open"),
    ]
    assert blocks.read_blocks(page)[2]["cells"] == [["a", "b"], ["1", ""]]
    assert blocks.read_blocks("") == [] and blocks.read_blocks("#no head\n----x") == [{"kind": "paragraph", "level": 0, "text": "#no head ----x", "cells": []}]


def test_long_lines_are_linear():
    import time

    begun = time.perf_counter()
    blocks.read_blocks((" " * 50_000 + "x\n") + "- " * 50_000 + "\n" + "|" * 50_000 + "\n" + "_ " * 50_000)
    assert time.perf_counter() - begun < 2


def test_records_become_tables(spark, tmp_path):
    cases = {
        "a.csv": ('name;note\nAnn;"a|b\nc"\nBo\n', "| name | note |\n| --- | --- |\n| Ann | a\\|b c |\n| Bo |  |"),
        "b.json": ('[{"a": 1, "b": [2]}, {"a": null, "c": "x"}]', "| a | b | c |\n| --- | --- | --- |\n| 1 | [2] |  |\n|  |  | x |"),
        "c.json": ('{"a": 1}\n{"a": 2}\n', "| a |\n| --- |\n| 1 |\n| 2 |"),
        "d.json": ("[1, 2]", "[1, 2]"),
        "e.json": ("{broken", "{broken"),
        "f.xml": ("<r><i id='1'><n>x</n></i><i><n>y</n></i></r>", "| id | n |\n| --- | --- |\n| 1 | x |\n|  | y |"),
        "g.xml": ("<r>text</r>", "<r>text</r>"),
        "h.xml": ('<!DOCTYPE r [<!ENTITY a "b">]><r><i><n>&a;</n></i></r>', None),
        "i.csv": ("one column\nonly\n", "one column\nonly\n"),
    }
    for name, (content, _) in cases.items():
        (tmp_path / name).write_text(content)
    got = {r.name: (r.markdown, r.engine, r.error) for r in files.convert(files.scan(spark, f"file://{tmp_path}")).collect()}
    assert got == {name: (content if table is None else table, "records", None) for name, (content, table) in cases.items()}


def test_references_are_decoded_once(spark):
    df = spark.createDataFrame([("caf&eacute; &#8217; &#x20AC; &amp;lt; &nbsp;|",), ("a & b &qqq;",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(text.html_to_text(F.col("t"))).collect()] == ["café ’ € &lt;  |", "a & b &qqq;", None, "plain"]


def test_a_reference_needs_its_semicolon(spark):
    rows = [("R&D &ampThe &amp<b>Ly</b>. &copy 1 &ampfoo; &#65 &#65;",), ("&notin; &notit; &amp;amp; &lt",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.html_to_text(F.col("t"))).collect()]
    assert got == ["R&D &ampThe &ampLy. &copy 1 &ampfoo; &#65 A", "∉ &notit; &amp; &lt"]


def test_what_is_added_behind_redaction(spark):
    df = spark.createDataFrame([("x", None), (" \n", "c"), (None, "c")], "t string, c string")
    assert [r[0] for r in df.select(text.finished(F.col("t"), "nothing", F.col("c"), F.lit("f"))).collect()] == ["x\n\n---\n\nf", "nothing\n\n> c\n\n---\n\nf", None]


def test_first_examples(spark):
    rows = [("a", i % 9) for i in range(100)] + [("b", None), (None, 3), (None, 1)]
    got = evaluate.first_examples(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", 3).collect()
    assert sorted(((r.g, r.n, r.examples) for r in got), key=str) == [("a", 9, [0, 1, 2]), (None, 2, [1, 3])]
