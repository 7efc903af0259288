"""Markdown as blocks, and tables of CSV, JSON and XML files as Markdown.

``blocks`` reads the lines of a text once and gives an array of (kind, level, text, cells): heading, bullet, number, quote, rule, table, code,
paragraph. ``structured_markdown`` gives a Markdown table for files that hold records, and leaves others as they are. Both
are small readers in Arrow batches; null stays null.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,level:int,text:string,cells:array<array<string>>>>"
_RULE = re.compile(r"[ \t]*([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ROW = re.compile(r"[ \t]*\|.*\|[ \t]*$")
_UNDER_HEAD = re.compile(r"[ \t]*\|[ \t:|-]+\|[ \t]*$")
#: Kinds of one line: pattern, and the group that holds the text; the level is the length of the first group.
_LINES = [("heading", re.compile(r"(#{1,6})[ \t]+(.*)")), ("quote", re.compile(r"(>)[ \t]?(.*)")),
          ("bullet", re.compile(r"([ \t]*)[-*+][ \t]+(.*)")), ("number", re.compile(r"([ \t]*)\d+[.)][ \t]+(.*)"))]


def read_blocks(text: str) -> list[dict]:
    """One pass over the lines. A fence that is never closed holds the rest; blank lines end paragraphs and tables."""
    found: list[dict] = []
    paragraph: list[str] = []
    table: list[list[str]] = []
    code: list[str] | None = None

    def add(kind: str, level: int = 0, value: str = "", cells: list[list[str]] | None = None) -> None:
        found.append({"kind": kind, "level": level, "text": value, "cells": cells or []})

    def close() -> None:
        if paragraph:
            add("paragraph", 0, " ".join(paragraph))
            paragraph.clear()
        if table:
            widest = max(map(len, table))
            add("table", widest, "", [row + [""] * (widest - len(row)) for row in table])
            table.clear()

    for line in text.split("\n"):
        fence = line.lstrip().startswith("```")
        if code is not None:
            if fence:
                add("code", 0, "\n".join(code))
                code = None
            else:
                code.append(line)
            continue
        if _ROW.match(line):
            if paragraph:
                close()
            if not _UNDER_HEAD.match(line):
                table.append([c.strip() for c in line.strip().strip("|").split("|")])
            continue
        one = next(((kind, m) for kind, p in _LINES if (m := p.match(line))), None)
        if fence or _RULE.match(line) or one or not line.strip() or table:
            close()
        if fence:
            code = []
        elif _RULE.match(line):
            add("rule")
        elif one:
            add(one[0], len(one[1][1]), one[1][2].strip())
        elif line.strip():
            paragraph.append(line.strip())
    if code is not None:
        add("code", 0, "\n".join(code))
    close()
    return found


def blocks(text: Column) -> Column:
    """The blocks of a Markdown text, in order."""

    @F.pandas_udf(BLOCKS)
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else read_blocks(t) for t in texts], dtype=object)

    return read(text)


def _cell(value: object) -> str:
    plain = json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else "" if value is None else str(value)
    return re.sub(r"\s*\n\s*", " ", plain).replace("|", r"\|").strip()


def markdown_table(rows: list[list[object]]) -> str:
    """Rows, the first of them the heads, as a table; short rows are filled up."""
    widest = max(map(len, rows))
    lines = ["| " + " | ".join([_cell(x) for x in row] + [""] * (widest - len(row))) + " |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * widest, *lines[1:]])


def _records(rows: list[dict]) -> str:
    heads = list(dict.fromkeys(k for row in rows for k in row))
    return markdown_table([heads, *[[row.get(k) for k in heads] for row in rows]])


def _csv(text: str) -> str:
    first = text.split("\n", 1)[0]
    separator = max(",;\t|", key=first.count)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if r]
    return markdown_table(rows) if rows and max(map(len, rows)) > 1 else text


def _json(text: str) -> str:
    try:
        found = json.loads(text)
    except ValueError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(found, dict):
        return markdown_table([["key", "value"], *found.items()]) if found else text
    return _records(found) if found and all(isinstance(x, dict) and x for x in found) else text


def _xml(text: str) -> str:
    children = list(ElementTree.fromstring(text))
    flat = [{**c.attrib, **{x.tag: (x.text or "").strip() for x in c}} for c in children]
    return _records(flat) if len({c.tag for c in children}) == 1 and all(flat) and not any(len(x) for c in children for x in c) else text


_READERS = {"csv": _csv, "json": _json, "xml": _xml}


def structured_markdown(text: Column, extension: Column) -> Column:
    """CSV, JSON and XML records as a Markdown table; what is no list of records, or cannot be read, is left as it is."""

    @F.pandas_udf("string")
    def read(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for t, kind in zip(texts, kinds, strict=True):
            try:
                # a document type could define entities that grow without end
                out.append(t if t is None or kind not in _READERS or "<!DOCTYPE" in t else _READERS[kind](t))
            except (ValueError, csv.Error, ElementTree.ParseError, RecursionError):
                out.append(t)
        return pd.Series(out, dtype=object)

    return read(text, extension)
