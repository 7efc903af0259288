"""Every query can be named, and the library does without its optional folder."""

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_registry_has_a_twin_for_most():
    from inkveil.plans import registry

    names, twins = registry.queries(), registry.oracle_sql()
    assert set(twins) <= set(names) and len(names) > 80
    assert {n for n in names if n not in twins} == {"redact_full", "full_census", "full_report", "full_clean_paragraphs"}


def test_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT / "inkveil", tmp_path / "inkveil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'val_iban' in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
