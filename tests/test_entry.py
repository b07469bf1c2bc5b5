import importlib
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 45


def test_rest_works_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'decision_accuracy' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_entry_runs(spark):
    rows = importlib.import_module("__spark_entry__").entry(spark).collect()
    assert {r["evaluator_name"] for r in rows} == {"alpha", "beta"}
