import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["vertex", "cnt"] and out.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("wanderframe/llm", "tests/llm"), ("wanderframe/llm", "tests/llm", "corpus_pipeline.py")], ids=["folders", "folders and pipeline"])
def test_the_graph_part_stands_alone(tmp_path, gone):
    """In a copy of the repository from which the corpus folders are really deleted."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        at = tmp_path / "copy" / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e, json, bench, wanderframe.catalog as c; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql()), sorted(c.queries()), sorted(c.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    found, sql, own, own_sql = json.loads(said.stdout.splitlines()[-1])
    assert (found, sql) == (own, own_sql)
