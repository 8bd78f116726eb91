"""The driver contract holds with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from heatloom.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []])
def test_entry_without_the_corpus_subpackage(tmp_path, left):
    shutil.copytree(f"{ROOT}/heatloom", tmp_path / "heatloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *left]:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    got, sql = (line.split() for line in done.stdout.strip().split("\n"))
    assert got == sorted(catalog.queries()) and sql == sorted(catalog.oracle_sql())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
