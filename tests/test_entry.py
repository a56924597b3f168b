"""The entry points without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOOK = """
import __spark_entry__ as e
from ledgerloom.plans.catalog import ORACLES, QUERIES
assert e.queries() == QUERIES and e.oracle_sql() == ORACLES and len(QUERIES) > 70
"""


@pytest.mark.parametrize("gone", [("ledgerloom/llm", "tests/llm"), ("ledgerloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_core_queries_stand_alone(tmp_path, gone):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        path = there / g
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", LOOK], cwd=there, check=True)
