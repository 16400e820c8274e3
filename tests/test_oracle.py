"""Every registered query agrees with its SQL on the smallest data set; every archive and exposure query has SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from nightledger.plans import registry
from tests import oracle

SF_DIR = f"{oracle.ROOT}/sf0.001"
REPO = Path(entry.__file__).parent


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == []


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["nightledger/llm", "corpus_pipeline.py"], ["nightledger/llm"], ["corpus_pipeline.py"]])
def test_entry_without_text_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns(".*", "__pycache__", "tests", *(Path(g).name for g in gone))
    shutil.copytree(REPO, copy, ignore=left_out)
    shown = "import __spark_entry__ as e; print(*e.queries())"
    run = subprocess.run([sys.executable, "-c", shown], cwd=copy, capture_output=True, text=True, check=True)
    found = set(run.stdout.split())
    assert found >= set(registry.QUERIES)
    assert "pipeline" not in found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
