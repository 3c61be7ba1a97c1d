import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog, runs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "prompt_length", "unpadded_length", "supervised"]


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_language_model_folders(tmp_path):
    """The entry and what else is tested import in a copy without them, the pipeline's file left where it is."""
    root, copy = Path(entry.__file__).parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if (root / "corpus_pipeline.py").exists():
        assert (copy / "corpus_pipeline.py").exists()
    env = os.environ | {"PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    check = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print('found', len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), set(o) <= set(q))"
    said = subprocess.run([sys.executable, "-c", check], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-4:] == [str(len(catalog.queries() | runs.queries())), "False", "False", "True"], said.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0 and "error" not in found.stdout.lower().splitlines()[-1], found.stdout[-2000:]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql() | runs.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(map(tuple, cur.fetchall()))
