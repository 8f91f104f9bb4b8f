"""The registered queries against DuckDB, and the entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stratamem.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.5f}".replace("-0.00000", "0.00000")
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in sorted(names)]
    assert sorted(got) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "stratamem", tmp_path / "stratamem", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
