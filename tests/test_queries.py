"""Every registered query with SQL gives DuckDB's rows; the entry imports without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from inkgraph import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(queries.SQL[name]).df())


def test_without_sql(spark):
    assert set(queries.QUERIES) - set(queries.SQL) == {"communities", "communities_mini", "moc", "moc_mini"}
    assert queries.QUERIES["watch_events"](spark, SF).count() > 0
    moc = queries.QUERIES["moc_mini"](spark, SF).collect()
    assert sum(r["size"] for r in moc) == 25 and all(r["section"].startswith("## Community ") for r in moc)
    assert queries.flagship(spark, SF).count() == 20


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "inkgraph"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "inkgraph" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pagerank' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
