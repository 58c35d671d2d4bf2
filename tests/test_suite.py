import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.suite import queries as suite

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist") and hasattr(v, "__len__"):
        return str(list(v))
    if v is None or not hasattr(v, "__len__") and str(v) in ("nan", "<NA>", "NaN", "NaT"):
        return "None"
    return str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "ifb" else str(v)


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_same_rows_as_sql(spark, con, name):
    got = table(suite.queries()[name](spark, DATA).toPandas())
    assert got == table(con.execute(suite.oracle_sql()[name]).df())


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for left in ((), ("corpus_pipeline.py",)):
        at = tmp_path / f"tree{len(left)}"
        shutil.copytree(root, at, ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__", ".git", *left)])
        run = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), 'pipeline' in e.queries(), len(e.queries()))"
        out = subprocess.run([sys.executable, "-B", "-c", run], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True, check=True).stdout
        assert out.split() == ["True", "False", str(len(suite.queries()))]
