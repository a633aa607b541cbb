"""Every query that SQL can express gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if os.path.isdir(DATA)}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return int(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(plain(r[i]) for i in at) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=key)
    assert ours == theirs


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
