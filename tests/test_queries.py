"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


def canon(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (bool, int)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["criterion", "n_pairs"]


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = sorted(([canon(r[c]) for c in cols] for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert ours == sorted(([canon(r[names.index(c)]) for c in cols] for r in res.fetchall()), key=repr)
