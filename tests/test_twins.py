"""Every registered query against its SQL twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lintlake.suite import all_queries, all_twins

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = all_queries(), all_twins()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    return "~" if v is None else f"{type(v).__name__}:{v!r}"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(TWINS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "cnt", "ratio"] and df.count() == 8
