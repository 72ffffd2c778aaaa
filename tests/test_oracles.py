"""Every core query against its SQL in DuckDB at sf0.001."""

import math

import duckdb
import pytest

from quorumlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    key = lambda v: (v is None, round(v, 9) if isinstance(v, float) and math.isfinite(v) else v)
    return sorted([tuple(key(r[i]) for i in order) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(got, df.columns) == rows_of(rel.fetchall(), rel.columns)
