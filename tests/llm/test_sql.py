"""Queries of the training-data operators against their SQL in DuckDB."""

import duckdb
import pytest

from quorumlake.llm import queries
from tests.test_oracles import rows_of

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(map(tuple, df.collect()), df.columns) == rows_of(rel.fetchall(), rel.columns)
