"""Queries with SQL against it, on the smallest tables."""

import os

import pytest

from bizcontacts.llm.oracles import ORACLES
from bizcontacts.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted((dict(zip(columns, r)) for r in result.fetchall()), key=str)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(({c: r[c] for c in columns} for r in df.collect()), key=str) == want and want
