"""Every registered query against its SQL, on the smallest tables; and the driver contract."""

import math

import pytest

import __spark_entry__ as entry_module
from bizcontacts.plans.oracles import ORACLES
from bizcontacts.plans.register import QUERIES
from bizcontacts.plans.views import TABLES, VIEWS, ansi

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, float) else value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == canonical(columns, result.fetchall())


def test_views_are_plain_sql(spark, duck, sf_dir):
    for name in VIEWS:
        assert "\\" not in VIEWS[name]
        assert duck.execute(f"select count(*) from ({ansi(name)})").fetchone()[0] > 0


def test_entry(spark, sf_dir):
    df = entry_module.entry(spark)
    assert df.columns == ["source", "total", "with_email", "with_phone", "email_percentage", "phone_percentage"]
    assert df.agg({"total": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
