"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import math

import duckdb
import pytest

from corpuscle.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((repr([plain(r[k]) for k in order]) for r in data))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_like_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert not {str(d[1]) for d in cursor.description} & {"HUGEINT", "DECIMAL(38,0)"}
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
