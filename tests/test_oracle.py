"""Every query of the library against its DuckDB twin on the smallest tables."""

import datetime

import duckdb
import pytest

from lamella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names, columns, values):
    at = [columns.index(n) for n in names]
    return sorted(repr([plain(r[i]) for i in at]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    other = duck.sql(SQL[name])
    assert names == sorted(other.columns)
    assert rows(names, df.columns, df.collect()) == rows(names, other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
