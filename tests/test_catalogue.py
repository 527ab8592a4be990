"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from basaltql.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else v
    return v


def rows(names, held):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in held), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
