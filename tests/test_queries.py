"""Every query with SQL gives the rows of its SQL on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from terrafold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(SQL[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(found.fetchall(), [d[0] for d in found.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_gives_labelled_points(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[-1] == "pred" and df.count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
