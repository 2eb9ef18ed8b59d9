"""Registered bar queries against their DuckDB twins."""

import duckdb
import pytest

from barloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    want = sorted((tuple(x) for x in r.fetchall()), key=repr)
    assert sorted((tuple(x[c] for c in r.columns) for x in df.collect()), key=repr) == want


def test_registry_without_the_corpus_part():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
