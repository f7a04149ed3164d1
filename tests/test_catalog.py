"""Every registered query with SQL gives the same rows as DuckDB; the others run."""

import pytest

from foliospark.plans import catalog
from tests.conftest import same_as_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    same_as_sql(spark, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= (0 if name == "qry20_missing_spaces" else 1)


@pytest.mark.parametrize(
    "name, table, key",
    [("jon06_gather", "orders", "o_custkey"), ("srt06_expiry_key", "orders", "o_orderkey"), ("agg07_compounded", "lineitem", "l_orderkey"), ("agg07_product", "lineitem", "l_orderkey"), ("scl34_numbers", "orders", "o_orderkey"), ("jon10_add_new", "customer", "c_custkey"), ("srt02_headcount", "supplier", "s_suppkey"), ("srt04_term", "part", "p_partkey")],
)
def test_whole_tables(spark, name, table, key):
    got = catalog.QUERIES[name](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count()


def test_entry_and_guard(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
