"""Every registered query against its SQL, on the smallest tables."""

import inspect

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_take_session_and_folder():
    for run in entry.queries().values():
        assert len(inspect.signature(run).parameters) == 2


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["gmap_id", "rating", "rating_count"]
    assert df.count() > 0


def test_queries_without_sql_give_whole_lists(spark):
    run = lambda name: entry.queries()[name](spark, FOLDER)
    users = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_custkey").distinct().count()
    lists = run("als_recommendations").groupBy("user_id").count().collect()
    assert len(lists) == users and {r["count"] for r in lists} == {13}
    assert run("als_error").first().rmse > 0
    assert run("kmeans_euclidean_start").count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()


def test_grid_search_tries_every_setting(spark):
    rows = entry.queries()["als_grid_search"](spark, FOLDER).collect()
    want = {(m, r, k) for m in (5, 10, 15) for r in (0.01, 0.1, 1.0) for k in (10, 50, 100)}
    assert len(rows) == 27 and {(x.max_iter, x.reg_param, x.rank) for x in rows} == want
    assert all(x.rmse > 0 for x in rows)
