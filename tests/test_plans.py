"""Physical plans: what is shuffled, broadcast, pushed down and cut off early."""

import re

import pytest
from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.operators import clustering, engagement, ranking, ratings
from tablewise.plans import catalog, tables
from tablewise.shared import new_path, stored
from tablewise.sources import scans

FOLDER = "/root/testdata/sf0.001"
# these run to a result when called, what is left of their plan says nothing
EAGER = re.compile("^(als_|kmeans_|streamed_|elbow|cluster_training|stored_model|cluster_rmse)")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark):
    return stored(ratings.mean_ratings(tables.reviews(spark, FOLDER)), "pairs")


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not EAGER.match(n)))
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_a_clustering_round_shuffles_no_rating(spark, pairs):
    users = tables.users(spark, FOLDER)
    ((rows, members),) = clustering._layout(pairs, users, 10**6)
    start = stored(clustering.random_start(pairs, users, 4, 1), "start")
    near = plan(clustering.assign_clusters(rows, members, start, 4, n_cells=100))
    assert "Exchange hashpartitioning" not in near
    assert near.count("BroadcastExchange") == 1


def test_too_many_cells_are_not_broadcast(spark, pairs):
    users = tables.users(spark, FOLDER)
    start = stored(clustering.random_start(pairs, users, 4, 1), "start")
    sums = clustering.cell_sums(pairs, start, clustering.MASKED_COSINE, n_cells=100, limit=99)
    assert "BroadcastExchange" not in plan(sums)
    assert "SortMergeJoin" in plan(sums)


def test_hot_item_is_split_in_a_merge_join(spark):
    """One item holds a third of all ratings."""
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        rows = spark.range(120_000).select(
            n.cast("string").alias("user_id"),
            F.when(n % 3 == 0, "hot").otherwise(n.cast("string")).alias("gmap_id"),
            (1 + n % 5).cast("double").alias("rating"),
        )
        rows = stored(rows.repartition(8), "rows")
        cells = spark.createDataFrame([(0, "hot", 2.0), (1, "hot", 3.0)], schemas.CENTROIDS)
        sums = clustering.cell_sums(rows, cells, clustering.MASKED_COSINE, n_cells=2, limit=0)
        assert len(sums.collect()) == 80_000
        assert "skew=true" in plan(sums)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_projection_and_filter_reach_the_scan(spark):
    path = new_path(spark, "reviews")
    tables.reviews(spark, FOLDER).write.parquet(path)
    df = scans.read_table(spark, path, schemas.REVIEWS, ["user_id", "rating"]).where("rating >= 4")
    text = plan(df)
    assert "ReadSchema: struct<user_id:string,rating:int>" in text
    assert "GreaterThanOrEqual(rating,4)" in text


def test_top_n_per_key_is_limited_before_the_shuffle(pairs):
    text = plan(ranking.top_n_per(pairs, ["user_id"], 13, [F.desc("rating"), F.asc("gmap_id")]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.rindex("Partial")
    assert text.count("WindowGroupLimit") == 2


def test_histogram_of_top_keys_scans_once(spark):
    text = plan(catalog.QUERIES["top_item_ratings"](spark, FOLDER))
    assert text.count("Location: InMemoryFileIndex") == 2  # line items and orders
    assert "TakeOrderedAndProject" in text


def test_visits_are_combined_before_the_shuffle(spark):
    text = plan(engagement.visits(tables.events(spark, FOLDER)))
    exchange = text.rindex("Exchange hashpartitioning")
    assert "partial_count" in text[exchange:]


def test_newest_run_opens_no_other(spark):
    from tablewise.sources import sinks

    path = new_path(spark, "snapshot")
    for run in (1, 2):
        sinks.write_snapshot(spark.range(run).toDF("v"), path, run)
    files = scans.read_newest(spark, path, "v bigint").inputFiles()
    assert files and all("run_id=2" in f for f in files)
