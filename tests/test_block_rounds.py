"""Rounds over blocks against rounds by joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.functions import distances
from tablewise.operators import block_rounds, choice, clustering

RATINGS = "user_id string, gmap_id string, rating double"


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for name, value in (("TASK_RATINGS", 100), ("UNIT_RATINGS", 60), ("ITEM_RATINGS", 150), ("USER_RATINGS", 200), ("CELLS_AT_ONCE", 50)):
        monkeypatch.setattr(block_rounds, name, value)


def odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{u:02d}", f"i{i:02d}", float(rng.integers(2, 11)) / 2) for u in range(50) for i in range(25) if rng.random() < 0.4]
    rows += [("u01", None, 4.0), ("u02", "i01", 10 / 3), ("u03", "i02", 0.0), ("u04", "i03", None), (None, "i04", 3.0)]
    rows += [("nobody", "i05", 5.0), ("only null", None, 2.0), ("u05", "i24", 700.0), ("u06", "i24", 1e-7)]
    users = [*(f"u{u:02d}" for u in range(50)), "u07", "u07", None, None, "bare", "only null"]
    return spark.createDataFrame(rows, RATINGS), spark.createDataFrame([(u,) for u in users], "user_id string")


def start_cells(spark):
    rng = np.random.default_rng(4)
    cells = [(c, f"i{i:02d}", float(rng.integers(1, 6))) for c in range(4) for i in range(25) if rng.random() < 0.5]
    return spark.createDataFrame([*cells, (1, "unrated", 3.0), (2, None, 2.0)], "cluster_id int, gmap_id string, value double")


@pytest.mark.parametrize(
    "distance", [distances.MASKED_COSINE, distances.SQUARED_EUCLIDEAN, distances.COSINE, distances.FULL_NORM_COSINE]
)
def test_blocks_give_what_joins_give(spark, distance, monkeypatch):
    ratings, users = odd_rows(spark)
    start = start_cells(spark)
    by_joins = clustering._from_start(clustering._layout(ratings, users, 10**6), 4, distance, start, 4, 1e-4, 1, 10**6)
    monkeypatch.setattr(clustering, "_rounds", None)
    got = clustering.kmeans(ratings, users, 4, distance, start, max_iter=4, tol=1e-4)
    rows = lambda df: sorted([tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()], key=repr)
    assert got.errors == pytest.approx(by_joins.errors)
    assert rows(got.assignments) == rows(by_joins.assignments) and len(rows(got.assignments)) == 56
    key = ["cluster_id", "gmap_id", F.round("value", 7).alias("value")]
    assert rows(got.centroids.select(*key)) == rows(by_joins.centroids.select(*key))


def test_unmoved_cells_and_few_users(spark):
    ratings, users = odd_rows(spark)
    one = clustering.kmeans(ratings, users, 1, init="random", tol=0.0)
    assert len(one.errors) == 2
    none = clustering.kmeans(ratings.limit(0), users.limit(0), 2, init="random")
    assert none.assignments.isEmpty() and none.errors == [0.0]


def test_elbow_rounds_join_no_ratings_with_cells(spark, monkeypatch):
    ratings, users = odd_rows(spark)
    ratings, users = ratings.dropDuplicates(["user_id", "gmap_id"]), users.distinct()
    monkeypatch.setattr(choice, "assign_runs", None)
    monkeypatch.setattr(clustering, "_layout", None)
    monkeypatch.setattr(block_rounds, "CLUSTERS_AT_ONCE", 6)
    rows = choice.elbow(ratings, users, [2, 4, 5], init="random", max_iter=3).collect()
    assert sorted(r.k for r in rows) == [2, 4, 5]


def test_rows_travel_in_the_narrowest_type_that_is_exact():
    rows = np.array([[0, 255.0], [1.5, 2.0], [1 / 3, 0.0], [256.0, 1.0], [7.0, 0.0]])
    found = block_rounds._narrow([rows[:2], rows[2:]])
    assert found.small.dtype == np.uint8 and [(list(i), m.dtype.name) for i, m in found.rows] == [([1], "float32"), ([3], "float32"), ([2], "float64")]
    back = found.small.astype(float)
    for i, m in found.rows:
        back[i] = m
    assert (back == rows).all()


def test_query_of_three_runs_lays_out_once(spark, monkeypatch):
    from tablewise.plans import clustering_queries

    calls, lay_out = [], block_rounds.lay_out
    monkeypatch.setattr(block_rounds, "lay_out", lambda *args: calls.append(1) or lay_out(*args))
    ratings, users = odd_rows(spark)
    monkeypatch.setattr(clustering_queries, "_input", lambda *_: (ratings.dropDuplicates(["user_id", "gmap_id"]), users.distinct()))
    rows = {r.stopped_by: r.rounds for r in clustering_queries.kmeans_stops(spark, "").collect()}
    assert len(calls) == 1 and rows["unmoved cells"] == 2 and rows["round limit"] == 1
