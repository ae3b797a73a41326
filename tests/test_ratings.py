import pytest
from pyspark.sql import functions as F

from tablewise.operators import explore, ranking, ratings
from tablewise.operators.ranking import first_by_count

REVIEWS = "user_id string, gmap_id string, rating int, time bigint"


def test_duplicates_are_averaged_for_training_and_last_for_serving(spark):
    reviews = spark.createDataFrame([("u", "i", 2, 1), ("u", "i", 4, 2), (None, "i", 5, 3)], REVIEWS)
    assert [(r.user_id, r.rating) for r in ratings.mean_ratings(reviews).collect()] == [("u", 3.0)]
    nested = ratings.nest_users(reviews.where("user_id is not null"))
    assert [r.rating for r in ratings.user_vectors(nested).collect()] == [4.0]


def test_last_array_entry_wins_and_entries_without_rating_do_not_count(spark):
    users = spark.createDataFrame(
        [("u", [(5, 9, "i"), (1, 1, "i"), (None, 2, "i"), (None, 3, "j")]), ("v", [])],
        "user_id string, ratings array<struct<rating:int,timestamp:bigint,gmap_id:string>>",
    )
    assert [tuple(r) for r in ratings.user_vectors(users).collect()] == [("u", "i", 1.0)]


def test_global_rank_is_total_and_dense(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("n"), F.col("id").cast("string").alias("k")).repartition(6)
    got = ranking.global_rank(df, F.desc("n"), F.asc("k")).orderBy("rank").collect()
    want = sorted(((r.n, r.k) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.k) for r in got] == want
    assert [r["rank"] for r in got] == list(range(1, 5001))


def test_busy_user_is_nested_in_chunks(spark):
    hot = [("hot", f"i{n % 97:02d}", 1 + n % 5, n * 37 % 1009) for n in range(1000)]
    rows = hot + [("b", "x", 1, 5), ("b", "y", 2, 4)]
    nested = ratings.nest_users(spark.createDataFrame(rows, REVIEWS).repartition(5), chunk_rows=64)
    sizes = {(r.user_id, r.chunk): r.n for r in nested.select("user_id", "chunk", F.size("ratings").alias("n")).collect()}
    assert sizes == {**{("hot", c): 64 for c in range(15)}, ("hot", 15): 40, ("b", 0): 2}
    flat = ratings.flat_ratings(nested).orderBy("user_id", "chunk", "pos").collect()
    assert [(r.user_id, r.gmap_id, r.rating, r.time) for r in flat] == sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2]))


def test_cluster_input_keeps_users_without_features(spark):
    rows = [(f"u{n}", "common", 4, n) for n in range(5)] + [("loner", f"odd{n}", 3, n) for n in range(9)]
    data = ratings.cluster_input(spark.createDataFrame(rows, REVIEWS), 6, 6, 3)
    assert {r.user_id for r in data.users.collect()} == {"loner"} | {f"u{n}" for n in range(5)}
    assert [(r.gmap_id, r.n_raters) for r in data.features.collect()] == [("common", 5)]
    assert data.ratings.count() == 5


def test_no_user_is_left_out_unless_a_limit_is_asked_for(spark):
    rows = [(f"u{n:03d}", f"i{n % 3}", 4, n) for n in range(300)] + [(f"u{n:03d}", f"j{n % 7}", 4, n) for n in range(40)]
    reviews = spark.createDataFrame(rows, REVIEWS)
    assert ratings.cluster_input(reviews, min_raters=3).users.count() == 300
    some = ratings.cluster_input(reviews, top_reviewers=100, kept_users=50, min_raters=3).users
    assert sorted(r.user_id for r in some.collect()) == [f"u{n:03d}" for n in range(50)]


@pytest.mark.parametrize("n", [1, 7, 40, 41, 299, 300, 500])
def test_first_by_count(spark, n):
    rows = [(f"u{k:03d}", (k * 7) % 11) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id string, n_items int")
    got = {r.user_id for r in first_by_count(df, n, "n_items", "user_id").collect()}
    assert got == {u for u, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:n]}


def test_users_without_reviews_are_nested_as_empty(spark):
    reviews = spark.createDataFrame([("a", "i", 4, 1)], REVIEWS)
    users = spark.createDataFrame([("a",), ("b",), ("b",)], "user_id string")
    got = {r.user_id: len(r.ratings) for r in ratings.nest_users(reviews, users=users).collect()}
    assert got == {"a": 1, "b": 0}


def test_cluster_input_without_features_is_an_error(spark):
    with pytest.raises(ValueError):
        ratings.cluster_input(spark.createDataFrame([("u", "i", 4, 0)], REVIEWS), 5, 5, 2)


def test_item_stats_round_half_to_even(spark):
    items = spark.createDataFrame([("a",), ("none",)], "gmap_id string")
    rows = [("u", "a", r, 0) for r in (4, 4, 4, 5)]
    got = {r.gmap_id: (r.Rating, r.Reviews) for r in ratings.item_stats(items, spark.createDataFrame(rows, REVIEWS)).collect()}
    assert got == {"a": (4.2, 4), "none": (0.0, 0)}


def test_random_split_is_the_same_at_any_partitioning(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("user_id"), F.lit("i").alias("gmap_id"))
    first, rest = ratings.random_split(df.repartition(7), 0.8, 1)
    again, _ = ratings.random_split(df.repartition(2), 0.8, 1)
    assert first.count() + rest.count() == 4000
    assert {r.user_id for r in first.collect()} == {r.user_id for r in again.collect()}
    assert abs(first.count() - 3200) < 150


def test_macro_stats_of_nothing(spark):
    empty = spark.createDataFrame([], REVIEWS)
    row = explore.macro_stats(empty, empty.select("user_id")).first()
    assert (row.total_reviews, row.total_users, row.average_rating, row.reviews_per_user) == (0, 0, None, None)


def test_pivot_groups_no_rating_of_other_items(spark):
    rows = [("u", "a", 2.0), ("u", "z", 5.0), ("v", "z", 1.0), (None, "b", 3.0), ("w", "b", None)]
    pairs = spark.createDataFrame(rows, "user_id string, gmap_id string, rating double")
    wide = ratings.pivot_ratings(pairs, ["a", "b"])
    assert "pivotfirst" not in wide._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.user_id or "", x.a, x.b) for x in wide.collect()) == [("", 0, 3), ("u", 2, 0), ("v", 0, 0), ("w", 0, 0)]
