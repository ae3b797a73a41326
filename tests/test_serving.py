import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import als, serving
from tablewise.plans import training
from tablewise.shared import new_path

ITEMS = "gmap_id string, name string, address string, url string, img_url string, Rating double, Reviews bigint"
USERS = "user_id string, ratings array<struct<rating:int,timestamp:bigint,gmap_id:string>>"
RECS = "user_id string, gmap_id string, score double"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{n:02d}", f"Place {n}", "x" if n % 2 else None, "u", None, n % 5 + 0.5, n) for n in range(70)]
    return spark.createDataFrame(rows + [("none", "Other", None, None, "img", None, None)], ITEMS)


def test_listing_puts_missing_last_when_descending_and_first_when_ascending(items):
    assert serving.list_items(items, page=3).collect()[-1].gmap_id == "none"
    assert serving.list_items(items, page=4).count() == 0
    first = serving.list_items(items, order_by="address").first()
    assert (first.gmap_id, first.address) == ("i00", None)
    assert serving.list_items(items, search="^other$").count() == 1
    assert serving.page_count(items).first().total_pages == 3
    with pytest.raises(ValueError):
        serving.list_items(items, page=0)
    with pytest.raises(ValueError):
        serving.list_items(items, order_by="password")


def test_review_page_keeps_order_and_unknown_items(spark, items):
    entries = [(1 + n % 5, n, f"i{n:02d}" if n else "gone") for n in range(40)]
    users = spark.createDataFrame([("u", entries), ("v", [])], USERS)
    page = serving.user_reviews_page(users, items, "u", page=1).orderBy("pos").collect()
    assert [r.gmap_id for r in page] == [e[2] for e in entries[:30]]
    assert page[0].name is None and page[1].name == "Place 1"
    assert serving.user_reviews_page(users, items, "u", page=2).count() == 10
    assert serving.user_reviews_page(users, items, "v").count() == 0


def test_details_and_defaults(spark, items):
    wanted = spark.createDataFrame([("i01",), ("none",), ("?",)], "gmap_id string")
    got = {r.gmap_id: r for r in serving.item_details(items, wanted).collect()}
    assert not got["?"].found and got["i01"].rating == "1.5"
    assert (got["none"].rating, got["none"].reviews, got["none"].address) == ("N/A", 0, "No Address available.")
    recs = spark.createDataFrame([("u", "?", 2.0), ("u", "i01", 3.0)], RECS)
    rows = serving.enrich_recommendations(recs, items).orderBy("rank").collect()
    assert [r.name for r in rows] == ["Place 1", "Name not available"]
    assert rows[1].avg_rating == 0.0 and rows[1].img_url.startswith("https://")


def test_served_lists_hold_no_rated_item_and_cold_users_get_none(spark):
    users = spark.createDataFrame(
        [("u", [(5, 1, "a"), (5, 2, "b")]), ("far", [(3, 1, "zzz")]), ("cold", [])], USERS
    )
    centroids = spark.createDataFrame([(0, "q", 1.0), (1, "a", 5.0), (1, "b", 5.0)], "cluster_id int, gmap_id string, value double")
    lists = spark.createDataFrame(
        [(0, [("zzz", 9.0), ("q", 1.0)]), (1, [("a", 5.0)] + [(f"n{x:02d}", 4.0) for x in range(20)])],
        "cluster_id int, recommendations array<struct<gmap_id:string,score:double>>",
    )
    rows = serving.serve_cluster_recommendations(users, centroids, lists, 3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r["rank"])):
        got.setdefault(r.user_id, []).append(r.gmap_id)
    assert got == {"u": [f"n{x:02d}" for x in range(13)], "far": ["q"]}


def test_refreshed_lists_replace_trained_ones(spark):
    trained = spark.createDataFrame([("u", "a", 1.0), ("v", "b", 1.0)], RECS)
    fresh = spark.createDataFrame([("u", "c", 2.0)], RECS)
    merged = serving.merge_recommendations(trained, fresh)
    assert {(r.user_id, r.gmap_id) for r in merged.collect()} == {("u", "c"), ("v", "b")}


@pytest.fixture(scope="module")
def planted(spark):
    """Five groups of users with the same taste."""
    u, i = F.col("id") % 120, F.floor(F.col("id") / 120)
    return (
        spark.range(120 * 60)
        .where(F.xxhash64("id") % 10 < 3)
        .select(u.cast("string").alias("user_id"), i.cast("string").alias("gmap_id"), (1 + (u % 5 + i % 5) % 5).cast("double").alias("rating"))
    )


def test_als_beats_the_mean_and_repeats_itself(spark, planted):
    index = als.index_ids(planted)
    coded = als.encode(planted, index)
    train, test = coded.where("(user_index + rest_id) % 5 <> 0"), coded.where("(user_index + rest_id) % 5 = 0")
    first = als.evaluate_als(als.train_als(train, blocks=4), test).first()
    again = als.evaluate_als(als.train_als(train, blocks=4), test).first()
    constant = test.agg(F.stddev_pop("rating")).first()[0]
    assert first.n == again.n > 100
    assert first.rmse == pytest.approx(again.rmse)
    assert first.rmse < 0.6 * constant


def test_als_lists_have_thirteen_items_under_their_ids(spark, planted):
    index = als.index_ids(planted)
    model = als.train_als(als.encode(planted, index), blocks=4, max_iter=2)
    recs = als.decode_recommendations(als.recommend_all(model), index)
    counts = recs.groupBy("user_id").count().collect()
    assert len(counts) == 120 and {r["count"] for r in counts} == {13}
    assert {r.gmap_id for r in recs.select("gmap_id").distinct().collect()} <= {str(n) for n in range(60)}


def test_index_is_by_frequency_then_id_and_skips_nulls(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("c", "z"), (None, "z")], "user_id string, gmap_id string")
    index = als.index_ids(df)
    assert {r.user_id: r.user_index for r in index.users.collect()} == {"c": 0, "a": 1, "b": 2}
    assert {r.gmap_id: r.rest_id for r in index.items.collect()} == {"x": 0, "z": 1, "y": 2}


def test_lists_made_chunk_by_chunk_are_those_of_all_items(spark):
    rows = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(30) for i in range(u % 3, 40, 3)]
    coded = spark.createDataFrame(rows, "user_index int, rest_id int, rating float")
    model = als.train_als(coded, blocks=2, max_iter=3)
    users = {x.id: np.array(x.features, float) for x in model.userFactors.collect()}
    items = {x.id: np.array(x.features, float) for x in model.itemFactors.collect()}
    want = {u: sorted((-np.float32(a @ b), i) for i, b in items.items())[:5] for u, a in users.items()}
    for chunk in (3, 17, 1000):
        got = {}
        for x in als.recommend_all(model, 5, chunk).collect():
            got.setdefault(x.user_index, []).append((-x.score, x.rest_id))
        assert {u: [s for s, _ in sorted(v)] for u, v in got.items()} == {
            u: pytest.approx([s for s, _ in v], rel=1e-6) for u, v in want.items()
        }
        assert all(len({i for _, i in v}) == 5 for v in got.values())


def test_error_without_lists_is_that_of_the_whole_run(spark):
    rows = [(f"u{u}", f"i{i}", (u * 7 + i * 3) % 5 + 1, 0) for u in range(30) for i in range(u % 3, 40, 3)]
    reviews = spark.createDataFrame(rows, "user_id string, gmap_id string, rating int, time bigint")
    whole = training.train_recommendations(reviews, new_path(spark, "lists"), 1, blocks=1, max_iter=2).first()
    alone = training.recommendation_error(reviews, blocks=1, max_iter=2).first()
    assert (alone.n, alone.rmse) == (whole.n, pytest.approx(whole.rmse))
