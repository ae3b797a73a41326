"""Lookups and lists for the pages of the app, for one user or for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.scalars import NO_IMAGE, filled
from tablewise.operators.clustering import assign_clusters
from tablewise.operators.ranking import top_n_per
from tablewise.operators.ratings import flat_ratings, user_vectors

# Fixed values
PER_PAGE = 30
SERVED, SHOWN = 13, 10
DESCENDING = ("Rating", "Reviews")
RECOMMENDED_DEFAULTS = {
    "name": "Name not available",
    "address": "Address not available",
    "url": "URL not available",
}
ITEM_DEFAULTS = {"rating": "N/A", "address": "No Address available.", "url": "No URL available."}
REVIEW_DEFAULTS = {
    "name": "No Name Available",
    "img_url": "No Image Available",
    "avg_rating": "N/A",
    "user_rating": "No Rating Available",
    "address": "No Address Available",
    "url": "No URL Available",
}

# fields an item listing can be sorted by
LISTING_FIELDS = (*DESCENDING, "name", "address", "gmap_id", "url", "img_url")


def search_items(items: DataFrame, pattern: str = "") -> DataFrame:
    """Items whose name matches a regular expression, in any case; an empty one matches all."""
    return items.where(F.col("name").rlike("(?i)" + pattern)) if pattern else items


def _page(df: DataFrame, page: int, per_page: int, *order: Column | str) -> DataFrame:
    if page < 1:
        raise ValueError("pages are counted from 1")
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def list_items(
    items: DataFrame, search: str = "", order_by: str = "Rating", page: int = 1, per_page: int = PER_PAGE
) -> DataFrame:
    """One page of items; ties are in id order."""
    if order_by not in LISTING_FIELDS:
        raise ValueError(f"cannot sort by {order_by!r}")
    order = F.desc(order_by) if order_by in DESCENDING else F.asc(order_by)
    return _page(search_items(items, search), page, per_page, order, "gmap_id")


def page_count(df: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """One row: number of rows and of pages."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.ceil(n / per_page).alias("total_pages"))


def user_reviews_page(
    users: DataFrame, items: DataFrame, user_id: str, page: int = 1, per_page: int = PER_PAGE
) -> DataFrame:
    """One page of a user's ratings in stored order, with name and image where the item is known."""
    mine = flat_ratings(users.where(F.col("user_id") == user_id), only_rated=False)
    shown = _page(mine, page, per_page, "chunk", "pos")
    # a page holds per_page rows at most
    wanted = items.select("gmap_id", "name", "img_url").join(
        F.broadcast(shown.select("gmap_id").distinct()), "gmap_id", "left_semi"
    )
    return shown.join(wanted, "gmap_id", "left")


def enrich_recommendations(recs: DataFrame, items: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` recommendations of every user with item details, defaults where unknown."""
    shown = top_n_per(recs, ["user_id"], n, [F.desc("score"), F.asc("gmap_id")])
    details = items.select("gmap_id", "name", "address", "url", "Rating", "Reviews", "img_url")
    return shown.join(details, "gmap_id", "left").select(
        "user_id",
        "rank",
        "gmap_id",
        *[filled(c, text).alias(c) for c, text in RECOMMENDED_DEFAULTS.items()],
        filled("score", 0.0).alias("prediction"),
        filled("Rating", 0.0).alias("avg_rating"),
        filled("Reviews", 0).alias("num_reviews"),
        filled("img_url", NO_IMAGE).alias("img_url"),
    )


def item_details(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Details per wanted id with defaults; ``found`` is false for an unknown item."""
    known = items.withColumn("found", F.lit(True))
    return (
        ids.select("gmap_id")
        .distinct()
        .join(known, "gmap_id", "left")
        .select(
            "gmap_id",
            filled("found", False).alias("found"),
            "name",
            "img_url",
            filled(F.col("Rating").cast("string"), ITEM_DEFAULTS["rating"]).alias("rating"),
            filled("Reviews", 0).alias("reviews"),
            filled("address", ITEM_DEFAULTS["address"]).alias("address"),
            filled("url", ITEM_DEFAULTS["url"]).alias("url"),
        )
    )


def review_details(items: DataFrame, reviews: DataFrame, wanted: DataFrame) -> DataFrame:
    """Item details and the user's own last rating per wanted (user, item); unknown items give no row."""
    keys = wanted.select("user_id", "gmap_id").distinct()
    own = reviews.groupBy("user_id", "gmap_id").agg(
        F.max_by("rating", F.struct("time", "rating")).cast("string").alias("user_rating")
    )
    known = items.withColumn("avg_rating", F.col("Rating").cast("string"))
    return (
        keys.join(known, "gmap_id")
        .join(own, ["user_id", "gmap_id"], "left")
        .select(
            "user_id",
            "gmap_id",
            filled("Reviews", 0).alias("reviews"),
            *[filled(c, text).alias(c) for c, text in REVIEW_DEFAULTS.items()],
        )
    )


def recs_for_cluster(assignments: DataFrame, lists: DataFrame) -> DataFrame:
    """Every user with the nested list of its cluster, empty when there is none."""
    empty = F.from_json(F.lit("[]"), "array<struct<gmap_id:string,score:double>>")
    return assignments.join(lists, "cluster_id", "left").select(
        "user_id", "cluster_id", F.coalesce("recommendations", empty).alias("recommendations")
    )


def unseen(
    recs: DataFrame, ratings: DataFrame, n: int = SERVED, offered: DataFrame | None = None
) -> DataFrame:
    """The first ``n`` recommendations per user that the user has not rated.

    Only ratings of items that some list holds can matter. When these items are given as ``offered``,
    the others are left out before the shuffle by user and item.
    """
    rated = ratings.select("user_id", "gmap_id")
    if offered is not None:
        rated = rated.join(offered, "gmap_id", "left_semi")
    fresh = recs.join(rated, ["user_id", "gmap_id"], "left_anti")
    return top_n_per(fresh, ["user_id"], n, [F.desc("score"), F.asc("gmap_id")])


def serve_cluster_recommendations(
    users: DataFrame,
    centroids: DataFrame,
    lists: DataFrame,
    k: int,
    features: DataFrame | None = None,
    n: int = SERVED,
) -> DataFrame:
    """``(user_id, gmap_id, score, rank)`` for all users from their nested ratings and the model.

    ``users`` is read more than once, so it should be a stored table. A user without ratings gets nothing. ``features`` limits the vectors to the items of the model;
    what counts as already rated is not limited.
    """
    raters = users.where(F.size("ratings") > 0).select("user_id")
    if "chunk" in users.columns:
        raters = raters.distinct()
    entries = flat_ratings(users, only_rated=False)
    return serve_raters(user_vectors(users), raters, entries, centroids, lists, k, features, n)


def serve_raters(
    vectors: DataFrame,
    raters: DataFrame,
    entries: DataFrame,
    centroids: DataFrame,
    lists: DataFrame,
    k: int,
    features: DataFrame | None = None,
    n: int = SERVED,
) -> DataFrame:
    """The same from flat tables: one rating per (user, item), the users, and all they have rated."""
    if features is not None:
        vectors = vectors.join(features.select("gmap_id"), "gmap_id", "left_semi")
    assigned = assign_clusters(vectors, raters, centroids, k)
    offered = recs_for_cluster(assigned, lists).select("user_id", F.explode("recommendations").alias("r"))
    recs = offered.select("user_id", F.col("r.gmap_id"), F.col("r.score"))
    listed = lists.select(F.explode("recommendations.gmap_id").alias("gmap_id")).distinct()
    return unseen(recs, entries, n, listed)


def merge_recommendations(stored: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Stored recommendations with single users replaced by refreshed ones."""
    return stored.join(refreshed.select("user_id").distinct(), "user_id", "left_anti").unionByName(refreshed)


def drop_cold_users(recs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Recommendations without the users who have no rating left."""
    return recs.join(reviews.select("user_id").distinct(), "user_id", "left_semi")
