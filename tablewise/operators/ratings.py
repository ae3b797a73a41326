"""Ratings in long form: one row per user and item, never a pivoted matrix."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ranking import first_by_count, global_rank
from tablewise.shared import stored

# Fixed values; the first two are limits to ask for, none is set by itself
TOP_REVIEWERS = 150_000
KEPT_USERS = 100_000
MIN_RATERS = 30
MIN_REVIEWS = 100


class ClusterInput(NamedTuple):
    ratings: DataFrame
    users: DataFrame
    features: DataFrame


def rated(column: str = "rating") -> Column:
    """A zero and an absent rating both mean "not rated"."""
    return F.col(column) != 0


def mean_ratings(reviews: DataFrame) -> DataFrame:
    """One mean rating per (user, item); rows without a key are dropped."""
    return (
        reviews.dropna(subset=["user_id", "gmap_id"])
        .groupBy("user_id", "gmap_id")
        .agg(F.avg("rating").alias("rating"))
    )


def user_activity(ratings: DataFrame) -> DataFrame:
    """Number of (user, item) pairs per user, pairs with a null mean included."""
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_reviews"))


def rated_items(ratings: DataFrame) -> DataFrame:
    """Number of items with a non-zero rating per user; users without one count 0."""
    return ratings.groupBy("user_id").agg(F.count_if(rated()).alias("n_items"))


def activity_order() -> tuple[Column, Column]:
    return F.desc("n_items"), F.asc("user_id")


def feature_items(ratings: DataFrame, min_raters: int = MIN_RATERS) -> DataFrame:
    """Items with enough raters, with their number."""
    return (
        ratings.groupBy("gmap_id")
        .agg(F.count_if(rated()).alias("n_raters"))
        .where(F.col("n_raters") >= min_raters)
    )


def cluster_input(
    reviews: DataFrame,
    top_reviewers: int | None = None,
    kept_users: int | None = None,
    min_raters: int = MIN_RATERS,
) -> ClusterInput:
    """Ratings, users and features for clustering: all users, and the items with enough raters.

    With limits, the most active reviewers are kept, and of these the ones with most rated items. A
    kept user stays even when none of its items does.
    """
    pairs = stored(mean_ratings(reviews), "pairs")
    first = pairs
    if top_reviewers is not None:
        active = stored(user_activity(pairs), "activity")
        active = first_by_count(active, top_reviewers, "n_reviews", "user_id")
        first = pairs.join(active, "user_id", "left_semi")
    users = stored(rated_items(first), "users")
    if kept_users is not None:
        users = stored(first_by_count(users, kept_users, "n_items", "user_id"), "users")
    kept = pairs.join(users, "user_id", "left_semi").where(rated())
    features = stored(feature_items(kept, min_raters), "features")
    if features.isEmpty():
        raise ValueError("no item has enough raters; lower min_raters")
    return ClusterInput(kept.join(features, "gmap_id", "left_semi"), users, features)


def activity_split(users: DataFrame, fraction: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The most active ``fraction`` of the users, and the others; sizes are exact."""
    ranked = global_rank(users, *activity_order())
    bound = int(ranked.count() * fraction)
    return ranked.where(F.col("rank") <= bound), ranked.where(F.col("rank") > bound)


def random_split(df: DataFrame, share: float, seed: int, keys: Sequence[str] = ("user_id", "gmap_id")):
    """Seeded split by key hash: the same rows on each side at any partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 10_000
    first = draw < int(round(share * 10_000))
    return df.where(first), df.where(~first)


def item_stats(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with number of reviews and mean rating to 1 place; 0 and 0 without reviews."""
    stats = reviews.groupBy("gmap_id").agg(
        F.count(F.lit(1)).alias("Reviews"), F.bround(F.avg("rating"), 1).alias("Rating")
    )
    return (
        items.drop("Reviews", "Rating")
        .join(stats, "gmap_id", "left")
        .withColumns(
            {
                "Reviews": F.coalesce("Reviews", F.lit(0).cast("bigint")),
                "Rating": F.coalesce("Rating", F.lit(0.0)),
            }
        )
    )


def items_below(reviews: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Items with fewer reviews than the minimum support."""
    counts = reviews.groupBy("gmap_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return counts.where(F.col("n_reviews") < min_reviews)


def nest_users(reviews: DataFrame, chunk_rows: int = 10_000, users: DataFrame | None = None) -> DataFrame:
    """``(user_id, chunk, ratings)`` with the ratings in time order.

    With ``users``, those of them who have no review get a row with an empty array.

    Nearly every user is one row, chunk 0. A user with more than ``chunk_rows`` reviews goes on in
    chunks 1, 2, ..., so that no array grows with the data.
    """
    # in this field order entries sort by time
    entry = F.struct("time", "gmap_id", "rating")
    counts = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.where(F.col("n") > chunk_rows).select("user_id"), "hot-users")

    def nested(rows: DataFrame) -> DataFrame:
        arrays = rows.groupBy("user_id", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        ratings = F.transform(
            "entries",
            lambda e: F.struct(
                e["rating"].alias("rating"), e["time"].alias("timestamp"), e["gmap_id"].alias("gmap_id")
            ),
        )
        return arrays.select("user_id", "chunk", ratings.alias("ratings"))

    zero = F.lit(0).cast("bigint")
    silent = []
    if users is not None:
        none = F.from_json(F.lit("[]"), "array<struct<rating:int,timestamp:bigint,gmap_id:string>>")
        silent = [users.select("user_id").distinct().join(counts, "user_id", "left_anti").select("user_id", zero.alias("chunk"), none.alias("ratings"))]
    if hot.isEmpty():
        return functools.reduce(DataFrame.unionByName, silent, nested(reviews.withColumn("chunk", zero)))
    plain = reviews.join(hot, "user_id", "left_anti").withColumn("chunk", zero)
    placed = global_rank(
        reviews.join(hot, "user_id", "left_semi"), "user_id", "time", "gmap_id", "rating", rank="_at"
    )
    starts = placed.groupBy("user_id").agg(F.min("_at").alias("_first"))
    chunk = F.floor((F.col("_at") - F.col("_first")) / F.lit(chunk_rows)).cast("bigint")
    split = placed.join(starts, "user_id").withColumn("chunk", chunk)
    whole = nested(plain).unionByName(nested(split.drop("_at", "_first")))
    return functools.reduce(DataFrame.unionByName, silent, whole)


def flat_ratings(users: DataFrame, only_rated: bool = True) -> DataFrame:
    """The nested ratings as rows with their position; entries without a rating may be ignored."""
    chunk = F.col("chunk") if "chunk" in users.columns else F.lit(0).cast("bigint")
    entries = F.filter("ratings", lambda r: r["rating"].isNotNull()) if only_rated else F.col("ratings")
    return users.select("user_id", chunk.alias("chunk"), F.posexplode(entries).alias("pos", "r")).select(
        "user_id", "chunk", "pos", F.col("r.gmap_id"), F.col("r.rating"), F.col("r.timestamp").alias("time")
    )


def user_vectors(users: DataFrame) -> DataFrame:
    """One rating per (user, item) from the nested ratings; the last entry wins."""
    return (
        flat_ratings(users)
        .groupBy("user_id", "gmap_id")
        .agg(F.max_by("rating", F.struct("chunk", "pos")).cast("double").alias("rating"))
    )


def pivot_ratings(ratings: DataFrame, items: Sequence[str]) -> DataFrame:
    """User x item matrix for a short, given item list; 0 where there is no rating.

    Of the ratings of other items only the users are read.
    """
    items = list(items)
    users = ratings.select("user_id").distinct()
    if not items:
        return users
    cells = [F.when(F.col("gmap_id") == i, F.col("rating")).alias(i) for i in items]
    listed = ratings.where(F.col("gmap_id").isin(items)).select("user_id", *cells)
    rows = listed.unionByName(users, allowMissingColumns=True)
    firsts = [F.first(F.col(f"`{i}`"), ignorenulls=True).alias(i) for i in items]
    return rows.groupBy("user_id").agg(*firsts).fillna(0, items)
