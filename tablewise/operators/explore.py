"""Exploratory aggregates over reviews and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ranking import top_n


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("rating").agg(F.count(F.lit(1)).alias("n_reviews")).orderBy("rating")


def macro_stats(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """One row of totals; users without reviews count as users."""
    review_row = reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"), F.avg("rating").alias("average_rating")
    )
    user_row = users.agg(F.count(F.lit(1)).alias("total_users"))
    totals = ("total_reviews", "total_users", "average_rating")
    one_row = review_row.unionByName(user_row, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in totals])
    return one_row.withColumn("reviews_per_user", F.try_divide("total_reviews", "total_users"))


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))


def most_active_user(reviews: DataFrame) -> DataFrame:
    return top_n(_counts(reviews, "user_id"), 1, F.desc("n_reviews"), "user_id")


def _top_key_ratings(reviews: DataFrame, key: str, n: int) -> DataFrame:
    """Rating histogram of the ``n`` keys with most reviews; a null key has none.

    The reviews are scanned and shuffled once, into the histogram of all keys. A key's ratings, of
    which there are few different ones, then go along as one array while the keys are ranked.
    """
    histogram = reviews.groupBy(key, "rating").agg(F.count(F.lit(1)).alias("rating_count"))
    per_key = histogram.groupBy(key).agg(
        F.sum("rating_count").alias("n_reviews"),
        F.collect_list(F.struct("rating", "rating_count")).alias("ratings"),
    )
    top = top_n(per_key, n, F.desc("n_reviews"), key).where(F.col(key).isNotNull())
    return top.select(key, F.explode("ratings").alias("r")).select(key, "r.rating", "r.rating_count")


def top_item_ratings(reviews: DataFrame, n: int = 10) -> DataFrame:
    return _top_key_ratings(reviews, "gmap_id", n)


def top_reviewer_ratings(reviews: DataFrame, n: int = 10) -> DataFrame:
    return _top_key_ratings(reviews, "user_id", n)


def top_categories(meta: DataFrame, n: int = 50) -> DataFrame:
    """Most frequent categories; an item counts once per entry of its list."""
    entries = meta.select(F.explode("category").alias("category"))
    counts = entries.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))
    return top_n(counts, n, F.desc("n_items"), "category")
