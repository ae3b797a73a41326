"""The offline cleaning chain: raw places and reviews in, clean tables out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tablewise import schemas
from tablewise.operators import cleaning, ratings
from tablewise.shared import new_path, stored
from tablewise.sources import scans


class Cleaned(NamedTuple):
    items: DataFrame
    reviews: DataFrame
    rejected_lines: DataFrame
    rejected_items: DataFrame


def clean(
    spark: SparkSession,
    metadata_path: str,
    reviews_path: str,
    category: str = "Restaurant",
    min_reviews: int = ratings.MIN_REVIEWS,
) -> Cleaned:
    """Items of one category with enough reviews, and their reviews. Each text file is decoded once."""
    meta, bad_meta = scans.read_ndjson(
        spark, metadata_path, schemas.RAW_METADATA, staged=new_path(spark, "metadata")
    )
    raw, bad_reviews = scans.read_ndjson(
        spark, reviews_path, schemas.RAW_REVIEWS, staged=new_path(spark, "reviews")
    )
    ids = stored(cleaning.ids_with_category(meta, category), "ids")
    items, incomplete = cleaning.clean_metadata(meta, ids)
    reviews = stored(cleaning.clean_reviews(raw, ids), "clean-reviews")
    below = stored(ratings.items_below(reviews, min_reviews), "below")
    return Cleaned(
        cleaning.drop_ids(items, below).kept,
        cleaning.drop_ids(reviews, below).kept,
        bad_meta.unionByName(bad_reviews),
        incomplete,
    )
