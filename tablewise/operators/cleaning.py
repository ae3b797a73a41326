"""Cleaning of raw places and reviews."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import scalars

_METADATA = ["name", "address", "gmap_id", "url"]


class Dropped(NamedTuple):
    kept: DataFrame
    dropped: DataFrame


def ids_with_category(meta: DataFrame, category: str) -> DataFrame:
    """Distinct ids of items whose category list has exactly this entry."""
    hit = F.array_contains("category", category) & F.col("gmap_id").isNotNull()
    return meta.where(hit).select("gmap_id").distinct()


def clean_reviews(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """The four review fields of the listed items."""
    return raw.select("user_id", "time", "rating", "gmap_id").join(ids, "gmap_id", "left_semi")


def clean_metadata(raw: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: the four fields of the listed items; a row that lacks one is a reject.

    A row without an id can match no list and is a reject too.
    """
    fields = raw.select(*_METADATA)
    complete = F.lit(True)
    for name in _METADATA:
        complete = complete & F.col(name).isNotNull()
    rows = fields.where(complete).join(ids, "gmap_id", "left_semi").select(*_METADATA)
    without_id = fields.where(F.col("gmap_id").isNull())
    incomplete = fields.where(F.col("gmap_id").isNotNull() & ~complete).join(ids, "gmap_id", "left_semi")
    return rows, incomplete.select(*_METADATA).unionByName(without_id)


def drop_ids(df: DataFrame, ids: DataFrame) -> Dropped:
    """Rows outside a deny list, and one row with the number of rows in it."""
    listed = df.select("gmap_id").join(ids, "gmap_id", "left_semi")
    return Dropped(
        df.join(ids, "gmap_id", "left_anti"), listed.agg(F.count(F.lit(1)).alias("n_dropped"))
    )


def by_ids(df: DataFrame, ids: DataFrame | Sequence[str], key: str = "gmap_id") -> DataFrame:
    """Rows whose key is in a list: a table of keys, or a short literal list."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def validate_ratings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: the rating text as int, or the row with the reason."""
    problem = scalars.rating_problem("gmap_id", "rating")
    valid = df.where(problem.isNull()).withColumn("rating", scalars.rating_value("rating"))
    return valid, df.withColumn("reason", problem).where(F.col("reason").isNotNull())


def missing_images(items: DataFrame) -> DataFrame:
    return items.where(F.col("img_url").isNull())


def fill_images(
    items: DataFrame,
    pages: DataFrame,
    default: str = scalars.NO_PAGE_IMAGE,
    substrings: Sequence[str] = scalars.IMAGE_URL_PARTS,
    pattern: str = scalars.IMG_SRC,
) -> DataFrame:
    """Items with an image url: their own, else the first fitting one of their fetched pages, else the
    default. Of several pages of an item the smallest url counts. A page is cut to its url where it is
    read, so no page text is shuffled."""
    missing = missing_images(items)
    found = pages.select("gmap_id", scalars.first_matching_url("html", substrings, None, pattern).alias("_found"))
    found = found.where(F.col("_found").isNotNull()).groupBy("gmap_id").agg(F.min("_found").alias("_found"))
    filled = missing.join(found, "gmap_id", "left")
    filled = filled.withColumn("img_url", scalars.filled("_found", default)).drop("_found")
    return items.where(F.col("img_url").isNotNull()).unionByName(filled)
