"""The whole user x item matrix as sparse rows over an item dictionary, in slices of columns.

A pivot has a column per item; here a row of the matrix is the places and values of its ratings, so the
number of items does not matter, and a slice bounds what one row holds, however much a user has rated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ranking import global_rank
from tablewise.operators.ratings import rated
from tablewise.shared import stored

WIDTH = 1 << 16


class Matrix(NamedTuple):
    """``items``: ``gmap_id, place`` from 0 in id order. ``rows``: ``user_id, slice, size, places, values``,
    the places counted from the slice's first column, in order."""

    items: DataFrame
    rows: DataFrame
    width: int


def matrix(ratings: DataFrame, width: int = WIDTH) -> Matrix:
    """All rated (user, item) pairs of ``ratings``, which has one row for each; zeros have no place."""
    cells = ratings.where(rated()).select("user_id", "gmap_id", F.col("rating").cast("double").alias("rating"))
    ranked = global_rank(cells.select("gmap_id").distinct(), "gmap_id", rank="place")
    items = stored(ranked.select("gmap_id", (F.col("place") - 1).alias("place")), "items")
    n = items.count()
    placed = cells.join(items, "gmap_id").select(
        "user_id",
        F.floor(F.col("place") / width).cast("int").alias("slice"),
        F.struct((F.col("place") % width).cast("int").alias("place"), F.col("rating").alias("value")).alias("cell"),
    )
    rows = placed.groupBy("user_id", "slice").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    rows = rows.select(
        "user_id",
        "slice",
        F.least(F.lit(width), F.lit(n) - F.col("slice").cast("bigint") * width).cast("int").alias("size"),
        F.col("cells.place").alias("places"),
        F.col("cells.value").alias("values"),
    )
    return Matrix(items, rows, width)


def cells(m: Matrix) -> DataFrame:
    """The matrix in long form again: ``user_id, gmap_id, place, rating``."""
    flat = m.rows.select("user_id", "slice", F.explode(F.arrays_zip("places", "values")).alias("c")).select(
        "user_id", (F.col("slice").cast("bigint") * m.width + F.col("c.places")).alias("place"), F.col("c.values").alias("rating")
    )
    return flat.join(m.items, "place").select("user_id", "gmap_id", "place", "rating")
