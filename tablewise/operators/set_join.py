"""Similar users without all pairs: an exact join of item sets under a least overlap and similarity.

The similarity is that of full norms, cosine times the ratio of the norms, which is the product of
the vectors by the larger squared norm. Items are ordered by rarity. Let ``x`` be the rarest common
item of a pair. At least ``min_common - 1`` common items come behind it in either vector, and all of the
product comes from ``x`` on, so the part of each vector from ``x`` on has at least the share ``least`` of
its norm. So ``x`` lies in the first items of both vectors, which both conditions bound: pairs that share no
such item are never looked at. The others are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators import common_items
from tablewise.shared import stored

# a bound may be passed by a float's error only
_SLACK = 1 - 1e-9


def first_items(ratings: DataFrame, min_common: int, least: float) -> DataFrame:
    """``(user_id, gmap_id, n_items, square)`` of the items at which a pair can have its rarest common one."""
    raters = ratings.groupBy("gmap_id").agg(F.count(F.lit(1)).alias("raters"))
    mine = Window.partitionBy("user_id")
    rarest = mine.orderBy("raters", "gmap_id")
    r2 = F.col("rating") * F.col("rating")
    placed = ratings.join(raters, "gmap_id").select(
        "user_id",
        "gmap_id",
        F.row_number().over(rarest).alias("place"),
        F.count(F.lit(1)).over(mine).alias("n_items"),
        F.sum(r2).over(mine).alias("square"),
        F.sum(r2).over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("from_here"),
    )
    enough = F.col("place") <= F.col("n_items") - (min_common - 1)
    heavy = F.col("from_here") >= F.lit(least * least * _SLACK) * F.col("square")
    return placed.where(enough & heavy).select("user_id", "gmap_id", "n_items", "square")


def candidate_pairs(ratings: DataFrame, min_common: int, least: float) -> DataFrame:
    """``(few, many, square)``: pairs to compare, each once, the user with fewer items first, with the larger
    squared norm. The ratio of the norms is a bound of its own."""
    first = stored(first_items(ratings, min_common, least), "first-items")
    one, two = (first.select("gmap_id", *[F.col(c).alias(f"{c}_{s}") for c in ("user_id", "n_items", "square")]) for s in "ab")
    low, high = F.least("square_a", "square_b"), F.greatest("square_a", "square_b")
    near = low >= F.lit(least * least * _SLACK) * high
    # of a pair the user with fewer items, or the smaller id, is on the left
    order = (F.col("n_items_a") < F.col("n_items_b")) | (
        (F.col("n_items_a") == F.col("n_items_b")) & (F.col("user_id_a") < F.col("user_id_b"))
    )
    pairs = one.join(two, "gmap_id").where(order & near)
    return pairs.select(F.col("user_id_a").alias("few"), F.col("user_id_b").alias("many"), high.alias("square")).distinct()


def _lists_are_less(rows: DataFrame, min_common: int, least: float) -> bool:
    """Whether the pairs of ratings of one item are fewer than the rows that comparing the candidates takes."""
    by_item = first_items(rows, min_common, least).groupBy("gmap_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = by_item.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    mean = rows.agg(F.try_divide(F.count(F.lit(1)), F.count_distinct("user_id"))).first()[0] or 0.0
    return common_items.entries(rows) <= pairs * mean


def _listed_pairs(min_common: int):
    def finish(ids_a: pa.Array, ids_b: pa.Array, sums: np.ndarray, more: dict) -> pa.RecordBatch:
        columns = [ids_a, ids_b, pa.array(np.maximum(*more["square"])), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])]
        pairs = pa.RecordBatch.from_arrays(columns, names=["few", "many", "square", "n_common", "dot"])
        return pairs.filter(pc.and_(pc.not_equal(ids_a, ids_b), pa.array(sums[0] >= min_common)))

    return finish


def _sums_by_lists(rows: DataFrame, min_common: int) -> DataFrame:
    square = F.sum(F.col("rating") * F.col("rating")).alias("square")
    vectors = rows.join(rows.groupBy("user_id").agg(square), "user_id")
    schema = "few string, many string, square double, n_common bigint, dot double"
    return common_items.common_sums(vectors, _listed_pairs(min_common), schema, ["square"])


def _sums_of_candidates(rows: DataFrame, min_common: int, least: float) -> DataFrame:
    pairs = stored(candidate_pairs(rows, min_common, least), "candidate-pairs")
    few = rows.select(F.col("user_id").alias("few"), "gmap_id", F.col("rating").alias("x"))
    many = rows.select(F.col("user_id").alias("many"), "gmap_id", F.col("rating").alias("y"))
    # the shorter vector is spread out, and finds its partners in the longer one
    return pairs.join(few, "few").join(many, ["many", "gmap_id"]).groupBy("few", "many", "square").agg(
        F.count(F.lit(1)).alias("n_common"), F.sum(F.col("x") * F.col("y")).alias("dot")
    )


def similar_users(ratings: DataFrame, min_common: int = 1, least: float = 0.0) -> DataFrame:
    """``(user_a, user_b, n_common, similarity)`` of all pairs of different users with ``min_common`` rated
    items in common and a similarity of ``least``, each once with ``user_a < user_b``.

    ``ratings`` has one row per user and item; only positive ratings count.
    """
    if min_common < 1 or not 0 <= least <= 1:
        raise ValueError("min_common starts at 1, and least lies between 0 and 1")
    positive = ratings.where(F.col("rating") > 0)
    rows = stored(positive.select("user_id", "gmap_id", F.col("rating").cast("double").alias("rating")), "rated")
    less = _lists_are_less(rows, min_common, least)
    sums = _sums_by_lists(rows, min_common) if less else _sums_of_candidates(rows, min_common, least)
    similarity = F.round(F.col("dot") / F.col("square"), 9)
    found = sums.where(F.col("n_common") >= min_common).select(
        F.least("few", "many").alias("user_a"), F.greatest("few", "many").alias("user_b"), "n_common", similarity.alias("similarity")
    )
    return found.where(F.col("similarity") >= least)
