"""All-pairs user similarity and the silhouette of a clustering.

Where few users share an item, pairs are found by way of the items' lists of raters. Otherwise users are dealt into blocks. A task gets the vectors of two blocks and sums over common items for all
their pairs with NumPy, so no pair is shuffled before its sums are whole, and no task holds more than
two blocks. An item that everybody rated is spread over all block pairs like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.distances import FULL_NORM_COSINE, MASKED_COSINE, Distance, Sums
from tablewise.operators import common_items
from tablewise.shared import stored

BLOCK_USERS = 1_000
BLOCK_ROWS = 500_000
# pairs that are expanded at once inside a task
_AT_ONCE = 2_000_000
# entries of lists that are shuffled for the price of a row's copy
_ENTRIES_PER_COPY = 4


def _pairs_of_common_items(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs with the same item code (0..n-1), a bounded number at a time."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    count_a, count_b = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
    start_b = np.cumsum(count_b) - count_b
    fan_out = count_b[a[order_a]]
    edges = np.searchsorted(np.cumsum(fan_out), np.arange(_AT_ONCE, fan_out.sum() + _AT_ONCE, _AT_ONCE)) + 1
    first = 0
    for last in edges:
        rows, fan = order_a[first:last], fan_out[first:last]
        first = last
        left = np.repeat(rows, fan)
        place = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
        yield left, order_b[np.repeat(start_b[a[rows]], fan) + place]


def _sums(left: pd.DataFrame, right: pd.DataFrame):
    """User ids of both sides and, for all their pairs, n, dot, a2 and b2 over common items."""
    ids_a, user_a = np.unique(left["user_id"].to_numpy(str), return_inverse=True)
    ids_b, user_b = np.unique(right["user_id"].to_numpy(str), return_inverse=True)
    items = pd.factorize(pd.concat([left["gmap_id"], right["gmap_id"]]))[0]
    item_a, item_b = items[: len(left)], items[len(left) :]
    value_a, value_b = left["rating"].to_numpy(float), right["rating"].to_numpy(float)
    size = len(ids_a) * len(ids_b)
    sums = np.zeros((4, size))
    for i, j in _pairs_of_common_items(item_a, item_b, int(items.max(initial=-1)) + 1):
        pair = user_a[i] * len(ids_b) + user_b[j]
        x, y = value_a[i], value_b[j]
        for row, weights in enumerate((None, x * y, x * x, y * y)):
            sums[row] += np.bincount(pair, weights, minlength=size)
    return ids_a, ids_b, sums.reshape(4, len(ids_a), len(ids_b))


def _first_of(frame: pd.DataFrame, ids: np.ndarray, column: str) -> np.ndarray:
    return frame.drop_duplicates("user_id").set_index("user_id")[column].reindex(ids).to_numpy()


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
    return group[group["block"] == low], group[group["block"] == high]


def _once(group: pd.DataFrame, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Pairs to use: all of two blocks, the upper triangle with its diagonal within one."""
    same = group["low"].iloc[0] == group["high"].iloc[0]
    every = np.ones((len(ids_a), len(ids_b)), dtype=bool)
    return np.triu(every) if same else every


def _block_figures(vectors: DataFrame, block_users: int, block_rows: int) -> tuple[int, int, int]:
    """Number of blocks, rows, and rows of the longest vector."""
    per_user = vectors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    row = per_user.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    users, rows, longest = (x or 0 for x in row)
    return max(1, -(-users // block_users), -(-rows // block_rows)), rows, longest


def _few_in_common(vectors: DataFrame, block_users: int, block_rows: int, sides: int = 1) -> bool:
    """Whether the items' lists of raters give fewer entries than blocks give copies of the rows."""
    n, rows, _ = _block_figures(vectors, block_users, block_rows)
    return n > 1 and sides * common_items.entries(vectors) <= _ENTRIES_PER_COPY * n * rows


def _blocks(vectors: DataFrame, block_users: int, block_rows: int) -> tuple[DataFrame, int]:
    """Vectors once per pair of blocks they take part in, and the number of item slabs.

    There is one slab unless a single user has more rows than a block may hold.
    """
    n, _, longest = _block_figures(vectors, block_users, block_rows)
    slabs = max(1, -(-longest // block_rows))
    block = F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int")
    slab = F.pmod(F.xxhash64("gmap_id"), F.lit(slabs)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    placed = vectors.withColumns({"block": block, "slab": slab}).select("*", other)
    return placed.select(
        *vectors.columns,
        "block",
        "slab",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    ), slabs


_PAIR_SUMS = "user_a string, user_b string, n double, dot double, a2 double, b2 double"


def _pair_sums(group: pd.DataFrame) -> pd.DataFrame:
    left, right = _sides(group)
    if left.empty or right.empty:
        return pd.DataFrame(columns=["user_a", "user_b", "n", "dot", "a2", "b2"])
    ids_a, ids_b, sums = _sums(left, right)
    i, j = np.nonzero((sums[0] > 0) & _once(group, ids_a, ids_b))
    n, dot, a2, b2 = sums[:, i, j]
    swap = ids_a[i] > ids_b[j]
    return pd.DataFrame(
        {
            "user_a": np.where(swap, ids_b[j], ids_a[i]),
            "user_b": np.where(swap, ids_a[i], ids_b[j]),
            "n": n,
            "dot": dot,
            "a2": np.where(swap, b2, a2),
            "b2": np.where(swap, a2, b2),
        }
    )


def _listed_sums(ids_a: pa.Array, ids_b: pa.Array, sums: np.ndarray, _) -> pa.RecordBatch:
    columns = [ids_a, ids_b, *map(pa.array, sums)]
    return pa.RecordBatch.from_arrays(columns, names=["user_a", "user_b", "n", "dot", "a2", "b2"])


def pair_sums(
    vectors: DataFrame, block_users: int = BLOCK_USERS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sums over common items of all user pairs that have one, each once with ``user_a <= user_b``."""
    vectors = vectors.select("user_id", "gmap_id", "rating")
    if _few_in_common(vectors, block_users, block_rows):
        return common_items.common_sums(vectors, _listed_sums, _PAIR_SUMS)
    placed, slabs = _blocks(vectors, block_users, block_rows)
    sums = placed.groupBy("low", "high", "slab").applyInPandas(_pair_sums, _PAIR_SUMS)
    if slabs == 1:
        return sums
    return sums.groupBy("user_a", "user_b").agg(*[F.sum(c).alias(c) for c in ("n", "dot", "a2", "b2")])


def user_similarity(
    ratings: DataFrame,
    distance: Distance = FULL_NORM_COSINE,
    block_users: int = BLOCK_USERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(user_a, user_b, similarity)`` of all pairs with a common item, the diagonal included.

    Each pair is there once, ``user_a <= user_b``; a pair that is not there has similarity 0.
    """
    if distance.absent is None:
        raise ValueError("the distance needs a fixed value for pairs without a common item")
    positive = ratings.where(F.col("rating") > 0)
    if distance.full_norms:
        square = F.sum(F.col("rating") * F.col("rating"))
        norms = ratings.groupBy("user_id").agg(square.cast("double").alias("norm"))
        norms = stored(norms, "norms")
        if _few_in_common(positive, block_users, block_rows):
            return common_items.common_sums(
                positive.join(norms, "user_id"), _listed_similarity(distance), "user_a string, user_b string, similarity double", ["norm"]
            )
    sums = pair_sums(positive, block_users, block_rows)
    full = (None, None)
    if distance.full_norms:
        sums = sums.join(norms.toDF("user_a", "full_a2"), "user_a").join(norms.toDF("user_b", "full_b2"), "user_b")
        full = (F.col("full_a2"), F.col("full_b2"))
    value = distance.formula(Sums(F.col("dot"), F.col("a2"), F.col("b2"), *full), F.greatest)
    return sums.select("user_a", "user_b", (1 - value).alias("similarity"))


def _listed_similarity(distance: Distance):
    def finish(ids_a: pa.Array, ids_b: pa.Array, sums: np.ndarray, more: dict) -> pa.RecordBatch:
        value = distance.formula(Sums(*sums[1:], *more["norm"]), np.maximum)
        return pa.RecordBatch.from_arrays([ids_a, ids_b, pa.array(1 - value)], names=["user_a", "user_b", "similarity"])

    return finish


def _listed_distances(distance: Distance):
    """As ``_cluster_distances``, for pairs that come either way round."""

    def finish(ids_a: pa.Array, ids_b: pa.Array, sums: np.ndarray, more: dict) -> pa.RecordBatch:
        value = distance.formula(Sums(*sums[1:], *more.get("norm", (None, None))), np.maximum) - distance.absent
        pairs = {"user_id": ids_a, "other_cluster": more["cluster_id"][1], "excess": value}
        apart = pa.table(pairs).filter(pc.not_equal(ids_a, ids_b))
        total = apart.group_by(["user_id", "other_cluster"]).aggregate([("excess", "sum")])
        columns = [total.column(c).combine_chunks() for c in ("user_id", "other_cluster", "excess_sum")]
        return pa.RecordBatch.from_arrays(columns, names=["user_id", "other_cluster", "excess"])

    return finish


def _cluster_distances(distance: Distance):
    """Per user and cluster: sum of the distances to members it shares an item with, less the same
    number of times the distance of a pair that shares none."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(group)
        if left.empty or right.empty:
            return pd.DataFrame(columns=["user_id", "other_cluster", "excess"])
        ids_a, ids_b, (n, dot, a2, b2) = _sums(left, right)
        full = (None, None)
        if distance.full_norms:
            full = _first_of(left, ids_a, "norm")[:, None], _first_of(right, ids_b, "norm")[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = distance.formula(Sums(dot, a2, b2, *full), np.maximum)
        value = np.where(n > 0, value - distance.absent, 0.0)
        same = group["low"].iloc[0] == group["high"].iloc[0]
        if same:
            np.fill_diagonal(value, 0.0)
            return summed(ids_a, _first_of(right, ids_b, "cluster_id"), value)
        return pd.concat(
            [
                summed(ids_a, _first_of(right, ids_b, "cluster_id"), value),
                summed(ids_b, _first_of(left, ids_a, "cluster_id"), value.T),
            ]
        )

    def summed(ids: np.ndarray, clusters: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        names, code = np.unique(clusters, return_inverse=True)
        totals = np.zeros((len(names), len(ids)))
        np.add.at(totals, code, value.T)
        return pd.DataFrame(
            {
                "user_id": np.tile(ids, len(names)),
                "other_cluster": np.repeat(names, len(ids)),
                "excess": totals.ravel(),
            }
        )

    return reduce


def silhouette(
    ratings: DataFrame,
    assignments: DataFrame,
    distance: Distance = MASKED_COSINE,
    block_users: int = BLOCK_USERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(user_id, cluster_id, silhouette)`` of every user: (b - a) / max(a, b), where a is the mean
    distance to the others of its cluster and b the smallest mean distance to another cluster.

    A user alone in its cluster has 0. All pairs count, none is sampled.
    """
    if distance.absent is None:
        raise ValueError("the distance needs a fixed value for pairs without a common item")
    members = assignments.select("user_id", "cluster_id")
    vectors = ratings.where(F.col("rating") != 0).join(members, "user_id")
    vectors = vectors.select("user_id", "gmap_id", "rating", "cluster_id")
    if distance.full_norms:
        square = F.sum(F.col("rating") * F.col("rating")).cast("double").alias("norm")
        vectors = vectors.join(vectors.groupBy("user_id").agg(square), "user_id")
    shape = "user_id string, other_cluster int, excess double"
    if _few_in_common(vectors, block_users, block_rows, sides=2):
        extras = ["cluster_id", "norm"] if distance.full_norms else ["cluster_id"]
        rows = vectors.withColumn("cluster_id", F.col("cluster_id").cast("int"))
        part = common_items.common_sums(rows, _listed_distances(distance), shape, extras, both=True)
    else:
        part = _excess_of_blocks(vectors, members, distance, block_users, block_rows, shape)
    excess = part.groupBy("user_id", "other_cluster").agg(F.sum("excess").alias("excess"))

    # one row per cluster, so bounded by their number
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).collect()
    clusters = F.array(*[F.struct(F.lit(r.cluster_id).alias("cluster_id"), F.lit(r["size"]).cast("bigint").alias("size")) for r in sizes])
    grid = (
        members.select("user_id", "cluster_id", F.explode(clusters).alias("c"))
        .select("user_id", "cluster_id", F.col("c.cluster_id").alias("other_cluster"), F.col("c.size"))
        .join(excess, ["user_id", "other_cluster"], "left")
    )
    own = F.col("cluster_id") == F.col("other_cluster")
    others = F.when(own, F.col("size") - 1).otherwise(F.col("size"))
    mean = F.try_divide(others * F.lit(distance.absent) + F.coalesce("excess", F.lit(0.0)), others)
    per_user = grid.groupBy("user_id", "cluster_id").agg(
        F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b")
    )
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per_user.select(
        "user_id",
        "cluster_id",
        F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(value).alias("silhouette"),
    )


def _excess_of_blocks(vectors, members, distance, block_users, block_rows, shape: str) -> DataFrame:
    placed, slabs = _blocks(vectors, block_users, block_rows)
    if slabs == 1:
        return placed.groupBy("low", "high").applyInPandas(_cluster_distances(distance), shape)
    return _excess_of_pairs(vectors, members, distance, block_users, block_rows)


def _excess_of_pairs(vectors, members, distance, block_users, block_rows) -> DataFrame:
    """The same sums by way of pairs, for vectors too long for one task."""
    sums = pair_sums(vectors, block_users, block_rows).where(F.col("user_a") != F.col("user_b"))
    full = (None, None)
    if distance.full_norms:
        norms = vectors.select("user_id", "norm").distinct()
        sums = sums.join(norms.toDF("user_a", "full_a2"), "user_a").join(norms.toDF("user_b", "full_b2"), "user_b")
        full = (F.col("full_a2"), F.col("full_b2"))
    value = distance.formula(Sums(F.col("dot"), F.col("a2"), F.col("b2"), *full), F.greatest)
    pairs = stored(sums.select("user_a", "user_b", (value - distance.absent).alias("excess")), "pairs")
    both = pairs.toDF("user_id", "other", "excess").unionByName(pairs.toDF("other", "user_id", "excess"))
    return both.join(members.toDF("other", "other_cluster"), "other").select("user_id", "other_cluster", "excess")
