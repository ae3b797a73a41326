"""Euclidean rounds that look only at users whose nearest centroid can have changed.

Each user keeps two bounds: how far its own centroid is at most, and how far any other is at least. A
centroid's move widens the first by the move of the own centroid and narrows the second by the largest
move of another (triangle inequality). While the first stays below the second the user keeps its cluster,
and its ratings are not joined with the centroids. All others get exact distances and new bounds. The
assignments are those of plain rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.distances import SQUARED_EUCLIDEAN
from tablewise.operators import clustering as c
from tablewise.operators.ratings import rated
from tablewise.shared import cut, stored

# bounds closer than this are taken as crossed, so that a float's error decides nothing
_MARGIN = 1e-6


class Bounded(NamedTuple):
    centroids: DataFrame
    assignments: DataFrame
    errors: list[float]
    skipped: list[float]  # share of users not looked at, per round


def two_nearest(ratings: DataFrame, users: DataFrame, centroids: DataFrame, k: int, n_cells: int, limit: int) -> DataFrame:
    """``(user_id, cluster_id, upper, lower)``: the nearest centroid, its distance and that of the next one."""
    a = F.col("rating").cast("double")
    sums = c.cell_sums(ratings, centroids, SQUARED_EUCLIDEAN, n_cells, limit)
    entry = F.struct(c._value(SQUARED_EUCLIDEAN).alias("d"), "cluster_id")
    near = sums.select("user_id", entry.alias("entry")).groupBy("user_id").agg(
        # at most k entries
        F.slice(F.sort_array(F.collect_list("entry")), 1, 2).alias("near")
    )
    own = ratings.where(rated()).groupBy("user_id").agg(F.sum(a * a).alias("full_a2"))
    ids = ratings.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    norms = ids.join(c._centroid_norms(centroids), "cluster_id", "left").fillna(0.0, ["full_b2"])
    # with nothing in common only the two shortest centroids can be among the nearest two
    short = norms.orderBy("full_b2", "cluster_id").limit(2).collect()
    joined = users.select("user_id").join(own, "user_id", "left").join(near, "user_id", "left")
    a2 = F.coalesce("full_a2", F.lit(0.0))
    apart = [F.struct(F.round(a2 + F.lit(float(r.full_b2)), c.PLACES).alias("d"), F.lit(r.cluster_id).alias("cluster_id")) for r in short]
    every = F.sort_array(F.concat(F.coalesce("near", F.array().cast("array<struct<d:double,cluster_id:int>>")), F.array(*apart)))
    found = joined.select("user_id", every.alias("every")).select("user_id", "every", F.get("every", F.lit(0)).alias("first"))
    other = F.get(F.filter("every", lambda e: e["cluster_id"] != F.col("first.cluster_id")), F.lit(0))
    root = lambda d: F.sqrt(F.greatest(d, F.lit(0.0)))
    return found.select(
        "user_id",
        F.col("first.cluster_id").alias("cluster_id"),
        root(F.col("first.d")).alias("upper"),
        F.when(other.isNull(), F.lit(float("inf"))).otherwise(root(other["d"])).alias("lower"),
    )


def _moves(old: DataFrame, new: DataFrame, k: int) -> list[float]:
    """How far each centroid has moved: k numbers."""
    zero = F.lit(0.0)
    keys = ["cluster_id", "gmap_id"]
    cells = old.select(*keys, (-F.col("value")).alias("v")).unionByName(new.select(*keys, F.col("value").alias("v")))
    sides = cells.groupBy(*keys).agg(F.sum("v").alias("v"))
    out = [0.0] * k
    for r in sides.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) + zero).alias("m")).collect():
        out[r.cluster_id] = r.m
    return out


def _widened(bounds: DataFrame, moves: list[float]) -> DataFrame:
    """Bounds after the centroids' moves, and whether they are ``crossed``."""
    order = sorted(range(len(moves)), key=lambda i: -moves[i])
    largest, second = moves[order[0]], moves[order[1]] if len(order) > 1 else 0.0
    own = F.element_at(F.array(*map(F.lit, moves)), F.col("cluster_id") + 1)
    others = F.when(F.col("cluster_id") == order[0], F.lit(second)).otherwise(F.lit(largest))
    moved = bounds.select("user_id", "cluster_id", (F.col("upper") + own).alias("upper"), (F.col("lower") - others).alias("lower"))
    return moved.withColumn("crossed", F.col("upper") + F.lit(_MARGIN) >= F.col("lower"))


def rounds(parts, k: int, start: DataFrame, max_iter: int, tol: float, limit: int = c.BROADCAST_CELLS) -> Bounded:
    """Rounds to their end, as ``clustering.kmeans`` ends them, over parts as it lays them out."""
    centroids = cut(start.select("cluster_id", "gmap_id", "value"))
    n_cells = centroids.count()
    a = F.col("rating").cast("double")
    # the error is a matter of sums: squares of the ratings, products of sums and means, squares of the means
    squares = sum(r.where(rated()).agg(F.sum(a * a)).first()[0] or 0.0 for r, _ in parts)
    n_users = sum(u.count() for _, u in parts)
    bounds, errors, skipped = None, [], []

    def assign(widened: DataFrame | None) -> tuple[DataFrame, float]:
        if widened is None:
            return cut(c._union([two_nearest(r, u, centroids, k, n_cells, limit) for r, u in parts])), 0.0
        open_ = stored(widened.where("crossed").select("user_id"), "open-users")
        n_open = open_.count()
        kept = widened.where("NOT crossed").drop("crossed")
        if not n_open:
            return cut(kept), 1.0
        again = [
            two_nearest(r.join(open_, "user_id", "left_semi"), u.join(open_, "user_id", "left_semi"), centroids, k, n_cells, limit)
            for r, u in parts
        ]
        return cut(c._union([kept, *again])), 1 - n_open / max(1, n_users)

    def error(members: DataFrame, moved: DataFrame) -> float:
        sizes = c.cluster_sizes(members)
        norms = centroids.groupBy("cluster_id").agg(F.sum(F.col("value") * F.col("value")).alias("b2"))
        own = sizes.join(norms, "cluster_id").agg(F.sum(F.col("n_users") * F.col("b2"))).first()[0] or 0.0
        both = moved.withColumnRenamed("value", "mean").join(centroids, ["cluster_id", "gmap_id"]).join(F.broadcast(sizes), "cluster_id")
        cross = both.agg(F.sum(F.col("mean") * F.col("n_users") * F.col("value"))).first()[0] or 0.0
        return squares + own - 2 * cross

    widened = None
    for _ in range(max_iter):
        bounds, share = assign(widened)
        moved = cut(c._union_scores([r for r, _ in parts], bounds))
        skipped.append(share)
        errors.append(error(bounds, moved))
        _, n_moved, n_new = c._round_figures(bounds.withColumn("distance", F.lit(0.0)), centroids, moved)
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol or n_moved == 0:
            break
        widened = _widened(bounds, _moves(centroids, moved, k))
        centroids, n_cells = moved, n_new
    else:
        bounds, share = assign(widened)
        skipped.append(share)
    return Bounded(centroids, _with_distances(parts, bounds, centroids), errors, skipped)


def _with_distances(parts, bounds: DataFrame, centroids: DataFrame) -> DataFrame:
    """Members with the squared distance from their own centroid alone."""
    a = F.col("rating").cast("double")
    members = bounds.select("user_id", "cluster_id")
    cells = centroids.select("cluster_id", "gmap_id", "value")
    rows = c._union([r.where(rated()).join(members, "user_id").select("user_id", "cluster_id", "gmap_id", a.alias("a")) for r, _ in parts])
    sums = rows.join(cells, ["cluster_id", "gmap_id"], "left").groupBy("user_id").agg(
        F.sum(F.col("a") * F.col("a")).alias("a2"), F.sum(F.col("a") * F.col("value")).alias("dot")
    )
    zero = F.lit(0.0)
    far = members.join(c._centroid_norms(centroids), "cluster_id", "left").join(sums, "user_id", "left")
    d = F.coalesce("a2", zero) + F.coalesce("full_b2", zero) - 2 * F.coalesce("dot", zero)
    return far.select("user_id", "cluster_id", F.round(d, c.PLACES).alias("distance"))


def kmeans(
    ratings: DataFrame,
    users: DataFrame,
    k: int = c.CLUSTERS,
    init: str | DataFrame = "k-means++",
    max_iter: int = c.ROUNDS,
    tol: float = c.TOLERANCE,
    seed: int = 42,
    hot_rows: int = c.HOT_ROWS,
    broadcast_cells: int = c.BROADCAST_CELLS,
) -> Bounded:
    """Euclidean k-means; the arguments are those of ``clustering.kmeans``."""
    parts = c._layout(ratings, users, hot_rows)
    start = c.start_of(parts, k, init, seed, broadcast_cells)
    return rounds(parts, k, start, max_iter, tol, broadcast_cells)
