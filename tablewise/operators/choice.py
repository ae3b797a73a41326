"""The number of clusters: runs for all candidates advance together, and the knee of their errors is chosen.

Every round is one pass over the ratings for all runs that have not ended: centroid cells carry the
number of clusters ``k`` of their run, and sums go per (user, run, cluster). A run ends by its own rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.distances import MASKED_COSINE, SQUARED_EUCLIDEAN, Distance
from tablewise.operators import block_rounds
from tablewise.operators import clustering as c
from tablewise.operators.ratings import rated
from tablewise.operators.seeding import plus_plus_start
from tablewise.shared import cut, stored

CURVE = "k int, total_error double, rounds int"


def _grid(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Every row once per run."""
    return df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def assign_runs(
    ratings: DataFrame, users: DataFrame, cells: DataFrame, ks: Sequence[int], distance: Distance, n_cells: int, limit: int
) -> DataFrame:
    """``(k, user_id, cluster_id, distance)`` of the nearest centroid of every run, the lowest id on ties."""
    a, b = F.col("rating").cast("double"), F.col("value")
    own = ratings.where(rated())
    joined = own.join(c._limited_broadcast(cells.where(rated("value")), n_cells, limit), "gmap_id")
    sums = joined.groupBy("user_id", "k", "cluster_id").agg(
        F.sum(a * b).alias("dot"), F.sum(a * a).alias("a2"), F.sum(b * b).alias("b2")
    )
    everyone = _grid(users.select("user_id"), ks)
    if distance.full_norms:
        squares = own.groupBy("user_id").agg(F.sum(a * a).alias("full_a2"))
        # one row per run and cluster
        norms = cells.groupBy("k", "cluster_id").agg(F.sum(b * b).alias("full_b2"))
        sums = sums.join(squares, "user_id").join(F.broadcast(norms), ["k", "cluster_id"])
        everyone = everyone.join(squares, "user_id", "left")
    near = sums.select("user_id", "k", "cluster_id", c._value(distance).alias("distance"))
    best = F.min(F.struct("distance", "cluster_id")).alias("best")
    if distance.absent is None:
        ids = _grid(ratings.sparkSession.range(max(ks)).select(F.col("id").cast("int").alias("cluster_id")), ks)
        small = ids.where("cluster_id < k").join(norms, ["k", "cluster_id"], "left").fillna(0.0, ["full_b2"])
        least = small.groupBy("k").agg(F.min(F.struct("full_b2", "cluster_id")).alias("least"))
        zero = F.lit(0.0)
        apart = c.Sums(zero, zero, zero, F.coalesce("full_a2", zero), F.col("least.full_b2"))
        other = F.struct(F.round(distance.formula(apart, F.greatest), c.PLACES).alias("distance"), F.col("least.cluster_id"))
        found = everyone.join(near.groupBy("user_id", "k").agg(best), ["user_id", "k"], "left").join(F.broadcast(least), "k")
        return found.select("k", "user_id", F.least("best", other).alias("best")).select(
            "k", "user_id", "best.cluster_id", "best.distance"
        )
    found = near.groupBy("user_id", "k").agg(best, *c.cluster_bits(max(ks)))
    absent = F.lit(distance.absent)
    free = c._lowest_absent(max(ks))
    free = F.when(free < F.col("k"), free)
    d, i = F.col("best.distance"), F.col("best.cluster_id")
    taken = free.isNotNull() & ((d > absent) | ((d == absent) & (i > free)))
    chosen = found.select(
        "user_id", "k", F.when(taken, free).otherwise(i).alias("cluster_id"), F.when(taken, absent).otherwise(d).alias("distance")
    )
    return everyone.select("user_id", "k").join(chosen, ["user_id", "k"], "left").select(
        "k", "user_id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"), F.coalesce("distance", absent).alias("distance")
    )


def _moved(parts: Sequence[DataFrame], assigned: DataFrame) -> DataFrame:
    members = assigned.select("k", "user_id", "cluster_id")
    rows = c._union([r.join(members, "user_id").select("k", "cluster_id", "gmap_id", "rating") for r in parts])
    sums = rows.groupBy("k", "cluster_id", "gmap_id").agg(F.sum("rating").alias("total"))
    sizes = members.groupBy("k", "cluster_id").agg(F.count(F.lit(1)).alias("n_users"))
    # one row per run and cluster
    return sums.join(F.broadcast(sizes), ["k", "cluster_id"]).select(
        "k", "cluster_id", "gmap_id", (F.col("total") / F.col("n_users")).alias("value")
    )


def _figures(assigned: DataFrame, old: DataFrame, new: DataFrame) -> dict[int, tuple[float, int]]:
    """Per run: total error, and centroid cells that differ."""
    zero = F.lit(0.0)
    keys = ["k", "cluster_id", "gmap_id"]
    cells = old.select(*keys, F.col("value").alias("a"), zero.alias("b")).unionByName(
        new.select(*keys, zero.alias("a"), F.col("value").alias("b"))
    )
    sides = cells.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    differ = F.count_if(F.abs(F.col("a") - F.col("b")) > c.ATOL + c.RTOL * F.abs("b")).alias("n_moved")
    errors = assigned.groupBy("k").agg(F.sum("distance").alias("error"))
    rows = errors.unionByName(sides.groupBy("k").agg(differ), allowMissingColumns=True)
    return {r.k: (r.error or 0.0, r.n_moved or 0) for r in rows.groupBy("k").agg(F.max("error").alias("error"), F.max("n_moved").alias("n_moved")).collect()}


def _advance(parts, cells: DataFrame, distance: Distance, max_iter: int, tol: float, limit: int):
    """``(errors, rounds, last centroids)`` of all runs in ``cells``, each to its own end."""
    cells = cut(cells.select("k", "cluster_id", "gmap_id", "value"))
    open_ = sorted(r.k for r in cells.select("k").distinct().collect())
    errors: dict[int, list[float]] = {k: [] for k in open_}
    done: dict[int, tuple[float, int]] = {}
    last: list[DataFrame] = []

    def assigned() -> DataFrame:
        n_cells = cells.count()
        return cut(c._union([assign_runs(r, u, cells, open_, distance, n_cells, limit) for r, u in parts]))

    for _ in range(max_iter):
        if not open_:
            break
        nearest = assigned()
        moved = cut(_moved([r for r, _ in parts], nearest))
        figures = _figures(nearest, cells, moved)
        ended = []
        for k in open_:
            error, n_moved = figures.get(k, (0.0, 0))
            errors[k].append(error)
            before = errors[k][-2:-1]
            if before and abs(before[0] - error) < tol or n_moved == 0:
                done[k] = error, len(errors[k])
                ended.append(k)
        if ended:
            last.append(cells.where(F.col("k").isin(ended)))
        open_ = [k for k in open_ if k not in ended]
        cells = moved.where(F.col("k").isin(open_)) if ended else moved
    if open_:
        for r in assigned().groupBy("k").agg(F.sum("distance").alias("error")).collect():
            done[r.k] = r.error, len(errors[r.k])
        last.append(cells)
    return {k: done[k] for k in sorted(done)}, c._union(last) if last else cells


def elbow(
    ratings: DataFrame,
    users: DataFrame,
    ks: Sequence[int],
    distance: Distance = MASKED_COSINE,
    init: str = "euclidean",
    max_iter: int = c.ROUNDS,
    tol: float = c.TOLERANCE,
    seed: int = 42,
    hot_rows: int = c.HOT_ROWS,
    broadcast_cells: int = c.BROADCAST_CELLS,
) -> DataFrame:
    """Total error and rounds per number of clusters, with the ``knee`` of the curve.

    The starts are those of ``clustering.kmeans``; the first ``k`` of the random draw, or of one k-means++
    draw for the largest ``k``, start the run of ``k``.
    """
    spark, ks = ratings.sparkSession, sorted(set(ks))
    if init not in ("euclidean", "k-means++", "random"):
        raise ValueError(f"unknown start {init!r}")
    found = None
    if init == "random" and (laid := block_rounds.lay_out(ratings, users, hot_rows)) is not None:
        try:
            start = _grid(stored(c.random_start(ratings, users, ks[-1], seed), "start"), ks).where("cluster_id < k")
            if (cells := block_rounds.table_start(laid, start, ks)) is not None:
                found = block_rounds.rounds(laid, cells, ks, distance, max_iter, tol, c.RULES)
        finally:
            block_rounds.close(laid)
    if found is not None:
        # one row per candidate
        return knee(spark.createDataFrame([(k, found[k].error, len(found[k].errors)) for k in ks], CURVE))
    parts = c._layout(ratings, users, hot_rows)
    rows, people = c._union([r for r, _ in parts]), c._union([u for _, u in parts])
    if init == "random":
        start = c.random_start(rows, people, ks[-1], seed)
    else:
        start = plus_plus_start(rows, people, ks[-1], seed, c.nearest_of(parts, SQUARED_EUCLIDEAN, broadcast_cells))
    cells = _grid(stored(start, "start"), ks).where("cluster_id < k")
    if init == "euclidean":
        _, cells = _advance(parts, cells, SQUARED_EUCLIDEAN, c.ROUNDS, tol, broadcast_cells)
    found, _ = _advance(parts, cells, distance, max_iter, tol, broadcast_cells)
    return knee(spark.createDataFrame([(k, *v) for k, v in found.items()], CURVE))


def knee(curve: DataFrame, k: str = "k", error: str = "total_error") -> DataFrame:
    """``curve`` with ``distance``, how far each point lies under the chord from the first to the last
    one when both axes run from 0 to 1, and ``chosen``, true for the farthest, the smallest ``k`` on ties.

    A curve that is flat, or has fewer than three points, has its first point chosen. The windows run
    over one row per candidate.
    """
    whole = Window.partitionBy()

    def scaled(column: Column) -> Column:
        low, high = F.min(column).over(whole), F.max(column).over(whole)
        return F.when(high > low, (column - low) / (high - low)).otherwise(0.0)

    x, y = scaled(F.col(k)), scaled(F.col(error))
    ends = [F.first(y).over(whole.orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))]
    ends.append(F.last(y).over(whole.orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    under = F.round(ends[0] + (ends[1] - ends[0]) * x - y, 9)
    placed = curve.withColumn("distance", under)
    best = F.row_number().over(whole.orderBy(F.desc("distance"), F.asc(k)))
    return placed.withColumn("chosen", best == 1)
