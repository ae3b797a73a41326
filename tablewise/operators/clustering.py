"""Clustering of users under any distance that is a function of sums over common items.

Vectors and centroids stay in long form. A round joins each rating with the centroid cells of its
item, sums per (user, cluster) and takes the smallest distance per user.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.functions.distances import MASKED_COSINE, SQUARED_EUCLIDEAN, Distance, Sums
from tablewise.operators import block_rounds
from tablewise.operators.ranking import top_n, top_n_per
from tablewise.operators.ratings import rated
from tablewise.operators.seeding import Assign, plus_plus_start
from tablewise.shared import cut, shuffle_partitions, stored, stored_by

# Fixed values
CLUSTERS = 50
ROUNDS = 100
TOLERANCE = 1e-4
RTOL, ATOL = 1e-5, 1e-8
LISTED_ITEMS = 40

# distances are compared to this many places, so that the order of a float sum cannot decide
PLACES = 9
# centroid cells that are sent to every executor; with more, ratings and cells are shuffled by item
BROADCAST_CELLS = 1_500_000
# a user with more ratings than this is not kept in one task
HOT_ROWS = 1_000_000
# ratings per bucket, so that a bucket stays one task's work
BUCKET_ROWS = 5_000_000
# bits per word of the cluster bit sets
_WORD = 62


class KMeansResult(NamedTuple):
    centroids: DataFrame
    assignments: DataFrame
    errors: list[float]


def _limited_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast up to a known number of rows; beyond it a merge join, whose hot keys Spark can split."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def cell_sums(
    ratings: DataFrame, centroids: DataFrame, distance: Distance, n_cells: int, limit: int = BROADCAST_CELLS
) -> DataFrame:
    """Sums over common items per (user, cluster); pairs without a common item have no row."""
    a = F.col("rating").cast("double")
    b = F.col("value")
    cells = _limited_broadcast(centroids.where(rated("value")), n_cells, limit)
    sums = (
        ratings.where(rated())
        .join(cells, "gmap_id")
        .groupBy("user_id", "cluster_id")
        .agg(F.sum(a * b).alias("dot"), F.sum(a * a).alias("a2"), F.sum(b * b).alias("b2"))
    )
    if not distance.full_norms:
        return sums
    own = ratings.where(rated()).groupBy("user_id").agg(F.sum(a * a).alias("full_a2"))
    return sums.join(own, "user_id").join(_centroid_norms(centroids), "cluster_id")


def _centroid_norms(centroids: DataFrame) -> DataFrame:
    """One row per cluster, so bounded by their number."""
    norms = centroids.groupBy("cluster_id").agg(F.sum(F.col("value") * F.col("value")).alias("full_b2"))
    return F.broadcast(norms)


def _value(distance: Distance) -> Column:
    full = (F.col("full_a2"), F.col("full_b2")) if distance.full_norms else (None, None)
    raw = distance.formula(Sums(F.col("dot"), F.col("a2"), F.col("b2"), *full), F.greatest)
    return F.round(raw, PLACES)


def cluster_bits(k: int) -> list[Column]:
    """The clusters of a group as bit sets ``w0, w1, ...``."""
    return [
        F.bit_or(
            F.when(
                (F.col("cluster_id") >= w * _WORD) & (F.col("cluster_id") < (w + 1) * _WORD),
                F.expr(f"shiftleft(1L, cluster_id - {w * _WORD})"),
            ).otherwise(F.lit(0).cast("bigint"))
        ).alias(f"w{w}")
        for w in range(-(-k // _WORD))
    ]


def _lowest_absent(k: int) -> Column:
    """The lowest cluster id missing from the bit sets ``w0, w1, ...``, null when none is."""
    found = F.lit(None).cast("int")
    for word in reversed(range(-(-k // _WORD))):
        bits = F.col(f"w{word}")
        here = F.bit_count(bits.bitwiseXOR(bits + 1)) - 1 + word * _WORD
        found = F.when(here < min(k, (word + 1) * _WORD), here).otherwise(found)
    return found


def assign_clusters(
    ratings: DataFrame,
    users: DataFrame,
    centroids: DataFrame,
    k: int,
    distance: Distance = MASKED_COSINE,
    n_cells: int | None = None,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``(user_id, cluster_id, distance)`` of the nearest of ``k`` centroids, the lowest id on ties.

    Every user gets a cluster; without any common item it is cluster 0 at the distance of such pairs.
    """
    n_cells = centroids.count() if n_cells is None else n_cells
    sums = cell_sums(ratings, centroids, distance, n_cells, broadcast_cells)
    users = users.select("user_id")
    if distance.absent is None:
        return _assign_with_norms(ratings, users, centroids, k, distance, sums)

    nearest = sums.select("user_id", "cluster_id", _value(distance).alias("distance"))
    best = nearest.groupBy("user_id").agg(F.min(F.struct("distance", "cluster_id")).alias("best"), *cluster_bits(k))
    # a cluster the user shares nothing with may still be the nearest
    absent = F.lit(distance.absent)
    id_absent = _lowest_absent(k)
    d, c = F.col("best.distance"), F.col("best.cluster_id")
    taken = id_absent.isNotNull() & ((d > absent) | ((d == absent) & (c > id_absent)))
    chosen = best.select(
        "user_id",
        F.when(taken, id_absent).otherwise(c).alias("cluster_id"),
        F.when(taken, absent).otherwise(d).alias("distance"),
    )
    return users.join(chosen, "user_id", "left").select(
        "user_id",
        F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"),
        F.coalesce("distance", absent).alias("distance"),
    )


def _assign_with_norms(ratings, users, centroids, k, distance, sums) -> DataFrame:
    """For distances that differ between pairs without a common item.

    These grow with the norms and fall with the products, and no value is negative: so of the clusters
    a user shares nothing with only the one with the smallest norm can be nearest, and a shared one is
    never nearer by this rule than by its own sums. No user is paired with every cluster.
    """
    a = F.col("rating").cast("double")
    own = ratings.where(rated()).groupBy("user_id").agg(F.sum(a * a).alias("full_a2"))
    ids = ratings.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    norms = ids.join(_centroid_norms(centroids), "cluster_id", "left").fillna(0.0, ["full_b2"])
    least = norms.agg(F.min(F.struct("full_b2", "cluster_id")).alias("m")).first()["m"]
    nearest = sums.groupBy("user_id").agg(
        F.min(F.struct(_value(distance).alias("distance"), "cluster_id")).alias("best")
    )
    zero = F.lit(0.0)
    apart = Sums(zero, zero, zero, F.coalesce("full_a2", zero), F.lit(float(least["full_b2"])))
    other = F.struct(
        F.round(distance.formula(apart, F.greatest), PLACES).alias("distance"),
        F.lit(least["cluster_id"]).alias("cluster_id"),
    )
    joined = users.join(own, "user_id", "left").join(nearest, "user_id", "left")
    best = F.least("best", other)
    return joined.select("user_id", best["cluster_id"].alias("cluster_id"), best["distance"].alias("distance"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_users"))


def cluster_scores(ratings: DataFrame, assignments: DataFrame) -> DataFrame:
    """Mean rating of each item over all members of each cluster, 0 where a member has none.

    Zero means have no row. Ratings are summed before the division, so only the sums are shuffled.
    """
    members = assignments.select("user_id", "cluster_id")
    sums = (
        ratings.where(rated())
        .join(members, "user_id")
        .groupBy("cluster_id", "gmap_id")
        .agg(F.sum("rating").alias("total"))
    )
    # one row per cluster, so bounded by their number
    sizes = F.broadcast(cluster_sizes(members))
    return sums.join(sizes, "cluster_id").select(
        "cluster_id", "gmap_id", (F.col("total") / F.col("n_users")).alias("score")
    )


def update_centroids(ratings: DataFrame, assignments: DataFrame) -> DataFrame:
    """The same means as new centroids; an empty cluster is all zeros, that is, has no row."""
    return cluster_scores(ratings, assignments).withColumnRenamed("score", "value")


def total_error(assignments: DataFrame) -> float:
    return assignments.agg(F.sum("distance")).first()[0] or 0.0


def random_start(ratings: DataFrame, users: DataFrame, k: int, seed: int) -> DataFrame:
    """The vectors of ``k`` users drawn by seeded hash."""
    draw = F.md5(F.concat_ws("|", "user_id", F.lit(str(seed))))
    drawn = top_n(users.select("user_id", draw.alias("draw")), k, "draw", "user_id")
    # the window runs over the k drawn rows only
    numbered = drawn.select(
        "user_id", (F.row_number().over(Window.orderBy("draw", "user_id")) - 1).alias("cluster_id")
    )
    start = ratings.where(rated()).join(F.broadcast(numbered), "user_id")
    return start.select("cluster_id", "gmap_id", F.col("rating").cast("double").alias("value"))


def _layout(ratings: DataFrame, users: DataFrame, hot_rows: int) -> list[tuple[DataFrame, DataFrame]]:
    """``(ratings, users)`` parts for the rounds.

    The main part is bucketed by user, so a round shuffles no rating. Users with very many ratings,
    if there are any, are a second part that is not kept together; its sums are combined per task
    first.
    """
    ratings = ratings.where(rated()).select("user_id", "gmap_id", F.col("rating").cast("double"))
    users = users.select("user_id")
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.where(F.col("n") > hot_rows).select("user_id"), "hot-users")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    n = max(shuffle_partitions(ratings.sparkSession), -(-rows // BUCKET_ROWS))
    parts = []
    if not hot.isEmpty():
        parts = [(stored(ratings.join(hot, "user_id", "left_semi").repartition(n), "hot-ratings"), hot)]
        ratings = ratings.join(hot, "user_id", "left_anti")
        users = users.join(hot, "user_id", "left_anti")
    main = stored_by(ratings, "user_id", n, "ratings"), stored_by(users, "user_id", n, "users")
    return [main, *parts]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def kmeans(
    ratings: DataFrame,
    users: DataFrame,
    k: int = CLUSTERS,
    distance: Distance = MASKED_COSINE,
    init: str | DataFrame = "euclidean",
    max_iter: int = ROUNDS,
    tol: float = TOLERANCE,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
    broadcast_cells: int = BROADCAST_CELLS,
    laid: block_rounds.Laid | None = None,
) -> KMeansResult:
    """Rounds of assignment and mean under the distance.

    ``init`` is ``"random"``, ``"k-means++"``, a table of centroids, or ``"euclidean"``: the centres of
    a complete run of the same rounds under the squared Euclidean distance from the k-means++ start. A run stops when
    the total error changes by less than ``tol`` or no centroid cell moves, with the centroids that
    the assignments belong to, or after ``max_iter`` rounds. The mean does not minimise every
    distance, so the error may rise. ``laid`` are these ratings and users as ``block_rounds.lay_out`` gives them, for
    several runs.
    """
    blocks = block_rounds.lay_out(ratings, users, hot_rows) if laid is None else laid
    if blocks is not None:
        try:
            found = _in_blocks(blocks, ratings, users, k, distance, init, max_iter, tol, seed, hot_rows, broadcast_cells)
        finally:
            if laid is None:
                block_rounds.close(blocks)
        if found is not None:
            return found
    return _from_start(_layout(ratings, users, hot_rows), k, distance, init, max_iter, tol, seed, broadcast_cells)


# tolerances of cells and places of distances, for rounds in blocks
RULES = (RTOL, ATOL, PLACES)


def _in_blocks(laid, ratings, users, k, distance, init, max_iter, tol, seed, hot_rows, broadcast_cells) -> KMeansResult | None:
    """The run over blocks; none for a table of centroids that blocks do not take."""
    euclidean = isinstance(init, str) and init == "euclidean"
    if isinstance(init, str) and init == "random":
        cells = random_start(ratings, users, k, seed)
    else:
        parts = [] if isinstance(init, DataFrame) else _layout(ratings, users, hot_rows)
        cells = start_of(parts, k, "k-means++" if euclidean else init, seed, broadcast_cells)
    cells = cut(cells.select("cluster_id", "gmap_id", "value"))
    start = block_rounds.table_start(laid, cells.withColumn("k", F.lit(k)), [k])
    if start is None:
        return None
    source = start
    if euclidean:
        source = block_rounds.rounds(laid, start, [k], SQUARED_EUCLIDEAN, ROUNDS, tol, RULES)[k].source
    run = block_rounds.rounds(laid, source, [k], distance, max_iter, tol, RULES)[k]
    centroids = cells if run.source is start else block_rounds.centroids(laid, run, k)
    return KMeansResult(centroids, block_rounds.assigned(laid, run, k, distance, RULES), run.errors)


def start_of(parts, k: int, init: str | DataFrame, seed: int, broadcast_cells: int) -> DataFrame:
    """Centroid cells to start from: a given table, a random draw, or a k-means++ one."""
    if isinstance(init, DataFrame):
        return init
    rows, users = _union([r for r, _ in parts]), _union([u for _, u in parts])
    if init == "random":
        return random_start(rows, users, k, seed)
    if init == "k-means++":
        return plus_plus_start(rows, users, k, seed, nearest_of(parts, SQUARED_EUCLIDEAN, broadcast_cells))
    raise ValueError(f"unknown start {init!r}")


def _from_start(parts, k, distance, init, max_iter, tol, seed, broadcast_cells) -> KMeansResult:
    if isinstance(init, str) and init == "euclidean":
        start = start_of(parts, k, "k-means++", seed, broadcast_cells)
        start = _rounds(parts, k, SQUARED_EUCLIDEAN, start, ROUNDS, tol, broadcast_cells).centroids
    else:
        start = start_of(parts, k, init, seed, broadcast_cells)
    return _rounds(parts, k, distance, start, max_iter, tol, broadcast_cells)


def nearest_of(parts, distance: Distance, broadcast_cells: int = BROADCAST_CELLS) -> Assign:
    """Assignment to any centroid cells, each part on its own."""

    def assign(cells: DataFrame, k: int) -> DataFrame:
        n_cells = cells.count()
        return _union([assign_clusters(r, u, cells, k, distance, n_cells, broadcast_cells) for r, u in parts])

    return assign


def _rounds(parts, k, distance, start, max_iter, tol, broadcast_cells) -> KMeansResult:
    centroids = cut(start.select("cluster_id", "gmap_id", "value"))
    n_cells = centroids.count()

    def assign() -> DataFrame:
        nearest = [
            assign_clusters(r, u, centroids, k, distance, n_cells, broadcast_cells) for r, u in parts
        ]
        return cut(_union(nearest))

    errors: list[float] = []
    for _ in range(max_iter):
        assigned = assign()
        moved = cut(_union_scores([r for r, _ in parts], assigned))
        error, n_moved, n_new = _round_figures(assigned, centroids, moved)
        errors.append(error)
        if len(errors) > 1 and abs(errors[-2] - error) < tol or n_moved == 0:
            return KMeansResult(centroids, assigned, errors)
        centroids, n_cells = moved, n_new
    return KMeansResult(centroids, assign(), errors)


def _union_scores(parts: Sequence[DataFrame], assigned: DataFrame) -> DataFrame:
    """``update_centroids`` with each part joined on its own, so that buckets stay in use."""
    members = assigned.select("user_id", "cluster_id")
    rows = _union([r.join(members, "user_id").select("cluster_id", "gmap_id", "rating") for r in parts])
    sums = rows.groupBy("cluster_id", "gmap_id").agg(F.sum("rating").alias("total"))
    # one row per cluster, so bounded by their number
    sizes = F.broadcast(cluster_sizes(members))
    return sums.join(sizes, "cluster_id").select(
        "cluster_id", "gmap_id", (F.col("total") / F.col("n_users")).alias("value")
    )


def _round_figures(assigned: DataFrame, old: DataFrame, new: DataFrame) -> tuple[float, int, int]:
    """Total error, cells that differ between two sets of centroids, cells of the new one."""
    zero = F.lit(0.0)
    cells = old.select("cluster_id", "gmap_id", F.col("value").alias("a"), zero.alias("b"), F.lit(0).alias("is_new"))
    cells = cells.unionByName(
        new.select("cluster_id", "gmap_id", zero.alias("a"), F.col("value").alias("b"), F.lit(1).alias("is_new"))
    )
    sides = [F.sum(c).alias(c) for c in ("a", "b", "is_new")]
    a, b = F.col("a"), F.col("b")
    counts = cells.groupBy("cluster_id", "gmap_id").agg(*sides).agg(
        F.count_if(F.abs(a - b) > ATOL + RTOL * F.abs(b)).alias("n_moved"), F.sum("is_new").alias("n_new")
    )
    errors = assigned.agg(F.sum("distance").alias("error"))
    row = errors.unionByName(counts, allowMissingColumns=True).agg(F.max("error"), F.max("n_moved"), F.max("n_new")).first()
    return row[0] or 0.0, row[1], row[2] or 0


def cluster_recommendations(
    ratings: DataFrame,
    assignments: DataFrame,
    n: int = LISTED_ITEMS,
    features: DataFrame | None = None,
    keep_zero: bool = True,
) -> DataFrame:
    """``(cluster_id, gmap_id, score, rank)``: the best items of each cluster.

    A list shorter than ``n`` goes on with features nobody in the cluster has rated, in id order and
    with score 0; ``features`` are the rated items unless given. An empty cluster has no list. Only
    the lowest ``2 n`` features can be needed, as at most ``n`` of them are in the list already.
    """
    scores = cluster_scores(ratings, assignments).select("cluster_id", "gmap_id", "score")
    best = top_n_per(scores, ["cluster_id"], n, [F.desc("score"), F.asc("gmap_id")])
    if not keep_zero:
        return best
    best = stored(best.drop("rank"), "best")
    sizes = cluster_sizes(assignments).select("cluster_id")
    found = best.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    short = stored(sizes.join(found, "cluster_id", "left").where(F.coalesce("_n", F.lit(0)) < n), "short")
    if not short.isEmpty():
        items = (ratings.where(rated()) if features is None else features).select("gmap_id").distinct()
        # 2 n ids, and the clusters with a short list
        low = [r[0] for r in top_n(items, 2 * n, "gmap_id").collect()]
        cells = short.select("cluster_id", F.explode(F.array(*map(F.lit, low)).cast("array<string>")).alias("gmap_id"))
        zero = cells.join(best, ["cluster_id", "gmap_id"], "left_anti").withColumn("score", F.lit(0.0))
        best = best.unionByName(zero)
    return top_n_per(best, ["cluster_id"], n, [F.desc("score"), F.asc("gmap_id")])


def nest_recommendations(listed: DataFrame, key: str) -> DataFrame:
    """One row per key with its items as an array of structs, best score first, then by id.

    ``listed`` is a top-N list, so no array is longer than N.
    """
    entry = F.struct((-F.col("score")).alias("minus"), F.col("gmap_id"), F.col("score"))
    arrays = listed.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    recs = F.transform("entries", lambda e: F.struct(e["gmap_id"].alias("gmap_id"), e["score"].alias("score")))
    return arrays.select(key, recs.alias("recommendations"))


def cluster_lists(listed: DataFrame, k: int) -> DataFrame:
    """The nested list of every cluster 0..k-1, empty for an empty cluster."""
    spark = listed.sparkSession
    ids = spark.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    empty = F.from_json(F.lit("[]"), "array<struct<gmap_id:string,score:double>>")
    return ids.join(nest_recommendations(listed, "cluster_id"), "cluster_id", "left").select(
        "cluster_id", F.coalesce("recommendations", empty).alias("recommendations")
    )


def rmse(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """One row: root-mean-square error and number of rows; null without rows."""
    error = F.col(label) - F.col(prediction)
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def cluster_predictions(
    ratings: DataFrame, users: DataFrame, centroids: DataFrame, listed: DataFrame, k: int
) -> DataFrame:
    """Ratings of held-out users next to the score of the item in the list of the user's cluster."""
    assigned = assign_clusters(ratings, users, centroids, k).select("user_id", "cluster_id")
    scores = listed.select("cluster_id", "gmap_id", F.col("score").alias("prediction"))
    # the lists are k x n rows at most
    return (
        ratings.where(F.col("rating") > 0)
        .join(assigned, "user_id")
        .join(F.broadcast(scores), ["cluster_id", "gmap_id"])
    )


def cluster_rmse(
    ratings: DataFrame, users: DataFrame, centroids: DataFrame, listed: DataFrame, k: int
) -> DataFrame:
    """Error of the cluster lists on held-out users; items outside the lists do not count."""
    return rmse(cluster_predictions(ratings, users, centroids, listed, k))


def model_tables(result: KMeansResult, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, centroids and assignments in the schemas of the stored model."""

    def fit(df: DataFrame, schema: str) -> DataFrame:
        return df.to(df.sparkSession.createDataFrame([], schema).schema)

    return (
        fit(features.select("gmap_id"), schemas.FEATURES),
        fit(result.centroids.select("cluster_id", "gmap_id", "value"), schemas.CENTROIDS),
        fit(result.assignments.select("user_id", "cluster_id"), schemas.ASSIGNMENTS),
    )
