"""Clustering under the masked distance, step by step and in rounds."""

from pyspark.sql import functions as F

from tablewise.functions.distances import COSINE, SQUARED_EUCLIDEAN
from tablewise.operators import block_rounds, bounded, choice, clustering, ratings, seeding, set_join, similarity
from tablewise.plans import tables
from tablewise.plans.registry import query
from tablewise.plans.tables import with_views
from tablewise.shared import new_path, stored
from tablewise.sources import scans, sinks

K, SEED = 8, 42


def _start(k):
    return f"""drawn AS (SELECT user_id, CAST(row_number() OVER (ORDER BY md5(user_id || '|{SEED}'), user_id) - 1 AS INT)
    AS cluster_id FROM us ORDER BY md5(user_id || '|{SEED}'), user_id LIMIT {k}),
    cent0 AS (SELECT cluster_id, gmap_id, rating AS value FROM mean_rv JOIN drawn USING (user_id))"""


_MASKED = "1 - dot / (na * nb) * (1 - abs(na - nb) / greatest(na, nb))"


def _assigned(i, k, ratings="mean_rv", users="us", form=_MASKED, absent="1.0", name="assigned"):
    """The distance written out as it is defined, on the full grid of users and clusters."""
    return f"""sums{name}{i} AS (SELECT m.user_id, c.cluster_id, sum(m.rating * c.value) AS dot,
    sqrt(sum(m.rating * m.rating)) AS na, sqrt(sum(c.value * c.value)) AS nb
    FROM {ratings} m JOIN cent{i} c USING (gmap_id) GROUP BY ALL),
    fulla{name}{i} AS (SELECT user_id, sum(rating * rating) AS fa2 FROM {ratings} GROUP BY ALL),
    fullb{name}{i} AS (SELECT cluster_id, sum(value * value) AS fb2 FROM cent{i} GROUP BY ALL),
    grid{name}{i} AS (SELECT u.user_id, g.cluster_id, round(coalesce({form}, {absent}), 9) + 0.0 AS d FROM {users} u
    CROSS JOIN (SELECT CAST(range AS INT) AS cluster_id FROM range({k})) g
    LEFT JOIN sums{name}{i} s ON s.user_id = u.user_id AND s.cluster_id = g.cluster_id
    LEFT JOIN fulla{name}{i} fa ON fa.user_id = u.user_id LEFT JOIN fullb{name}{i} fb ON fb.cluster_id = g.cluster_id),
    {name}{i} AS (SELECT user_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS distance
    FROM grid{name}{i} GROUP BY user_id)"""


def _updated(i, ratings="mean_rv"):
    return f"""size{i} AS (SELECT cluster_id, count(*) AS n_users FROM assigned{i} GROUP BY ALL),
    cent{i + 1} AS (SELECT cluster_id, gmap_id, sum(rating) / n_users AS value FROM {ratings} JOIN assigned{i}
    USING (user_id) JOIN size{i} USING (cluster_id) GROUP BY cluster_id, gmap_id, n_users)"""


def _sql(select, *steps):
    return with_views("WITH " + ", ".join(steps) + " " + select, "mean_rv", "us")


def _input(spark, folder):
    pairs = stored(ratings.mean_ratings(tables.reviews(spark, folder)), "pairs")
    return pairs, tables.users(spark, folder)


def _first_round(spark, folder, **options):
    pairs, users = _input(spark, folder)
    start = stored(clustering.random_start(pairs, users, K, SEED), "start")
    return pairs, clustering.assign_clusters(pairs, users, start, K, **options)


@query(_sql("SELECT * FROM assigned0", _start(K), _assigned(0, K)))
def assigned_clusters(spark, folder):
    return _first_round(spark, folder)[1]


_EUCLID = "coalesce(fa2, 0.0) + coalesce(fb2, 0.0) - 2 * coalesce(dot, 0.0)"


@query(_sql("SELECT * FROM assigned0", _start(K), _assigned(0, K, form=_EUCLID)))
def assigned_euclidean(spark, folder):
    return _first_round(spark, folder, distance=SQUARED_EUCLIDEAN)[1]


@query(_sql("SELECT * FROM assigned0", _start(K), _assigned(0, K, form="1 - dot / sqrt(fa2 * fb2)")))
def assigned_cosine(spark, folder):
    return _first_round(spark, folder, distance=COSINE)[1]


@query(_sql("SELECT * FROM assigned0", _start(K), _assigned(0, K)))
def assigned_by_item_shuffle(spark, folder):
    """The way for centroids too large to broadcast."""
    return _first_round(spark, folder, broadcast_cells=0)[1]


@query(
    _sql(
        "SELECT cluster_id, gmap_id, round(value, 6) AS value FROM cent1",
        _start(K),
        _assigned(0, K),
        _updated(0),
    )
)
def updated_centroids(spark, folder):
    moved = clustering.update_centroids(*_first_round(spark, folder))
    return moved.withColumn("value", F.round("value", 6))


@query(_sql("SELECT cluster_id, n_users FROM size0", _start(K), _assigned(0, K), _updated(0)))
def cluster_sizes(spark, folder):
    return clustering.cluster_sizes(_first_round(spark, folder)[1])


@query(_sql("SELECT round(sum(distance), 5) AS total_error FROM assigned0", _start(K), _assigned(0, K)))
def assignment_error(spark, folder):
    return _first_round(spark, folder)[1].agg(F.round(F.sum("distance"), 5).alias("total_error"))


@query(
    _sql(
        "SELECT user_id, cluster_id, round(distance, 6) AS distance FROM assigned2",
        _start(K),
        _assigned(0, K),
        _updated(0),
        _assigned(1, K),
        _updated(1),
        _assigned(2, K),
    )
)
def kmeans_two_rounds(spark, folder):
    pairs, users = _input(spark, folder)
    result = clustering.kmeans(pairs, users, K, init="random", max_iter=2, seed=SEED)
    return result.assignments.withColumn("distance", F.round("distance", 6))


@query(
    _sql(
        "SELECT user_id, cluster_id, round(distance, 6) AS distance FROM assigned1",
        _start(K),
        _assigned(0, K),
        _updated(0),
        _assigned(1, K),
    )
)
def kmeans_spread_users(spark, folder):
    """Busy users, here those with more than 40 ratings, are not kept in one task."""
    pairs, users = _input(spark, folder)
    result = clustering.kmeans(pairs, users, K, init="random", max_iter=1, seed=SEED, hot_rows=40)
    return result.assignments.withColumn("distance", F.round("distance", 6))


@query(
    _sql(
        "SELECT user_id, cluster_id, round(distance, 5) AS distance FROM assigned4",
        _start(K),
        *[s for i in range(4) for s in (_assigned(i, K, form=_EUCLID), _updated(i))],
        _assigned(4, K, form=_EUCLID),
    )
)
def kmeans_bounded(spark, folder):
    """Four Euclidean rounds in which users far from any change are not looked at."""
    pairs, users = _input(spark, folder)
    result = bounded.kmeans(pairs, users, K, "random", max_iter=4, seed=SEED)
    return result.assignments.withColumn("distance", F.round("distance", 5))


@query()
def kmeans_euclidean_start(spark, folder):
    """Both runs go on to their own end, after as many rounds as it takes."""
    pairs, users = _input(spark, folder)
    return clustering.kmeans(pairs, users, K, init="euclidean", seed=SEED).assignments.select("user_id", "cluster_id")


def _drawn(label):
    return f"(CAST('0x' || left(md5(user_id || '|{SEED}|{label}'), 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def _squares(vectors, users, name):
    """Squared distance of every user to every vector of the numbered users."""
    return f"""cells{name} AS (SELECT candidate, gmap_id, rating AS value FROM mean_rv JOIN {vectors} USING (user_id)),
    norms{name} AS (SELECT v.candidate, coalesce(sum(value * value), 0.0) AS b2 FROM {vectors} v LEFT JOIN cells{name} c
    ON c.candidate = v.candidate GROUP BY v.candidate),
    dots{name} AS (SELECT user_id, candidate, sum(rating * value) AS dot FROM mean_rv JOIN cells{name} USING (gmap_id) GROUP BY ALL),
    squares{name} AS MATERIALIZED (SELECT u.user_id, n.candidate, round(coalesce(a2, 0.0) + b2 - 2 * coalesce(dot, 0.0), 9) AS d
    FROM {users} u CROSS JOIN norms{name} n LEFT JOIN own ON own.user_id = u.user_id
    LEFT JOIN dots{name} p ON p.user_id = u.user_id AND p.candidate = n.candidate)"""


def _seeded(k, rounds=5, factor=2):
    steps = [
        "own AS (SELECT user_id, sum(rating * rating) AS a2 FROM mean_rv GROUP BY user_id)",
        f"chosen0 AS MATERIALIZED (SELECT 0 AS candidate, user_id FROM us ORDER BY {_drawn('0')}, user_id LIMIT 1)",
        _squares("chosen0", "us", "0"),
        "near0 AS MATERIALIZED (SELECT user_id, d, candidate FROM squares0)",
    ]
    for r in range(1, rounds + 1):
        # the new ones by name, behind the ones there are
        steps += [
            f"""fresh{r} AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY user_id) - 1 + (SELECT count(*) FROM chosen{r - 1})
            AS INT) AS candidate, user_id FROM near{r - 1}
            WHERE {_drawn(r)} * (SELECT sum(d) FROM near{r - 1}) < {factor * k} * d)""",
            _squares(f"fresh{r}", "us", r),
            f"chosen{r} AS MATERIALIZED (SELECT * FROM chosen{r - 1} UNION ALL SELECT * FROM fresh{r})",
            f"""near{r} AS MATERIALIZED (SELECT user_id, min(d) AS d, arg_min(candidate, (d, candidate)) AS candidate FROM
            (SELECT * FROM near{r - 1} UNION ALL SELECT user_id, d, candidate FROM squares{r}) GROUP BY user_id)""",
        ]
    last = f"chosen{rounds}"
    steps += [
        _squares(last, last, "c"),
        f"""weights AS MATERIALIZED (SELECT c.candidate, c.user_id, count(n.user_id) AS w FROM {last} c
        LEFT JOIN near{rounds} n ON n.candidate = c.candidate GROUP BY ALL)""",
        f"pick0 AS MATERIALIZED (SELECT arg_min(candidate, -ln({_drawn('pick 0')}) / w) AS candidate, 0 AS cluster_id FROM weights)",
    ]
    for j in range(1, k):
        steps.append(
            f"""pick{j} AS MATERIALIZED (SELECT * FROM pick{j - 1} UNION ALL SELECT arg_min(candidate, race), {j} FROM
            (SELECT w.candidate, -ln({_drawn(f"pick {j}").replace("user_id", "w.user_id")}) / (any_value(w.w) * min(s.d)) AS race
            FROM weights w JOIN squaresc s ON s.user_id = w.user_id JOIN pick{j - 1} p ON p.candidate = s.candidate
            GROUP BY w.candidate, w.user_id HAVING min(s.d) > 0))"""
        )
    steps.append(
        f"""cent0 AS MATERIALIZED (SELECT p.cluster_id, gmap_id, rating AS value FROM pick{k - 1} p
        JOIN {last} c ON c.candidate = p.candidate JOIN mean_rv m ON m.user_id = c.user_id)"""
    )
    return ", ".join(steps)


@query(_sql("SELECT cluster_id, gmap_id, round(value, 6) AS value FROM cent0", _seeded(K)))
def plus_plus_start(spark, folder):
    """Users far from each other, drawn in five rounds and reduced to eight."""
    pairs, users = _input(spark, folder)
    nearest = clustering.nearest_of([(pairs, users)], SQUARED_EUCLIDEAN)
    start = seeding.plus_plus_start(pairs, users, K, SEED, nearest)
    return start.withColumn("value", F.round("value", 6))


KS = [2, 4, 6, 8, 12, 16]
LIMIT, TOLERANCE = 12, 4.0  # of the run that is to stop by its error, so that SQL can be unrolled


def _curve(ks, rounds, tol):
    """Runs of all ``ks``, unrolled; each ends by its own rules, or after all rounds."""
    # the draw is the same for all, so the first k of it start the run of k
    steps = [
        _start(max(ks)).replace("cent0 AS", "all0 AS"),
        f"ks AS (SELECT unnest({ks}) AS k)",
        "cells0 AS MATERIALIZED (SELECT k, cluster_id, gmap_id, value FROM all0 JOIN ks ON cluster_id < k)",
    ]
    for i in range(rounds + 1):
        steps += [
            f"""sums{i} AS (SELECT c.k, m.user_id, c.cluster_id, sum(m.rating * c.value) AS dot, sqrt(sum(m.rating * m.rating)) AS na,
            sqrt(sum(c.value * c.value)) AS nb FROM mean_rv m JOIN cells{i} c USING (gmap_id) GROUP BY ALL)""",
            f"""nearest{i} AS MATERIALIZED (SELECT g.k, u.user_id, arg_min(g.cluster_id, (d, g.cluster_id)) AS cluster_id, min(d) AS distance
            FROM us u CROSS JOIN (SELECT k, CAST(unnest(range(k)) AS INT) AS cluster_id FROM ks) g LEFT JOIN
            (SELECT k, user_id, cluster_id, round({_MASKED}, 9) + 0.0 AS s FROM sums{i}) s
            ON s.k = g.k AND s.user_id = u.user_id AND s.cluster_id = g.cluster_id, LATERAL (SELECT coalesce(s, 1.0) AS d)
            GROUP BY g.k, u.user_id)""",
            f"""cells{i + 1} AS MATERIALIZED (SELECT k, cluster_id, gmap_id, sum(rating) / any_value(n) AS value FROM mean_rv
            JOIN nearest{i} USING (user_id) JOIN (SELECT k, cluster_id, count(*) AS n FROM nearest{i} GROUP BY ALL) USING (k, cluster_id)
            GROUP BY k, cluster_id, gmap_id)""",
            f"""error{i} AS (SELECT k, {i} AS i, sum(distance) AS e FROM nearest{i} GROUP BY k)""",
            f"""moved{i} AS (SELECT ks.k, {i} AS i, (SELECT count(*) FROM (SELECT * FROM cells{i} WHERE k = ks.k) a
            FULL JOIN (SELECT * FROM cells{i + 1} WHERE k = ks.k) b USING (cluster_id, gmap_id)
            WHERE abs(coalesce(a.value, 0) - coalesce(b.value, 0)) > 1e-8 + 1e-5 * abs(coalesce(b.value, 0))) AS n FROM ks)""",
        ]
    errors = " UNION ALL ".join(f"SELECT * FROM error{i}" for i in range(rounds + 1))
    moves = " UNION ALL ".join(f"SELECT * FROM moved{i}" for i in range(rounds + 1))
    steps += [
        f"errors AS ({errors})",
        f"moves AS ({moves})",
        f"""ends AS (SELECT a.k, min(a.i) AS i FROM errors a LEFT JOIN errors b ON b.k = a.k AND b.i = a.i - 1
        JOIN moves m ON m.k = a.k AND m.i = a.i WHERE a.i < {rounds} AND (abs(b.e - a.e) < {tol} OR m.n = 0) GROUP BY a.k)""",
        f"""curve AS (SELECT ks.k, e.e AS total_error, coalesce(ends.i + 1, {rounds}) AS rounds FROM ks LEFT JOIN ends ON ends.k = ks.k
        JOIN errors e ON e.k = ks.k AND e.i = coalesce(ends.i, {rounds}))""",
    ]
    return ", ".join(steps)


def _whole_curve(ks):
    """Runs of all ``ks`` as a recursion: a step is a round of those that have not ended, each to its own end by the rules of ``kmeans``."""
    tol, rounds, moved = clustering.TOLERANCE, clustering.ROUNDS, f"> {clustering.ATOL} + {clustering.RTOL}"
    return f"""{_start(max(ks)).replace("cent0 AS", "all0 AS")}, ks AS (SELECT unnest({ks}) AS k), curve AS (SELECT k, error AS total_error, rounds FROM (
    WITH RECURSIVE walk AS (
    (SELECT 0 AS i, k, cluster_id, gmap_id, CAST(value AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS error, CAST(NULL AS INT) AS rounds
    FROM all0 JOIN ks ON cluster_id < k UNION ALL SELECT 0, k, NULL, NULL, NULL, NULL, NULL FROM ks)
    UNION ALL (WITH open AS MATERIALIZED (SELECT i, k, error AS before FROM walk WHERE cluster_id IS NULL AND rounds IS NULL),
    cells AS MATERIALIZED (SELECT k, cluster_id, gmap_id, value FROM walk WHERE cluster_id IS NOT NULL),
    sums AS (SELECT c.k, m.user_id, c.cluster_id, sum(m.rating * c.value) AS dot, sqrt(sum(m.rating * m.rating)) AS na,
    sqrt(sum(c.value * c.value)) AS nb FROM mean_rv m JOIN cells c USING (gmap_id) GROUP BY ALL),
    nearest AS MATERIALIZED (SELECT g.k, u.user_id, arg_min(g.cluster_id, (d, g.cluster_id)) AS cluster_id, min(d) AS distance
    FROM us u CROSS JOIN (SELECT k, CAST(unnest(range(k)) AS INT) AS cluster_id FROM open) g LEFT JOIN
    (SELECT k, user_id, cluster_id, round({_MASKED}, 9) + 0.0 AS s FROM sums) s
    ON s.k = g.k AND s.user_id = u.user_id AND s.cluster_id = g.cluster_id, LATERAL (SELECT coalesce(s, 1.0) AS d)
    GROUP BY g.k, u.user_id),
    means AS MATERIALIZED (SELECT k, cluster_id, gmap_id, sum(rating) / any_value(n) AS value FROM mean_rv
    JOIN nearest USING (user_id) JOIN (SELECT k, cluster_id, count(*) AS n FROM nearest GROUP BY ALL) USING (k, cluster_id)
    GROUP BY k, cluster_id, gmap_id),
    errors AS (SELECT k, sum(distance) AS e FROM nearest GROUP BY k),
    moves AS (SELECT k, count(*) AS n FROM cells a FULL JOIN means b USING (k, cluster_id, gmap_id)
    WHERE abs(coalesce(a.value, 0) - coalesce(b.value, 0)) {moved} * abs(coalesce(b.value, 0)) GROUP BY k),
    ends AS MATERIALIZED (SELECT o.i, o.k, e, CASE WHEN o.i = {rounds} THEN {rounds}
    WHEN abs(o.before - e) < {tol} OR coalesce(n, 0) = 0 THEN o.i + 1 END AS rounds
    FROM open o JOIN errors USING (k) LEFT JOIN moves USING (k))
    SELECT i + 1, k, cluster_id, gmap_id, value, NULL, NULL FROM means JOIN ends USING (k) WHERE rounds IS NULL
    UNION ALL SELECT i + 1, k, NULL, NULL, NULL, e, rounds FROM ends)) SELECT k, error, rounds FROM walk WHERE rounds IS NOT NULL))"""


@query(
    _sql(
        """, scaled AS (SELECT *, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS x,
        (total_error - min(total_error) OVER ()) / (max(total_error) OVER () - min(total_error) OVER ()) AS y FROM curve),
        under AS (SELECT *, round(first_value(y) OVER w + (last_value(y) OVER w - first_value(y) OVER w) * x - y, 9) AS distance
        FROM scaled WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT CAST(k AS INT) AS k, round(total_error, 4) AS total_error, CAST(rounds AS INT) AS rounds, round(distance, 5) AS distance,
        row_number() OVER (ORDER BY distance DESC, k) = 1 AS chosen FROM under""",
        _whole_curve(KS),
    )
)
def elbow(spark, folder):
    """All candidates to their own end, and the one at the knee of the curve."""
    pairs, users = _input(spark, folder)
    table = choice.elbow(pairs, users, KS, init="random", seed=SEED)
    return table.withColumn("total_error", F.round("total_error", 4)).withColumn("distance", F.round("distance", 5))


def _ended(case, k, rounds):
    steps = ", ".join([_start(k), _assigned(0, k), _updated(0), _assigned(1, k)])
    return f"""(WITH {steps} SELECT '{case}' AS stopped_by, {rounds} AS rounds, count(*) AS n_users,
        round(sum(distance), 4) AS total_error FROM assigned1)"""


@query(
    with_views(
        f"""(WITH {_curve([K], LIMIT, TOLERANCE)} SELECT 'error' AS stopped_by, CAST(rounds AS INT) AS rounds,
        (SELECT count(*) FROM us) AS n_users, round(total_error, 4) AS total_error FROM curve)
        UNION ALL {_ended('unmoved cells', 1, 2)} UNION ALL {_ended('round limit', K, 1)}""",
        "mean_rv",
        "us",
    )
)
def kmeans_stops(spark, folder):
    """The three ways a run ends: the error changes by less than the tolerance; with one cluster nothing moves
    after the first mean; one round is all there may be."""
    pairs, users = _input(spark, folder)
    laid = block_rounds.lay_out(pairs, users, clustering.HOT_ROWS)
    runs = {
        "error": clustering.kmeans(pairs, users, K, init="random", max_iter=LIMIT, tol=TOLERANCE, seed=SEED, laid=laid),
        "unmoved cells": clustering.kmeans(pairs, users, 1, init="random", tol=0.0, seed=SEED, laid=laid),
        "round limit": clustering.kmeans(pairs, users, K, init="random", max_iter=1, seed=SEED, laid=laid),
    }
    if laid is not None:
        block_rounds.close(laid)
    rows = [
        result.assignments.agg(
            F.lit(case).alias("stopped_by"),
            F.lit(len(result.errors)).alias("rounds"),
            F.count(F.lit(1)).alias("n_users"),
            F.round(F.sum("distance"), 4).alias("total_error"),
        )
        for case, result in runs.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _listed(ratings="mean_rv", n=40, i=0):
    """Items nobody in the cluster rated have the mean 0."""
    return f"""listed AS (SELECT * FROM (SELECT cluster_id, gmap_id, coalesce(value, 0.0) AS score, row_number() OVER
    (PARTITION BY cluster_id ORDER BY coalesce(value, 0.0) DESC, gmap_id) AS rank
    FROM (SELECT DISTINCT cluster_id FROM size{i}) CROSS JOIN (SELECT DISTINCT gmap_id FROM {ratings})
    LEFT JOIN cent{i + 1} USING (cluster_id, gmap_id)) WHERE rank <= {n})"""


_LISTED = _listed()


@query(
    _sql(
        "SELECT cluster_id, gmap_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM listed",
        _start(K),
        _assigned(0, K),
        _updated(0),
        _LISTED,
    )
)
def cluster_recommendations(spark, folder):
    listed = clustering.cluster_recommendations(*_first_round(spark, folder))
    return listed.withColumn("score", F.round("score", 6))


@query(
    _sql(
        "SELECT cluster_id, gmap_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM listed",
        _start(300),
        _assigned(0, 300),
        _updated(0),
        _listed(n=400),
    )
)
def filled_recommendations(spark, folder):
    """Small clusters: their lists go on with items that none of their users has rated."""
    pairs, users = _input(spark, folder)
    start = stored(clustering.random_start(pairs, users, 300, SEED), "start")
    assigned = clustering.assign_clusters(pairs, users, start, 300)
    listed = clustering.cluster_recommendations(pairs, stored(assigned, "assigned"), 400)
    return listed.withColumn("score", F.round("score", 6))


@query(
    _sql(
        """SELECT g.cluster_id, count(gmap_id) AS n_items, round(coalesce(max(score), 0), 6) AS best
        FROM (SELECT CAST(range AS INT) AS cluster_id FROM range(10)) g LEFT JOIN listed USING (cluster_id)
        GROUP BY g.cluster_id""",
        _start(K),
        _assigned(0, K),
        _updated(0),
        _LISTED,
    )
)
def cluster_lists(spark, folder):
    """Clusters 8 and 9 have no member, so their lists are empty."""
    listed = clustering.cluster_recommendations(*_first_round(spark, folder))
    lists = clustering.cluster_lists(listed, K + 2)
    best = F.coalesce(F.get("recommendations", F.lit(0))["score"], F.lit(0.0))
    return lists.select(
        "cluster_id",
        F.size("recommendations").cast("bigint").alias("n_items"),
        F.round(best, 6).alias("best"),
    )


_SPLIT = """placed AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank
    FROM mean_rv GROUP BY user_id),
    test AS (SELECT user_id FROM placed WHERE rank > floor((SELECT count(*) FROM placed) * 0.9)),
    train_rv AS (SELECT * FROM mean_rv WHERE user_id NOT IN (SELECT user_id FROM test)),
    test_rv AS (SELECT * FROM mean_rv WHERE user_id IN (SELECT user_id FROM test)),
    train AS (SELECT user_id FROM placed WHERE user_id NOT IN (SELECT user_id FROM test))"""


@query(
    _sql(
        """SELECT round(sqrt(avg((rating - score) ** 2)), 6) AS rmse, count(*) AS n FROM test_rv
        JOIN tested1 USING (user_id) JOIN listed USING (cluster_id, gmap_id)""",
        _SPLIT,
        _start(K).replace("FROM us", "FROM train"),
        _assigned(0, K, "train_rv", "train"),
        _updated(0, "train_rv"),
        _listed("train_rv"),
        _assigned(1, K, "test_rv", "test", name="tested"),
    )
)
def cluster_rmse(spark, folder):
    pairs, _ = _input(spark, folder)
    train, test = ratings.activity_split(ratings.rated_items(pairs), 0.9)
    train, test = stored(train, "train"), stored(test, "test")
    train_rows = pairs.join(train, "user_id", "left_semi")
    test_rows = pairs.join(test, "user_id", "left_semi")
    start = stored(clustering.random_start(train_rows, train, K, SEED), "start")
    assigned = stored(clustering.assign_clusters(train_rows, train, start, K), "assigned")
    centroids = stored(clustering.update_centroids(train_rows, assigned), "centroids")
    listed = clustering.cluster_recommendations(train_rows, assigned)
    table = clustering.cluster_rmse(test_rows, test, centroids, listed, K)
    return table.withColumn("rmse", F.round("rmse", 6))


_FIVE = "CAST(CAST(user_id AS BIGINT) % 5 AS INT)"


@query(
    with_views(
        f"""WITH lab AS (SELECT user_id, {_FIVE} AS c FROM us),
        common AS (SELECT a.user_id, b.user_id AS other, sum(a.rating * b.rating) AS dot,
        sqrt(sum(a.rating * a.rating)) AS na, sqrt(sum(b.rating * b.rating)) AS nb
        FROM mean_rv a JOIN mean_rv b ON a.gmap_id = b.gmap_id AND a.user_id <> b.user_id GROUP BY ALL),
        pairs AS (SELECT x.user_id, x.c, y.c AS other_c, coalesce({_MASKED}, 1) AS d FROM lab x JOIN lab y
        ON x.user_id <> y.user_id LEFT JOIN common p ON p.user_id = x.user_id AND p.other = y.user_id),
        means AS (SELECT user_id, c, other_c, avg(d) AS m FROM pairs GROUP BY ALL),
        ab AS (SELECT user_id, c, max(CASE WHEN c = other_c THEN m END) AS a,
        min(CASE WHEN c <> other_c THEN m END) AS b FROM means GROUP BY ALL)
        SELECT user_id, c AS cluster_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM ab""",
        "mean_rv",
        "us",
    )
)
def silhouette(spark, folder):
    """Five fixed groups of users."""
    pairs, users = _input(spark, folder)
    groups = users.select("user_id", (F.col("user_id").cast("bigint") % 5).cast("int").alias("cluster_id"))
    table = similarity.silhouette(pairs, groups)
    return table.withColumn("silhouette", F.round("silhouette", 6))


@query(
    with_views(
        """WITH norms AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM mean_rv GROUP BY user_id),
        dots AS (SELECT a.user_id AS ua, b.user_id AS ub, sum(a.rating * b.rating) AS dot
        FROM mean_rv a JOIN mean_rv b ON a.gmap_id = b.gmap_id AND a.user_id <= b.user_id GROUP BY ALL),
        sim AS (SELECT ua, ub, dot / (n.norm * m.norm) * (1 - abs(n.norm - m.norm) / greatest(n.norm, m.norm)) AS s
        FROM dots JOIN norms n ON n.user_id = ua JOIN norms m ON m.user_id = ub)
        SELECT ua AS user_id, count(*) AS n_similar, round(sum(s), 5) AS total, round(max(s), 9) AS highest,
        round(min(s), 9) AS lowest FROM sim GROUP BY ua""",
        "mean_rv",
    )
)
def user_similarity(spark, folder):
    """All pairs, summed up per first user."""
    pairs, _ = _input(spark, folder)
    sim = similarity.user_similarity(pairs)
    return sim.groupBy(F.col("user_a").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_similar"),
        F.round(F.sum("similarity"), 5).alias("total"),
        F.round(F.max("similarity"), 9).alias("highest"),
        F.round(F.min("similarity"), 9).alias("lowest"),
    )


_ALIKE = """WITH norms AS (SELECT user_id, sum(rating * rating) AS square FROM mean_rv GROUP BY user_id),
    dots AS (SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS n_common, sum(a.rating * b.rating) AS dot
    FROM mean_rv a JOIN mean_rv b ON a.gmap_id = b.gmap_id AND a.user_id < b.user_id GROUP BY ALL HAVING count(*) >= {common}),
    sim AS (SELECT user_a, user_b, n_common, round(dot / greatest(n.square, m.square), 9) AS similarity
    FROM dots JOIN norms n ON n.user_id = user_a JOIN norms m ON m.user_id = user_b)
    SELECT * FROM sim WHERE similarity >= {least}"""


@query(with_views(_ALIKE.format(common=4, least=0.1), "mean_rv"))
def similar_users(spark, folder):
    """Pairs with at least four items in common and a tenth of the highest similarity, not by way of all pairs."""
    return set_join.similar_users(_input(spark, folder)[0], 4, 0.1)


@query(with_views(_ALIKE.format(common=6, least=0.0), "mean_rv"))
def users_with_common_items(spark, folder):
    """Pairs with at least six items in common, whatever the similarity."""
    return set_join.similar_users(_input(spark, folder)[0], 6)


@query(
    _sql(
        """SELECT 'feature' AS part, CAST(NULL AS INT) AS cluster_id, count(DISTINCT gmap_id) AS n FROM mean_rv
        UNION ALL SELECT 'centroid', cluster_id, count(*) FROM cent1 GROUP BY cluster_id
        UNION ALL SELECT 'assignment', cluster_id, count(*) FROM assigned1 GROUP BY cluster_id""",
        _start(K),
        _assigned(0, K),
        _updated(0),
        _assigned(1, K),
    )
)
def stored_model(spark, folder):
    """Features, centroids and assignments written as a model and counted after reading."""
    pairs, users = _input(spark, folder)
    result = clustering.kmeans(pairs, users, K, init="random", max_iter=1, seed=SEED)
    path = new_path(spark, "model")
    sinks.write_model(*clustering.model_tables(result, pairs.select("gmap_id").distinct()), path, 1)
    features, centroids, assigned = scans.read_model(spark, path)
    n = F.count(F.lit(1)).alias("n")
    return (
        features.agg(n)
        .select(F.lit("feature").alias("part"), F.lit(None).cast("int").alias("cluster_id"), "n")
        .unionByName(centroids.groupBy("cluster_id").agg(n).withColumn("part", F.lit("centroid")))
        .unionByName(assigned.groupBy("cluster_id").agg(n).withColumn("part", F.lit("assignment")))
    )
