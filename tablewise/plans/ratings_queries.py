"""Ratings in long form, splits, statistics and nesting."""

from pyspark.sql import functions as F

from tablewise.operators import matrix, ranking, ratings
from tablewise.plans import tables
from tablewise.plans.registry import query
from tablewise.plans.tables import with_views


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    with_views("SELECT user_id, gmap_id, round(avg(rating), 6) AS rating FROM rv GROUP BY ALL", "rv")
)
def mean_ratings(spark, folder):
    return _rounded(ratings.mean_ratings(tables.reviews(spark, folder)), "rating")


@query(with_views("SELECT user_id, count(DISTINCT gmap_id) AS n_reviews FROM rv GROUP BY user_id", "rv"))
def user_activity(spark, folder):
    return ratings.user_activity(ratings.mean_ratings(tables.reviews(spark, folder)))


@query(with_views("SELECT user_id, count(DISTINCT gmap_id) AS n_items FROM rv GROUP BY user_id", "rv"))
def rated_items(spark, folder):
    return ratings.rated_items(ratings.mean_ratings(tables.reviews(spark, folder)))


@query(
    with_views(
        """SELECT gmap_id, count(DISTINCT user_id) AS n_raters FROM rv GROUP BY gmap_id
        HAVING count(DISTINCT user_id) >= 30""",
        "rv",
    )
)
def feature_items(spark, folder):
    return ratings.feature_items(ratings.mean_ratings(tables.reviews(spark, folder)), 30)


# shares of all users, so that both cuts are made at any size; the defaults are numbers of users
CLUSTER_INPUT = """WITH first AS (SELECT user_id FROM mean_rv GROUP BY user_id
    ORDER BY count(*) DESC, user_id LIMIT (SELECT count(*) * 4 // 5 FROM us)),
    kept AS (SELECT user_id, count(*) AS n_items FROM mean_rv WHERE user_id IN (SELECT user_id FROM first)
    GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT (SELECT count(*) * 3 // 5 FROM us)),
    feats AS (SELECT gmap_id, count(*) AS n_raters FROM mean_rv WHERE user_id IN (SELECT user_id FROM kept)
    GROUP BY gmap_id HAVING count(*) >= 18)"""


def cluster_settings(spark, folder):
    n = tables.users(spark, folder).count()
    return {"top_reviewers": n * 4 // 5, "kept_users": n * 3 // 5, "min_raters": 18}


def _cluster_input(spark, folder):
    return ratings.cluster_input(tables.reviews(spark, folder), **cluster_settings(spark, folder))


@query(
    with_views(
        CLUSTER_INPUT
        + """SELECT user_id, gmap_id, round(rating, 6) AS rating FROM mean_rv
        WHERE user_id IN (SELECT user_id FROM kept) AND gmap_id IN (SELECT gmap_id FROM feats)""",
        "mean_rv",
        "us",
    )
)
def cluster_input_ratings(spark, folder):
    return _rounded(_cluster_input(spark, folder).ratings, "rating")


@query(with_views(CLUSTER_INPUT + "SELECT user_id, n_items FROM kept", "mean_rv", "us"))
def cluster_input_users(spark, folder):
    return _cluster_input(spark, folder).users


@query(with_views(CLUSTER_INPUT + "SELECT gmap_id, n_raters FROM feats", "mean_rv", "us"))
def cluster_input_features(spark, folder):
    return _cluster_input(spark, folder).features


_ACTIVITY = """WITH act AS (SELECT user_id, count(*) AS n_items FROM mean_rv GROUP BY user_id),
    placed AS (SELECT *, row_number() OVER (ORDER BY n_items DESC, user_id) AS rank FROM act)"""


@query(
    with_views(
        _ACTIVITY
        + """SELECT user_id, n_items, rank, rank <= floor((SELECT count(*) FROM act) * 0.9) AS train FROM placed""",
        "mean_rv",
    )
)
def activity_split(spark, folder):
    users = ratings.rated_items(ratings.mean_ratings(tables.reviews(spark, folder)))
    train, test = ratings.activity_split(users, 0.9)
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


@query(
    with_views(
        """SELECT user_id, gmap_id, ('0x' || substr(md5(user_id || '|' || gmap_id || '|42'), 1, 8))::BIGINT % 10000 < 8000
        AS train FROM mean_rv""",
        "mean_rv",
    )
)
def random_split(spark, folder):
    pairs = ratings.mean_ratings(tables.reviews(spark, folder)).select("user_id", "gmap_id")
    train, test = ratings.random_split(pairs, 0.8, 42)
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


@query(
    with_views(
        """SELECT it.gmap_id, it.name, coalesce(n, 0) AS "Reviews", coalesce(mean, 0.0) AS "Rating" FROM it
        LEFT JOIN (SELECT gmap_id, count(*) AS n, round_even(avg(rating), 1) AS mean FROM rv
        WHERE rating >= 4 GROUP BY gmap_id) s ON it.gmap_id = s.gmap_id""",
        "rv",
        "it",
    )
)
def item_stats(spark, folder):
    good = tables.reviews(spark, folder).where("rating >= 4")
    return ratings.item_stats(tables.items(spark, folder).select("gmap_id", "name"), good)


_CHUNK = 20


@query(
    with_views(
        f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, gmap_id, rating) - 1 AS pos
        FROM rv) SELECT user_id, CAST(pos // {_CHUNK} AS BIGINT) AS chunk, CAST(pos % {_CHUNK} AS INT) AS pos, gmap_id, rating, time
        FROM placed""",
        "rv",
    )
)
def nested_users(spark, folder):
    """Nested and read back entry by entry; the short chunks make every busy user go over several."""
    nested = ratings.nest_users(tables.reviews(spark, folder), chunk_rows=_CHUNK)
    return ratings.flat_ratings(nested).select("user_id", "chunk", "pos", "gmap_id", "rating", "time")


@query(
    with_views(
        """SELECT user_id, gmap_id, CAST(arg_max(rating, (time, rating)) AS DOUBLE) AS rating FROM rv
        GROUP BY user_id, gmap_id""",
        "rv",
    )
)
def user_vectors(spark, folder):
    """Of several ratings of one item the last in the nested array counts."""
    return ratings.user_vectors(ratings.nest_users(tables.reviews(spark, folder)))


@query(
    with_views(
        """SELECT user_id, coalesce(max(CASE WHEN gmap_id = '1' THEN rating END), 0) AS "1",
        coalesce(max(CASE WHEN gmap_id = '2' THEN rating END), 0) AS "2",
        coalesce(max(CASE WHEN gmap_id = '3' THEN rating END), 0) AS "3" FROM mean_rv GROUP BY user_id""",
        "mean_rv",
    )
)
def pivot_ratings(spark, folder):
    pairs = ratings.mean_ratings(tables.reviews(spark, folder))
    return _rounded(ratings.pivot_ratings(pairs, ["1", "2", "3"]), "1", "2", "3")


@query(
    with_views(
        """SELECT user_id, gmap_id, dense_rank() OVER (ORDER BY gmap_id) - 1 AS place, round(rating, 6) AS rating FROM mean_rv""",
        "mean_rv",
    )
)
def matrix_cells(spark, folder):
    """The matrix of all users and items in slices of 500 columns, read back cell by cell."""
    pairs = ratings.mean_ratings(tables.reviews(spark, folder))
    return _rounded(matrix.cells(matrix.matrix(pairs, width=500)), "rating")


@query(
    with_views(
        """SELECT user_id, gmap_id, rating, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY rating DESC, gmap_id) AS rank FROM mean_rv) WHERE rank <= 13""",
        "mean_rv",
    )
)
def top_rated_per_user(spark, folder):
    pairs = ratings.mean_ratings(tables.reviews(spark, folder))
    return ranking.top_n_per(pairs, ["user_id"], 13, [F.desc("rating"), F.asc("gmap_id")])
