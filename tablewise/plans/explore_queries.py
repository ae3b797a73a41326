"""Exploratory aggregates and top-k reports."""

from pyspark.sql import functions as F

from tablewise.operators import explore
from tablewise.plans import tables
from tablewise.plans.registry import query
from tablewise.plans.tables import with_views


@query(with_views("SELECT rating, count(*) AS n_reviews FROM rv GROUP BY rating", "rv"))
def rating_distribution(spark, folder):
    return explore.rating_distribution(tables.reviews(spark, folder))


@query(
    with_views(
        """SELECT count(*) AS total_reviews, (SELECT count(*) FROM us) AS total_users,
        round(avg(rating), 6) AS average_rating,
        round(count(*) / CAST((SELECT count(*) FROM us) AS DOUBLE), 6) AS reviews_per_user FROM rv""",
        "rv",
        "us",
    )
)
def macro_stats(spark, folder):
    stats = explore.macro_stats(tables.reviews(spark, folder), tables.users(spark, folder))
    return stats.withColumns(
        {
            "average_rating": F.round("average_rating", 6),
            "reviews_per_user": F.round("reviews_per_user", 6),
        }
    )


@query(
    with_views(
        """SELECT user_id, count(*) AS n_reviews FROM rv GROUP BY user_id
        ORDER BY n_reviews DESC, user_id LIMIT 1""",
        "rv",
    )
)
def most_active_user(spark, folder):
    return explore.most_active_user(tables.reviews(spark, folder))


@query(
    with_views(
        """SELECT gmap_id, rating, count(*) AS rating_count FROM rv WHERE gmap_id IN
        (SELECT gmap_id FROM rv GROUP BY gmap_id ORDER BY count(*) DESC, gmap_id LIMIT 10)
        GROUP BY gmap_id, rating""",
        "rv",
    )
)
def top_item_ratings(spark, folder):
    return explore.top_item_ratings(tables.reviews(spark, folder), 10)


@query(
    with_views(
        """SELECT user_id, rating, count(*) AS rating_count FROM rv WHERE user_id IN
        (SELECT user_id FROM rv GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)
        GROUP BY user_id, rating""",
        "rv",
    )
)
def top_reviewer_ratings(spark, folder):
    return explore.top_reviewer_ratings(tables.reviews(spark, folder), 10)


@query(
    with_views(
        """SELECT category, count(*) AS n_items FROM
        (SELECT p_brand AS category FROM it UNION ALL SELECT p_type FROM it)
        GROUP BY category ORDER BY n_items DESC, category LIMIT 20""",
        "it",
    )
)
def top_categories(spark, folder):
    return explore.top_categories(tables.items(spark, folder), 20)
