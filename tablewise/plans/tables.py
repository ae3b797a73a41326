"""Views of the star-schema tables as reviews, items, users, events and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("gmap_id"),
        F.floor((F.col("l_quantity") - 1) / 10 + 1).cast("int").alias("rating"),
        millis("l_shipdate").alias("time"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Raw metadata; promotional places have no address, standard ones no url."""
    key = F.col("p_partkey").cast("string")
    return table(spark, folder, "part").select(
        key.alias("gmap_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit("No. "), key)).alias("address"),
        F.when(F.col("p_type") != "STANDARD", F.concat(F.lit("https://maps.test/"), key)).alias("url"),
        F.array("p_brand", "p_type").alias("category"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(table(spark, folder, "events"))


def as_events(raw: DataFrame) -> DataFrame:
    """App events; kinds the app does not know keep their own name."""
    kind = F.col("event_type")
    return raw.select(
        F.when(kind == "view", "user_entered")
        .when(kind == "click", "url_click")
        .when(kind == "purchase", "user_exited")
        .otherwise(kind)
        .alias("event_type"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("gmap_id"),
        F.timestamp_millis(millis("ts")).alias("ts"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("gmap_id"), "url", "html"
    )


# the same views for the SQL side of a query
SQL_VIEWS = {
    "rv": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS gmap_id,
        CAST(1 + FLOOR((l_quantity - 1) / 10) AS INT) AS rating, epoch_ms(l_shipdate) AS time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "it": """SELECT CAST(p_partkey AS VARCHAR) AS gmap_id, p_name AS name,
        CASE WHEN p_type <> 'PROMO' THEN 'No. ' || CAST(p_partkey AS VARCHAR) END AS address,
        CASE WHEN p_type <> 'STANDARD' THEN 'https://maps.test/' || CAST(p_partkey AS VARCHAR) END AS url,
        p_brand, p_type FROM part""",
    "us": "SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer",
    "ev": """SELECT CASE event_type WHEN 'view' THEN 'user_entered' WHEN 'click' THEN 'url_click'
        WHEN 'purchase' THEN 'user_exited' ELSE event_type END AS event_type,
        CAST(user_id AS VARCHAR) AS user_id,
        regexp_extract(props, '"k": *([0-9]+)', 1) AS gmap_id, epoch_us(ts) // 1000 AS ms FROM events""",
    "mean_rv": "SELECT user_id, gmap_id, avg(rating) AS rating FROM rv GROUP BY user_id, gmap_id",
}
_NEEDS = {"mean_rv": ["rv"]}


def with_views(sql: str, *names: str) -> str:
    """The SQL behind a WITH list of the named views; ``sql`` may start with its own list items."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    heads = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in ordered)
    body = sql.strip()
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads}\n{body}"
