"""Scans, sinks and cleaning."""

from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.functions import scalars
from tablewise.operators import cleaning, ratings
from tablewise.plans import tables
from tablewise.plans.cleaning_chain import clean
from tablewise.plans.registry import query
from tablewise.plans.tables import with_views
from tablewise.shared import new_path
from tablewise.sources import json_arrays, scans, sinks


def _lines(spark, folder):
    """Metadata as JSON lines: those of medium places are cut short, those of small ones blank."""
    meta = tables.items(spark, folder)
    text = F.to_json(F.struct("gmap_id", "name", "address", "url", "category"))
    kind = F.get("category", F.lit(1))
    return meta.select(
        F.when(kind == "MEDIUM", F.substring(text, 1, 25))
        .when(kind == "SMALL", "  ")
        .otherwise(text)
        .alias("value")
    )


@query(
    with_views(
        """SELECT gmap_id, name, address, url, p_brand || '|' || p_type AS categories FROM it
        WHERE p_type NOT IN ('MEDIUM', 'SMALL')""",
        "it",
    )
)
def ndjson_rows(spark, folder):
    path = new_path(spark, "ndjson")
    _lines(spark, folder).write.text(path)
    rows, _ = scans.read_ndjson(spark, path, schemas.RAW_METADATA, staged=path + "-staged")
    return rows.select("gmap_id", "name", "address", "url", F.concat_ws("|", "category").alias("categories"))


@query(
    with_views(
        """SELECT substr('{"gmap_id":"' || gmap_id || '","name":"' || name || '"', 1, 25) AS value
        FROM it WHERE p_type = 'MEDIUM'""",
        "it",
    )
)
def ndjson_rejects(spark, folder):
    _, rejects = scans.split_rejects(scans.parse_ndjson(_lines(spark, folder), schemas.RAW_METADATA))
    return rejects


@query(with_views("SELECT gmap_id, name, address, url FROM it", "it"))
def json_array_rows(spark, folder):
    """Every file holds one array of at most 1,000 places."""
    path = new_path(spark, "json-array")
    meta = tables.items(spark, folder)
    chunk = F.floor(F.col("gmap_id").cast("bigint") / 1000)
    entries = F.collect_list(F.struct("gmap_id", "name", "address", "url"))
    arrays = meta.groupBy(chunk.alias("chunk")).agg(F.to_json(entries).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return scans.read_json_array(spark, path + "/*", "gmap_id string, name string, address string, url string")


@query(with_views("SELECT gmap_id, name, address, url FROM it", "it"))
def split_array_rows(spark, folder):
    """All places in one file that is one array, read by as many tasks as it has ranges."""
    path = new_path(spark, "one-array")
    entry = F.to_json(F.struct("gmap_id", "name", "address", "url"))
    lines = tables.items(spark, folder).select(F.concat(F.lit(","), entry).alias("value"))
    # an entry without any field stands first, so that all others have their comma
    first, last = (spark.range(1).select(F.lit(text).alias("value")) for text in ("[{}", "]"))
    first.unionByName(lines).unionByName(last).coalesce(1).write.text(path)
    rows, _ = json_arrays.read_split_array(spark, path, "gmap_id string, name string, address string, url string")
    return rows.where(F.col("gmap_id").isNotNull())


@query(with_views("SELECT DISTINCT gmap_id FROM rv", "rv"))
def id_list(spark, folder):
    path = new_path(spark, "ids")
    padded = F.concat(F.lit(" "), "gmap_id", F.lit("  ")).alias("gmap_id")
    sinks.write_ids(tables.reviews(spark, folder).select(padded), path)
    return scans.read_ids(spark, path)


@query(with_views("SELECT user_id, gmap_id, rating, count(*) AS n FROM rv GROUP BY ALL", "rv"))
def json_sink(spark, folder):
    """Cleaned reviews written as JSON and read under their schema."""
    path = new_path(spark, "json-sink")
    sinks.write_json(tables.reviews(spark, folder), path)
    rows, _ = scans.read_ndjson(spark, path, schemas.RAW_REVIEWS)
    return rows.groupBy("user_id", "gmap_id", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT user_id, gmap_id, max(rating) AS rating FROM rv GROUP BY user_id, gmap_id", "rv"))
def projected_scan(spark, folder):
    """Three fields of a stored collection of four."""
    path = new_path(spark, "reviews")
    tables.reviews(spark, folder).write.parquet(path)
    rows = scans.read_table(spark, path, schemas.REVIEWS, ["user_id", "gmap_id", "rating"])
    return rows.groupBy("user_id", "gmap_id").agg(F.max("rating").alias("rating"))


@query(with_views("SELECT gmap_id, count(*) AS n_reviews FROM rv GROUP BY gmap_id", "rv"))
def newest_snapshot(spark, folder):
    """Two runs are kept, the newer one is read."""
    path = new_path(spark, "snapshot")
    counts = tables.reviews(spark, folder).groupBy("gmap_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    sinks.write_snapshot(counts.withColumn("n_reviews", F.lit(0).cast("bigint")), path, 1)
    sinks.write_snapshot(counts, path, 2)
    return scans.read_newest(spark, path, "gmap_id string, n_reviews bigint")


@query(
    with_views(
        """SELECT user_id AS key, '{"event_type":"' || event_type || '","user_id":"' || user_id ||
        '","gmap_id":"' || gmap_id || '"}' AS value FROM ev""",
        "ev",
    )
)
def key_value_rows(spark, folder):
    return sinks.to_key_value(tables.events(spark, folder).select("event_type", "user_id", "gmap_id"))


_ECONOMY = "SELECT gmap_id FROM it WHERE p_type = 'ECONOMY'"


@query(with_views("SELECT DISTINCT gmap_id FROM it WHERE 'ECONOMY' IN (p_brand, p_type)", "it"))
def ids_with_category(spark, folder):
    return cleaning.ids_with_category(tables.items(spark, folder), "ECONOMY")


@query(
    with_views(f"SELECT user_id, time, rating, gmap_id FROM rv WHERE gmap_id IN ({_ECONOMY})", "rv", "it")
)
def clean_reviews(spark, folder):
    ids = cleaning.ids_with_category(tables.items(spark, folder), "ECONOMY")
    return cleaning.clean_reviews(tables.reviews(spark, folder), ids)


_LISTED = "(SELECT gmap_id FROM rv GROUP BY gmap_id HAVING count(*) >= 30)"


def _listed(spark, folder):
    counts = tables.reviews(spark, folder).groupBy("gmap_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= 30).select("gmap_id")


@query(
    with_views(
        f"""SELECT name, address, gmap_id, url FROM it
        WHERE gmap_id IN {_LISTED} AND address IS NOT NULL AND url IS NOT NULL""",
        "rv",
        "it",
    )
)
def clean_metadata(spark, folder):
    return cleaning.clean_metadata(tables.items(spark, folder), _listed(spark, folder))[0]


@query(
    with_views(
        f"""SELECT name, address, gmap_id, url FROM it
        WHERE gmap_id IN {_LISTED} AND (address IS NULL OR url IS NULL)""",
        "rv",
        "it",
    )
)
def clean_metadata_rejects(spark, folder):
    return cleaning.clean_metadata(tables.items(spark, folder), _listed(spark, folder))[1]


@query(
    with_views(
        """SELECT rv.* FROM rv JOIN it USING (gmap_id) WHERE p_type = 'LARGE' AND address IS NOT NULL AND url IS NOT NULL
        AND gmap_id IN (SELECT gmap_id FROM rv GROUP BY gmap_id HAVING count(*) >= 30)""",
        "rv",
        "it",
    )
)
def cleaning_chain(spark, folder):
    """From raw lines of places and reviews to the reviews of one category's items with enough of them."""
    places, lines = new_path(spark, "places"), new_path(spark, "lines")
    tables.items(spark, folder).write.json(places)
    tables.reviews(spark, folder).write.json(lines)
    return clean(spark, places, lines, "LARGE", 30).reviews.select("user_id", "gmap_id", "rating", "time")


@query(
    with_views(
        "SELECT gmap_id, count(*) AS n_reviews FROM rv GROUP BY gmap_id HAVING count(*) < 30", "rv"
    )
)
def items_below(spark, folder):
    return ratings.items_below(tables.reviews(spark, folder), 30)


@query(with_views(f"SELECT * FROM rv WHERE gmap_id IN {_LISTED}", "rv"))
def drop_ids(spark, folder):
    reviews = tables.reviews(spark, folder)
    return cleaning.drop_ids(reviews, ratings.items_below(reviews, 30)).kept


@query(with_views(f"SELECT count(*) AS n_dropped FROM rv WHERE gmap_id NOT IN {_LISTED}", "rv"))
def drop_ids_count(spark, folder):
    reviews = tables.reviews(spark, folder)
    return cleaning.drop_ids(reviews, ratings.items_below(reviews, 30)).dropped


@query(with_views("SELECT gmap_id, name FROM it WHERE gmap_id IN (SELECT gmap_id FROM ev)", "it", "ev"))
def by_ids(spark, folder):
    clicked = tables.events(spark, folder)
    return cleaning.by_ids(tables.items(spark, folder).select("gmap_id", "name"), clicked)


@query(with_views("SELECT * FROM rv WHERE user_id IN ('7', '42')", "rv"))
def by_literal_ids(spark, folder):
    """The lookup by key: a short list of keys is the feature."""
    return cleaning.by_ids(tables.reviews(spark, folder), ["7", "42"], "user_id")


def _submitted(spark, folder):
    """Ratings as typed: order priorities and quantities as text, some with blanks or none at all."""
    lines = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)))
        .when(F.col("l_returnflag") == "N", quantity)
        .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(quantity, F.lit(".0")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(None).cast("string"))
        .otherwise("0")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("gmap_id"),
        text.alias("rating"),
    )


_SUBMITTED = """WITH typed AS (SELECT CAST(l_orderkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS gmap_id,
    CASE WHEN l_returnflag = 'A' THEN ' ' || substr(o_orderpriority, 1, 1)
    WHEN l_returnflag = 'N' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
    WHEN o_orderpriority = '5-LOW' THEN ''
    WHEN o_orderpriority = '1-URGENT' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0'
    WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE '0' END AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    _SUBMITTED
    + """SELECT user_id, gmap_id, CAST(trim(rating) AS INT) AS rating FROM typed
    WHERE regexp_full_match(trim(rating), '[1-5]')"""
)
def valid_ratings(spark, folder):
    return cleaning.validate_ratings(_submitted(spark, folder))[0]


@query(
    _SUBMITTED
    + f"""SELECT user_id, gmap_id, rating,
    CASE WHEN rating IS NULL OR rating = '' THEN '{scalars.MISSING_FIELD}'
    WHEN contains(rating, '.') THEN '{scalars.NOT_A_NUMBER}' ELSE '{scalars.OUT_OF_RANGE}' END AS reason
    FROM typed WHERE rating IS NULL OR NOT regexp_full_match(trim(rating), '[1-5]')"""
)
def rejected_ratings(spark, folder):
    return cleaning.validate_ratings(_submitted(spark, folder))[1]


@query(
    """SELECT c_name AS user_id, false AS valid FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), true FROM customer"""
)
def valid_user_ids(spark, folder):
    customer = tables.table(spark, folder, "customer")
    texts = customer.select(F.explode(F.array("c_name", F.col("c_custkey").cast("string"))).alias("user_id"))
    return texts.withColumn("valid", scalars.valid_user_id("user_id"))


@query(
    """SELECT CAST(page_id AS VARCHAR) AS gmap_id, coalesce(list_filter(
    regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: contains(x, '/') AND contains(x, 'an'))[1], 'none') AS url
    FROM pages"""
)
def page_image_url(spark, folder):
    """The test pages have links but no images, so the links are searched."""
    pages = tables.pages(spark, folder)
    url = scalars.first_matching_url("html", ["/", "an"], "none", scalars.LINK_HREF)
    return pages.select("gmap_id", url.alias("url"))


@query(
    """SELECT CAST(page_id AS VARCHAR) AS gmap_id,
    'https://lh5.googleusercontent.com/p/' || CAST(page_id AS VARCHAR) || '?w=1&h=2' AS url FROM pages"""
)
def page_image_src(spark, folder):
    """Pages under an image that is loaded late: the url to load is the real source, not the late one."""
    own = F.concat(F.lit("https://lh5.googleusercontent.com/p/"), F.col("gmap_id"), F.lit("?w=1&amp;h=2"))
    late = '<img alt="5 > 4, src=x" data-src="https://lh5.googleusercontent.com/late" src='
    odd = F.col("gmap_id").cast("bigint") % 2 == 1
    image = F.concat(F.lit(late), F.when(odd, own).otherwise(F.concat(F.lit("'"), own, F.lit("'"))), F.lit(" >"))
    pages = tables.pages(spark, folder).select("gmap_id", F.concat(F.col("html"), image).alias("html"))
    return pages.select("gmap_id", scalars.first_matching_url("html", scalars.IMAGE_URL_PARTS, None).alias("url"))


@query(
    """SELECT CAST(page_id AS VARCHAR) AS gmap_id, CASE WHEN page_id % 5 < 3 THEN
    'https://lh5.googleusercontent.com/p/' || CAST(page_id AS VARCHAR) ELSE 'none' END AS img_url FROM pages"""
)
def filled_page_images(spark, folder):
    """Items without an image, filled from their pages behind a very long tag: 200,000 plain characters, or
    50,000 attributes, or a late source; a tag with an open quote, and one without a source, give nothing."""
    pages = tables.pages(spark, folder)
    own = F.concat(F.lit(" src="), F.lit('"https://lh5.googleusercontent.com/p/'), F.col("gmap_id"), F.lit('">'))
    long = F.array(
        F.concat(F.lit("<img "), F.repeat(F.lit("x"), F.lit(200_000)), own),
        F.concat(F.lit("<IMG"), F.repeat(F.lit(" a='>'"), F.lit(50_000)), own),
        F.concat(F.lit('<img data-src="https://lh5.googleusercontent.com/late"'), F.repeat(F.lit(" "), F.lit(100_000)), own),
        F.concat(F.lit('<img alt="'), F.repeat(F.lit("y "), F.lit(100_000)), F.lit(" src=https://lh5.googleusercontent.com/p")),
        F.concat(F.lit("<img "), F.repeat(F.lit("z"), F.lit(200_000)), F.lit(">")),
    )
    kind = F.pmod(F.col("gmap_id").cast("int"), F.lit(5))
    pages = pages.select("gmap_id", F.concat("html", F.get(long, kind)).alias("html"))
    items = pages.select("gmap_id", F.lit(None).cast("string").alias("img_url"))
    return cleaning.fill_images(items, pages, "none")


@query(
    """SELECT CAST(page_id AS VARCHAR) AS gmap_id,
    CASE WHEN contains(url, '/fr/') THEN url ELSE coalesce(list_filter(
    regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: contains(x, 'au'))[1], 'none') END AS img_url FROM pages"""
)
def filled_images(spark, folder):
    """French pages stand for items that have their image already."""
    pages = tables.pages(spark, folder)
    items = pages.select("gmap_id", F.when(F.contains("url", F.lit("/fr/")), F.col("url")).alias("img_url"))
    return cleaning.fill_images(items, pages, "none", ["au"], scalars.LINK_HREF)
