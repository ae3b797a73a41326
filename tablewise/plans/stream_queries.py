"""Events, engagement and review changes, in batch and as drained streams."""

from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.operators import changes, clustering, engagement, ratings, reach
from tablewise.plans import clustering_queries as cq
from tablewise.plans import tables
from tablewise.plans.registry import query
from tablewise.plans.tables import with_views
from tablewise.shared import new_path, stored
from tablewise.sources import events as event_source
from tablewise.sources import scans
from tablewise.streaming import engagement as stream
from tablewise.streaming import nested
from tablewise.streaming import reviews as review_stream
from tablewise.streaming import sinks


def _raw(events):
    """Records of a topic: clicks carry no time, error events are cut short."""
    kind = F.col("event_type")
    iso = F.date_format(F.from_utc_timestamp(F.col("ts"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    text = F.to_json(
        F.struct(
            "event_type",
            "user_id",
            F.when(kind == engagement.CLICKED, F.col("gmap_id")).alias("gmap_id"),
            F.when(kind == engagement.ENTERED, iso).alias("entering_time"),
            F.when(kind == engagement.EXITED, iso).alias("exiting_time"),
        )
    )
    return events.select(
        F.when(kind == "error", F.substring(text, 1, 20)).otherwise(text).alias("value"),
        F.col("ts").alias("timestamp"),
    )


def _event_stream(spark, folder):
    schema = tables.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return tables.as_events(raw)


def _drain(df, label):
    """Run an append-mode stream over all there is into a table and read that."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    writer.option("checkpointLocation", path + "-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query(
    with_views(
        """SELECT event_type, user_id, CASE WHEN event_type = 'url_click' THEN gmap_id END AS gmap_id, ms FROM ev
        WHERE event_type <> 'error'""",
        "ev",
    )
)
def ingested_events(spark, folder):
    """Topic records to the events table and back, with their event time."""
    path = new_path(spark, "events")
    job = sinks.ingest_events(_raw(_event_stream(spark, folder)), path, path + "-offsets", available_now=True)
    job.awaitTermination()
    events, _ = sinks.read_ingested(spark, path, f"timestamp timestamp, {schemas.EVENT}")
    timed = event_source.event_time(events)
    return timed.select("event_type", "user_id", "gmap_id", F.unix_millis("ts").alias("ms"))


@query(
    with_views(
        """SELECT event_type, user_id, CASE WHEN event_type = 'url_click' THEN gmap_id END AS gmap_id, ms FROM
        (SELECT DISTINCT event_type, user_id, CASE WHEN event_type = 'url_click' THEN gmap_id END AS gmap_id, ms FROM ev
        WHERE event_type <> 'error')""",
        "ev",
    )
)
def events_sent_twice(spark, folder):
    """Every record comes twice, the second time in another batch; each is taken once."""
    inbox, path = new_path(spark, "inbox"), new_path(spark, "events")
    raw = _raw(tables.events(spark, folder))
    for n, order in enumerate(("value", "timestamp")):
        raw.orderBy(order).coalesce(1).write.parquet(f"{inbox}/part={n}")
    stream_ = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{inbox}/part=*")
    # the given events span a month; a sender tries again for minutes
    job = sinks.ingest_events(stream_, path, path + "-offsets", available_now=True, resent_within="60 days")
    job.awaitTermination()
    events, _ = sinks.read_ingested(spark, path, f"timestamp timestamp, {schemas.EVENT}")
    timed = event_source.event_time(events)
    return timed.select("event_type", "user_id", "gmap_id", F.unix_millis("ts").alias("ms"))


@query(
    with_views(
        """SELECT substr('{"event_type":"error","user_id":"' || user_id, 1, 20) AS value, count(*) AS n FROM ev
        WHERE event_type = 'error' GROUP BY ALL""",
        "ev",
    )
)
def rejected_events(spark, folder):
    _, rejects = event_source.decode_events(_raw(tables.events(spark, folder)))
    return rejects.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT event_type, user_id, gmap_id, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def unwrapped_batches(spark, folder):
    """Events sent as one batch per user and hour, one row per event again."""
    events = tables.events(spark, folder)
    entry = F.struct("event_type", "user_id", "gmap_id")
    hour = F.floor(F.unix_millis("ts") / 3_600_000).alias("hour")
    wrapped = events.groupBy("user_id", hour).agg(F.to_json(F.struct(F.collect_list(entry).alias("events"))).alias("value"))
    rows, _ = event_source.unwrap_batches(wrapped.select("value"))
    return rows.groupBy("event_type", "user_id", "gmap_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        """SELECT CASE WHEN event_type = 'error' THEN '{"events":[{"event_type":"er'
        ELSE '{"event_type":"' || event_type || '"}' END AS value, count(*) AS n FROM ev
        WHERE event_type IN ('error', 'url_click') GROUP BY ALL""",
        "ev",
    )
)
def rejected_batches(spark, folder):
    """Error events as batches cut short, clicks bare and without their wrapper, others as they should be."""
    kind = F.col("event_type")
    bare = F.to_json(F.struct("event_type"))
    whole = F.concat(F.lit('{"events":['), bare, F.lit("]}"))
    value = F.when(kind == "error", F.substring(whole, 1, 28)).when(kind == engagement.CLICKED, bare).otherwise(whole)
    _, rejects = event_source.unwrap_batches(tables.events(spark, folder).select(value.alias("value")))
    return rejects.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        """SELECT gmap_id, count(*) AS n_clicks FROM ev WHERE event_type = 'url_click' GROUP BY gmap_id
        ORDER BY n_clicks DESC, gmap_id LIMIT 25""",
        "ev",
    )
)
def clicks_per_item(spark, folder):
    return engagement.clicks_per_item(tables.events(spark, folder), 25)


@query(
    with_views(
        """SELECT CAST(ms // 86400000 AS INT) AS day,
        count(DISTINCT CASE WHEN event_type = 'user_entered' THEN user_id END) AS users_entered,
        count(DISTINCT CASE WHEN event_type = 'url_click' THEN user_id END) AS users_clicked,
        round(count(DISTINCT CASE WHEN event_type = 'url_click' THEN user_id END) /
        CAST(count(DISTINCT CASE WHEN event_type = 'user_entered' THEN user_id END) AS DOUBLE), 6) AS click_through
        FROM ev GROUP BY day""",
        "ev",
    )
)
def click_through(spark, folder):
    return engagement.click_through(tables.events(spark, folder)).withColumn("click_through", F.round("click_through", 6))


@query(
    with_views(
        """WITH weeks AS (SELECT w, (SELECT min(ms) FROM ev) // 3600000 + 168 * w AS first_hour FROM (SELECT unnest(range(6)) AS w)),
        spans AS (SELECT w, first_hour, first_hour + 24 * (w + 4) AS end_hour FROM weeks),
        seen AS (SELECT w, user_id, bool_or(event_type = 'user_entered') AS e, bool_or(event_type = 'url_click') AS c FROM spans JOIN ev
        ON ms // 3600000 >= first_hour AND ms // 3600000 < end_hour GROUP BY ALL)
        SELECT s.w, first_hour, end_hour, count(*) FILTER (e) AS users_entered, count(*) FILTER (c) AS users_clicked,
        count(*) FILTER (e AND c) AS users_both, count(*) FILTER (e AND NOT c) AS users_without_click
        FROM spans s LEFT JOIN seen ON seen.w = s.w GROUP BY ALL""",
        "ev",
    )
)
def reach_of_ranges(spark, folder):
    """Overlapping ranges of days from hourly sketches that came in two batches; the last has no events."""
    events = tables.events(spark, folder)
    path = new_path(spark, "sketches")
    for n in range(2):
        sinks.append_batch(reach.hourly_sketches(events.where(F.unix_millis("ts") % 2 == n)), n, path)
    sketches = spark.read.parquet(path).drop("batch_id")
    first = events.agg(F.floor(F.min(F.unix_millis("ts")) / 3_600_000)).first()[0]
    ranges = spark.range(6).select(
        F.col("id").alias("w"),
        (F.lit(first) + 168 * F.col("id")).alias("first_hour"),
        (F.lit(first) + 168 * F.col("id") + 24 * (F.col("id") + 4)).alias("end_hour"),
    )
    return reach.reach(sketches, ranges)


_VISITS = """WITH marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 1800000
    THEN 0 ELSE 1 END AS opens FROM ev),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS visit FROM marked),
    visits AS (SELECT user_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n_events,
    count(*) FILTER (event_type = 'url_click') AS n_clicks FROM numbered GROUP BY user_id, visit)"""


@query(with_views(_VISITS + " SELECT * FROM visits", "ev"))
def visits(spark, folder):
    return engagement.visits(tables.events(spark, folder))


_CLOSED = "(SELECT max(ms) - 600000 FROM ev)"


@query(with_views(_VISITS + f" SELECT * FROM visits WHERE last_ms + 1800000 <= {_CLOSED}", "ev"))
def streamed_visits(spark, folder):
    """The visits that the watermark has closed."""
    return _drain(stream.session_visits(_event_stream(spark, folder)), "visits")


@query(
    with_views(
        """SELECT hour * 3600000 AS start_ms, (hour + 1) * 3600000 AS end_ms, gmap_id, count(*) AS n_clicks
        FROM (SELECT gmap_id, ms // 3600000 AS hour FROM ev WHERE event_type = 'url_click')
        WHERE (hour + 1) * 3600000 <= (SELECT max(ms) - 600000 FROM ev WHERE event_type = 'url_click') GROUP BY hour, gmap_id""",
        "ev",
    )
)
def streamed_clicks(spark, folder):
    return _drain(stream.windowed_clicks(_event_stream(spark, folder)), "clicks")


@query(
    with_views(
        """SELECT day * 86400000 AS start_ms, (day + 1) * 86400000 AS end_ms, users_entered, users_clicked,
        round(users_clicked / CAST(users_entered AS DOUBLE), 6) AS click_through FROM (SELECT ms // 86400000 AS day,
        count(DISTINCT CASE WHEN event_type = 'user_entered' THEN user_id END) AS users_entered,
        count(DISTINCT CASE WHEN event_type = 'url_click' THEN user_id END) AS users_clicked FROM ev GROUP BY day)
        WHERE (day + 1) * 86400000 <= (SELECT max(ms) - 600000 FROM ev)""",
        "ev",
    )
)
def streamed_click_through(spark, folder):
    """The days that the watermark has closed."""
    rows = _drain(stream.windowed_click_through(_event_stream(spark, folder)), "click-through")
    return rows.withColumn("click_through", F.round("click_through", 6))


_ENGAGED = """SELECT user_id, gmap_id, ms AS click_ms FROM ev c WHERE event_type = 'url_click' AND EXISTS
    (SELECT 1 FROM ev e WHERE e.event_type = 'user_entered' AND e.user_id = c.user_id
    AND c.ms BETWEEN e.ms AND e.ms + 3600000)"""


@query(with_views(_ENGAGED, "ev"))
def engaged_clicks(spark, folder):
    return engagement.engaged_clicks(tables.events(spark, folder))


@query(with_views(_ENGAGED, "ev"))
def streamed_engaged_clicks(spark, folder):
    return _drain(stream.engaged_clicks(_event_stream(spark, folder)), "engaged")


def _stored_and_changed(spark, folder):
    """Returned lines are stored reviews; all lines are changes: accepted ones add, returned ones
    delete, the others update."""
    lines = tables.table(spark, folder, "lineitem")
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    flag = F.col("l_returnflag")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.when(flag == "A", "add")
        .when((flag == "R") & (F.col("o_orderpriority") == "1-URGENT"), "delete")
        .otherwise("update")
        .alias("op"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("gmap_id"),
        F.substring("o_orderpriority", 1, 1).alias("rating"),
        tables.millis("l_shipdate").alias("time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        flag.alias("flag"),
    )
    base = rows.where("flag = 'R'").groupBy("user_id", "gmap_id").agg(
        F.max("time").alias("time"), F.lit(3).alias("rating")
    )
    # the stored reviews are read more than once
    return stored(base.select("user_id", "gmap_id", "rating", "time"), "base"), rows.drop("flag")


_CHANGED = """WITH ch AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'add'
    WHEN l_returnflag = 'R' AND o_orderpriority = '1-URGENT' THEN 'delete' ELSE 'update' END AS op,
    CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS gmap_id,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating, epoch_ms(l_shipdate) AS time,
    l_orderkey * 8 + l_linenumber AS seq, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    base AS (SELECT user_id, gmap_id, 3 AS rating, max(time) AS time FROM ch WHERE l_returnflag = 'R' GROUP BY ALL),
    firm AS (SELECT *, row_number() OVER (PARTITION BY user_id, gmap_id ORDER BY time DESC, seq DESC, op DESC) AS rn
    FROM ch WHERE op <> 'update'),
    put AS (SELECT *, row_number() OVER (PARTITION BY user_id, gmap_id ORDER BY time DESC, seq DESC, rating DESC) AS rn
    FROM ch WHERE op <> 'delete'),
    after AS (SELECT user_id, gmap_id, rating, time FROM base b WHERE NOT EXISTS (SELECT 1 FROM ch
    WHERE ch.user_id = b.user_id AND ch.gmap_id = b.gmap_id)
    UNION ALL SELECT p.user_id, p.gmap_id, p.rating, p.time FROM put p
    LEFT JOIN firm f ON f.user_id = p.user_id AND f.gmap_id = p.gmap_id AND f.rn = 1
    WHERE p.rn = 1 AND coalesce(f.op, 'update') <> 'delete' AND (f.op = 'add' OR EXISTS
    (SELECT 1 FROM base b WHERE b.user_id = p.user_id AND b.gmap_id = p.gmap_id)))"""


@query(_CHANGED + "SELECT * FROM after")
def applied_changes(spark, folder):
    base, rows = _stored_and_changed(spark, folder)
    valid, _ = changes.check_changes(rows)
    return changes.apply_changes(base, valid).reviews


@query(
    _CHANGED
    + """SELECT p.user_id, p.gmap_id, p.time, p.seq, p.rating FROM ch p LEFT JOIN firm f ON f.user_id = p.user_id
    AND f.gmap_id = p.gmap_id AND f.rn = 1 WHERE p.op = 'update' AND
    ((f.op = 'delete' AND (p.time, p.seq) > (f.time, f.seq)) OR (f.op IS NULL AND NOT EXISTS
    (SELECT 1 FROM base b WHERE b.user_id = p.user_id AND b.gmap_id = p.gmap_id)))"""
)
def rejected_updates(spark, folder):
    base, rows = _stored_and_changed(spark, folder)
    valid, _ = changes.check_changes(rows)
    rejects = changes.apply_changes(base, valid).rejects
    return rejects.select("user_id", "gmap_id", "time", "seq", "rating")


@query(
    _CHANGED
    + """SELECT gmap_id, coalesce(n, 0) AS "Reviews", coalesce(mean, 0.0) AS "Rating" FROM
    (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS gmap_id FROM part) i
    LEFT JOIN (SELECT gmap_id AS g, count(*) AS n, round_even(avg(rating), 1) AS mean FROM after GROUP BY ALL) s ON g = gmap_id
    WHERE gmap_id IN (SELECT gmap_id FROM ch)"""
)
def refreshed_item_stats(spark, folder):
    base, rows = _stored_and_changed(spark, folder)
    valid, _ = changes.check_changes(rows)
    after = changes.apply_changes(base, valid).reviews
    items = tables.items(spark, folder).select("gmap_id")
    return changes.refresh_item_stats(items, after, valid).select("gmap_id", "Reviews", "Rating")


def _inbox(rows, inbox, n):
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{inbox}/part={n}")


@query(_CHANGED + "SELECT user_id, gmap_id, rating, time FROM after")
def streamed_nested_ratings(spark, folder):
    """The users' lists after what they had rated and four batches of changes by time, flat again."""
    base, rows = _stored_and_changed(spark, folder)
    inbox, path = new_path(spark, "inbox"), new_path(spark, "lists")
    _inbox(base.select("user_id", "gmap_id", F.lit("add").alias("op"), "rating", "time", F.lit(0).alias("seq")), inbox, 0)
    ends = [*rows.agg(F.percentile_approx("time", [0.25, 0.5, 0.75])).first()[0], None]
    start = F.lit(True)
    for n, end in enumerate([None, *ends]):
        if n:
            _inbox(rows.where(start if end is None else start & (F.col("time") <= end)), inbox, n)
            start = F.col("time") > end if end is not None else start
        raw = event_source.read_line_files(spark, f"{inbox}/part=*")
        nested.nested_job(raw, path, path + "-offsets", parts=2, available_now=True).awaitTermination()
    lists = nested.current_lists(spark, path)
    return lists.select("user_id", F.explode("ratings").alias("r")).select("user_id", "r.gmap_id", "r.rating", F.col("r.timestamp").alias("time"))


def _run_changes(spark, folder, model=None, batches=1):
    """The store after all changes came through the stream, in batches by time, folded every second."""
    base, rows = _stored_and_changed(spark, folder)
    rows = stored(rows, "changes")
    root, inbox = new_path(spark, "store"), new_path(spark, "inbox")
    review_stream.init_store(base, root, parts=8, slices=1)
    ends = [None]
    if batches > 1:
        shares = [k / batches for k in range(1, batches)]
        ends = [*rows.agg(F.percentile_approx("time", shares)).first()[0], None]
    start = F.lit(True)
    for n, end in enumerate(ends):
        part = rows.where(start if end is None else start & (F.col("time") <= end))
        start = start if end is None else F.col("time") > end
        part.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.option("compression", "gzip").text(f"{inbox}/part={n}")
        raw = event_source.read_line_files(spark, f"{inbox}/part=*")
        review_stream.change_job(
            raw, root, root + "/offsets", model, available_now=True, fold_every=2
        ).awaitTermination()
    return root


@query(_CHANGED + "SELECT * FROM after")
def streamed_changes(spark, folder):
    """Four batches with a fold in between: batches by time end where all changes at once do."""
    return review_stream.current_reviews(spark, _run_changes(spark, folder, batches=4))


@query(
    _CHANGED
    + """SELECT gmap_id, count(rating) AS "Reviews", coalesce(round_even(avg(rating), 1), 0.0) AS "Rating"
    FROM (SELECT gmap_id FROM base UNION SELECT gmap_id FROM after) LEFT JOIN after USING (gmap_id) GROUP BY gmap_id"""
)
def streamed_item_stats(spark, folder):
    return review_stream.current_item_stats(spark, _run_changes(spark, folder, batches=4))


@query(
    with_views(
        _CHANGED
        + ", "
        + ", ".join(
            [
                "vec AS (SELECT user_id, gmap_id, CAST(rating AS DOUBLE) AS rating FROM after)",
                "warm AS (SELECT DISTINCT user_id FROM after)",
                cq._start(cq.K),
                cq._assigned(0, cq.K),
                cq._updated(0),
                cq._LISTED,
                cq._assigned(1, cq.K, "vec", "warm", name="served"),
            ]
        )
        + """ SELECT user_id, CAST(rank - 1 AS INT) AS pos, gmap_id, round(score, 6) AS score FROM (SELECT t.user_id, l.gmap_id,
        l.score, row_number() OVER (PARTITION BY t.user_id ORDER BY l.score DESC, l.gmap_id) AS rank
        FROM served1 t JOIN listed l USING (cluster_id)
        WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.user_id = t.user_id AND a.gmap_id = l.gmap_id)) WHERE rank <= 13""",
        "mean_rv",
        "us",
    )
)
def streamed_recommendations(spark, folder):
    """Lists of the touched users after the changes, the trained ones of the others."""
    pairs, assigned = cq._first_round(spark, folder)
    assigned = stored(assigned, "assigned")
    lists = clustering.cluster_lists(clustering.cluster_recommendations(pairs, assigned), cq.K)
    model = review_stream.Model(stored(clustering.update_centroids(pairs, assigned), "centroids"), stored(lists, "lists"), cq.K)
    top = ratings.mean_ratings(tables.reviews(spark, folder)).groupBy("user_id").agg(
        F.array(F.struct(F.max_by("gmap_id", "rating").alias("gmap_id"), F.max("rating").alias("score"))).alias("recommendations")
    )
    root = _run_changes(spark, folder, model, batches=4)
    merged = review_stream.current_recommendations(spark, root, top)
    listed = merged.select("user_id", F.posexplode("recommendations").alias("pos", "r"))
    return listed.select("user_id", "pos", "r.gmap_id", F.round("r.score", 6).alias("score"))


@query(
    with_views(
        """WITH ends AS (SELECT user_id, max(gmap_id) AS high, min(gmap_id) AS low FROM rv GROUP BY user_id)
        SELECT rv.user_id, gmap_id, CASE WHEN gmap_id = high THEN 5 ELSE rating END AS rating FROM rv JOIN ends USING (user_id)
        WHERE gmap_id <> low OR low = high UNION ALL SELECT user_id, 'new', 4 FROM ends""",
        "rv",
    )
)
def edited_nested_ratings(spark, folder):
    """Chunks of 20 ratings. Of every user the largest item id is rated 1 and then 5, the smallest one
    rated and then removed, a new one added."""
    # read several times, each of which would join the tables again
    reviews = stored(tables.reviews(spark, folder), "reviews")
    nested = stored(ratings.nest_users(reviews, chunk_rows=20), "nested")
    ends = reviews.groupBy("user_id").agg(F.max("gmap_id").alias("high"), F.min("gmap_id").alias("low"))
    ends = stored(ends, "ends")

    def change(op, item, rating, seq, rows=ends):
        cells = [F.lit(op).alias("op"), item.alias("gmap_id"), F.lit(rating).cast("int").alias("rating")]
        return rows.select("user_id", *cells, F.lit(0).cast("bigint").alias("time"), F.lit(seq).alias("seq"))

    apart = ends.where("high <> low")
    batch = change("add", F.col("high"), 1, 1).unionByName(change("add", F.col("high"), 5, 2))
    batch = batch.unionByName(change("update", F.col("low"), 2, 1, apart))
    batch = batch.unionByName(change("delete", F.col("low"), None, 2, apart))
    batch = batch.unionByName(change("add", F.lit("new"), 4, 3))
    return ratings.flat_ratings(changes.edit_ratings(nested, batch)).select("user_id", "gmap_id", "rating")


@query(
    with_views(
        """SELECT gmap_id, count(*) AS n_events FROM ev WHERE event_type = 'url_click' GROUP BY gmap_id""", "ev"
    )
)
def appended_batches(spark, folder):
    """Two batches appended, the second one twice as after a failure."""
    path = new_path(spark, "analytics")
    clicks = tables.events(spark, folder).where(engagement.is_click())
    early = F.unix_millis("ts") % 2 == 0
    sinks.append_batch(clicks.where(early), 0, path)
    for _ in range(2):
        sinks.append_batch(clicks.where(~early), 1, path)
    rows = scans.read_table(spark, path, "gmap_id string, batch_id bigint")
    return rows.groupBy("gmap_id").agg(F.count(F.lit(1)).alias("n_events"))
