import datetime as dt
import json

from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.operators import engagement
from tablewise.sources import events as source
from tablewise.streaming import engagement as stream
from tablewise.streaming import sinks

EVENTS = "event_type string, user_id string, gmap_id string, ts timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def test_decode_unwrap_and_event_time(spark):
    broker = at(0)
    rows = [
        (json.dumps({"event_type": "user_entered", "user_id": "1", "entering_time": "2024-01-02T03:04:05.678901+00:00"}), broker),
        (json.dumps({"event_type": "url_click", "user_id": "1", "gmap_id": "a"}), broker),
        (json.dumps({"event_type": "user_exited", "user_id": "1", "exiting_time": "nonsense"}), broker),
        ("{oops", broker),
    ]
    events, rejects = source.decode_events(spark.createDataFrame(rows, "value string, timestamp timestamp"))
    assert [r.value for r in rejects.collect()] == ["{oops"]
    ms = {r.event_type: r.ms for r in source.event_time(events).withColumn("ms", F.unix_millis("ts")).collect()}
    broker_ms = int(broker.timestamp() * 1000)
    assert ms["url_click"] == ms["user_exited"] == broker_ms
    assert ms["user_entered"] == int(dt.datetime(2024, 1, 2, 3, 4, 5, 678901, dt.timezone.utc).timestamp() * 1000)

    batch = json.dumps({"events": [{"event_type": "url_click", "user_id": "1"}, {"event_type": "user_exited", "user_id": "2"}]})
    wrapped = spark.createDataFrame([(batch,)], "value string")
    events, rejects = source.unwrap_batches(wrapped)
    assert [(r.event_type, r.user_id) for r in events.collect()] == [("url_click", "1"), ("user_exited", "2")]
    assert rejects.count() == 0
    odd = ['{"event_type": "url_click"}', '{"events": [{"event_type": "x"}', '{"events": [null]}', '{"events": null}', "7"]
    events, rejects = source.unwrap_batches(spark.createDataFrame([(v,) for v in [*odd, '{"events": []}']], "value string"))
    assert events.count() == 0 and {r.value for r in rejects.collect()} == set(odd)


def test_topic_batches_are_due_by_size_or_time_and_have_no_ceiling():
    options = source.topic_options("host:9092", "clicks", failOnDataLoss="false")
    assert (options["minOffsetsPerTrigger"], options["maxTriggerDelay"]) == ("1000", "300s")
    assert options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "false"
    assert not any(k.startswith("maxOffsets") for k in options)
    assert "maxTriggerDelay" not in source.topic_options("host:9092", "clicks", min_events=None)


def test_ingest_in_batches_and_replay(spark, tmp_path):
    inbox, table, offsets = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "offsets")
    inbox.mkdir()
    for n in range(3):
        lines = [json.dumps({"event_type": "url_click", "user_id": str(n), "gmap_id": str(k)}) for k in range(4)]
        (inbox / f"{n}.json").write_text("\n".join([*lines, "{bad"]))
    for _ in range(2):
        raw = source.read_line_files(spark, str(inbox), max_files=1)
        sinks.ingest_events(raw, table, offsets, available_now=True).awaitTermination()
    schema = f"timestamp timestamp, {schemas.EVENT}"
    events, rejects = sinks.read_ingested(spark, table, schema)
    assert events.count() == 12 and rejects.count() == 3
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 3


def visits_of(df):
    base = int(at(0).timestamp() * 1000)
    return sorted((r.user_id, (r.start_ms - base) / 60000, (r.last_ms - base) / 60000, r.n_events, r.n_clicks) for r in df.collect())


def test_visits_split_at_the_gap(spark):
    rows = [("user_entered", "u", None, at(m)) for m in (0, 29, 58, 88, 200)]
    rows += [("url_click", "u", "a", at(201)), ("url_click", "v", "a", at(29.5))]
    got = visits_of(engagement.visits(spark.createDataFrame(rows, EVENTS)))
    assert got == [("u", 0, 58, 3, 0), ("u", 88, 88, 1, 0), ("u", 200, 201, 2, 1), ("v", 29.5, 29.5, 1, 1)]


def test_engaged_clicks_count_once(spark):
    rows = [("user_entered", "u", None, at(m)) for m in (0, 1, 50, 119)]
    rows += [("url_click", "u", f"c{m}", at(m)) for m in (0, 60, 110, 111, 118, 179, 180)]
    rows += [("url_click", "v", "no", at(5)), ("url_click", "u", "before", at(-1))]
    got = {r.gmap_id for r in engagement.engaged_clicks(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"c0", "c60", "c110", "c179"}
    assert engagement.engaged_clicks(spark.createDataFrame(rows, EVENTS)).count() == 4


def test_click_through_per_day(spark):
    rows = [("user_entered", u, None, at(0)) for u in "uvw"] + [("url_click", "u", "a", at(1)), ("url_click", "u", "b", at(2))]
    rows += [("url_click", "x", "b", at(60 * 24))]
    got = [(r.users_entered, r.users_clicked, r.click_through) for r in engagement.click_through(spark.createDataFrame(rows, EVENTS)).orderBy("day").collect()]
    assert got == [(3, 1, 1 / 3), (0, 1, None)]


def test_drained_stream_equals_batch(spark, tmp_path):
    """Files in time order, one per batch; a late far event closes every window."""
    rows = [(k, "u" + str(n % 3), "a", at(n * 7 % 600)) for n in range(90) for k in [("user_entered", "url_click", "user_exited")[n // 3 % 3]]]
    rows.sort(key=lambda r: r[3])
    end = [(k, "end", None, at(60 * 24 * 9)) for k in ("user_entered", "url_click")]
    folder = str(tmp_path / "events")
    for n in range(3):
        part = rows[n * 30 : (n + 1) * 30] + (end if n == 2 else [])
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    batch = spark.createDataFrame(rows, EVENTS)

    def drained(make, name):
        raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        out = str(tmp_path / name)
        query = make(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-o")
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(make(batch).schema).parquet(out)

    assert visits_of(drained(stream.session_visits, "visits")) == visits_of(engagement.visits(batch))
    clicks = drained(stream.engaged_clicks, "engaged")
    key = lambda r: (r.user_id, r.gmap_id, r.click_ms)
    assert sorted(map(key, clicks.where("user_id <> 'end'").collect())) == sorted(map(key, engagement.engaged_clicks(batch).collect()))
    through = drained(stream.windowed_click_through, "through").collect()
    assert [(r.users_entered, r.users_clicked) for r in through] == [(3, 3)]
