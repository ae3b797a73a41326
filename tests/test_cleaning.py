import json
import time

import pytest

from tablewise import schemas, shared
from tablewise.functions import scalars
from tablewise.operators import cleaning, explore
from tablewise.plans.cleaning_chain import clean
from tablewise.sources import scans, sinks

LINES = [
    '{"gmap_id":"a","name":"A","address":"x","url":"u","category":["Restaurant"]}',
    "",
    "   ",
    "{bad",
    '{"gmap_id":"b","name":"B","address":"x","url":"u","category":null}',
    '{"gmap_id":"c","name":"C","address":"x","url":"u"}',
    '{"gmap_id":"d","name":"D","address":"x","category":["Bar","Restaurant"]}',
    '{"gmap_id":"e","name":"E","address":"x","url":"u","category":["Restaurant supply store"]}',
    '{"gmap_id":"f"} and more',
    '{"gmap_id":"g"}{"gmap_id":"h"}',
    "5",
    "[1]",
]
BAD = {"{bad", '{"gmap_id":"f"} and more', '{"gmap_id":"g"}{"gmap_id":"h"}', "5", "[1]"}


def ids(df, column="gmap_id"):
    return sorted(r[0] for r in df.select(column).collect())


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("staged", [False, True])
def test_ndjson_keeps_good_lines_and_reports_bad_ones(spark, tmp_path, staged):
    path = write(tmp_path, "meta.json", "\n".join(LINES))
    target = str(tmp_path / "staged") if staged else None
    rows, rejects = scans.read_ndjson(spark, path, schemas.RAW_METADATA, staged=target)
    assert ids(rows) == ["a", "b", "c", "d", "e"]
    assert {r.value for r in rejects.collect()} == BAD
    assert rejects.count() == len(BAD)


def test_json_arrays_and_id_arrays(spark, tmp_path):
    path = write(tmp_path, "reviews.json", json.dumps([{"user_id": "1", "rating": 4}, {"user_id": "2"}], indent=4))
    rows = scans.read_json_array(spark, path, schemas.RAW_REVIEWS)
    assert [(r.user_id, r.rating) for r in rows.orderBy("user_id").collect()] == [("1", 4), ("2", None)]
    deny = write(tmp_path, "ids.json", json.dumps(["a", "b", "a"], indent=1))
    assert ids(scans.read_json_id_array(spark, deny)) == ["a", "b"]


def test_id_list_is_trimmed_and_distinct(spark, tmp_path):
    path = write(tmp_path, "ids", " a \nb\na\n")
    assert ids(scans.read_ids(spark, path)) == ["a", "b"]


def test_category_must_match_an_entry_exactly(spark, tmp_path):
    path = write(tmp_path, "meta.json", "\n".join(LINES))
    rows, _ = scans.read_ndjson(spark, path, schemas.RAW_METADATA)
    assert ids(cleaning.ids_with_category(rows, "Restaurant")) == ["a", "d"]
    counts = {r.category: r.n_items for r in explore.top_categories(rows, 2).collect()}
    assert counts == {"Restaurant": 2, "Bar": 1}


def test_metadata_without_a_field_is_a_reject(spark):
    raw = spark.createDataFrame(
        [("a", "A", "x", "u", None), ("b", "B", "x", None, None), (None, "C", "x", "u", None), ("z", None, None, None, None)],
        schemas.RAW_METADATA,
    )
    listed = spark.createDataFrame([("a",), ("b",)], "gmap_id string")
    rows, rejects = cleaning.clean_metadata(raw, listed)
    assert ids(rows) == ["a"]
    assert {r.name for r in rejects.collect()} == {"B", "C"}


def test_deny_list_reports_what_it_dropped(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "gmap_id string")
    kept, dropped = cleaning.drop_ids(df, spark.createDataFrame([("a",)], "gmap_id string"))
    assert ids(kept) == ["b"]
    assert dropped.first().n_dropped == 2


@pytest.mark.parametrize(
    "text, rating, reason",
    [
        ("1", 1, None),
        ("5", 5, None),
        (" 4 ", 4, None),
        ("+3", 3, None),
        ("0", None, scalars.OUT_OF_RANGE),
        ("6", None, scalars.OUT_OF_RANGE),
        ("-1", None, scalars.OUT_OF_RANGE),
        ("99999999999999999999", None, scalars.OUT_OF_RANGE),
        ("4.0", None, scalars.NOT_A_NUMBER),
        ("x", None, scalars.NOT_A_NUMBER),
        ("  ", None, scalars.NOT_A_NUMBER),
        ("", None, scalars.MISSING_FIELD),
        (None, None, scalars.MISSING_FIELD),
    ],
)
def test_rating_text(spark, text, rating, reason):
    df = spark.createDataFrame([("i", text)], "gmap_id string, rating string")
    valid, rejected = cleaning.validate_ratings(df)
    assert [r.rating for r in valid.collect()] == ([] if rating is None else [rating])
    assert [r.reason for r in rejected.collect()] == ([] if reason is None else [reason])


def test_user_ids_are_digits(spark):
    df = spark.createDataFrame([("123",), ("12a",), ("",), (None,)], "user_id string")
    assert [r[0] for r in df.select(scalars.valid_user_id("user_id")).collect()] == [True, False, False, False]


def test_first_image_with_all_substrings(spark):
    good = "https://lh5.googleusercontent.com/p"
    pages = spark.createDataFrame(
        [
            ("a", f'<img src="https://x/y"><IMG alt="q" src=\'{good}\'><img src="{good}2">'),
            ("b", "<p>none</p>"),
            ("a", "<p>second page</p>"),
            ("e", f'<img data-src="{good}late" alt="a > src={good}alt" src={good}?x=1&amp;y=2>'),
            ("c", '<img src="http://googleusercontent.com">'),
        ],
        "gmap_id string, html string",
    )
    items = spark.createDataFrame([("a", None), ("b", None), ("c", "own"), ("d", None), ("e", None)], "gmap_id string, img_url string")
    got = {r.gmap_id: r.img_url for r in cleaning.fill_images(items, pages).collect()}
    assert got == {"a": good, "b": scalars.NO_PAGE_IMAGE, "c": "own", "d": scalars.NO_PAGE_IMAGE, "e": f"{good}?x=1&y=2"}


def test_cleaning_chain(spark, tmp_path):
    meta = write(tmp_path, "meta.json", "\n".join(LINES))
    reviews = [{"user_id": str(u), "time": u, "rating": 5, "gmap_id": g, "text": "?"} for g in "abz" for u in range(3)]
    reviews += [{"user_id": "9", "time": 9, "rating": 1, "gmap_id": "d"}]
    path = write(tmp_path, "reviews.json", "\n".join(map(json.dumps, reviews)) + "\n{broken\n")
    out = clean(spark, meta, path, min_reviews=2)
    assert ids(out.items) == ["a"]
    assert ids(out.reviews) == ["a"] * 3
    assert {r.value for r in out.rejected_lines.collect()} == BAD | {"{broken"}
    assert ids(out.rejected_items) == ["d"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("7", "a")], "user_id string, gmap_id string")
    for run, value in ((1, "old"), (2, "new"), (2, "new")):
        sinks.write_snapshot(spark.createDataFrame([(value,)], "v string"), str(tmp_path / "s"), run)
    assert [r.v for r in scans.read_newest(spark, str(tmp_path / "s"), "v string").collect()] == ["new"]
    assert [r.v for r in scans.read_newest(spark, str(tmp_path / "s"), "v string", before=2).collect()] == ["old"]
    row = sinks.to_key_value(df).first()
    assert (row.key, json.loads(row.value)) == ("7", {"user_id": "7", "gmap_id": "a"})


def test_stored_tables_are_in_the_folder_of_the_application_until_released(spark, tmp_path, monkeypatch):
    df = shared.stored(spark.range(3).toDF("user_id"), "probe")
    assert df.count() == 3
    folder = spark.conf.get("spark.checkpoint.dir")
    assert f"{folder}/tablewise/{spark.sparkContext.applicationId}/probe-" in df.inputFiles()[0]

    other = tmp_path / "tablewise" / "other-app"
    monkeypatch.setattr(shared, "_own_dir", lambda session: str(other))
    shared.stored_by(spark.range(3).toDF("user_id"), "user_id", 2, "bucketed")
    assert any(t.name.startswith("tablewise_") for t in spark.catalog.listTables())
    spark.sql("CREATE TABLE tablewise_of_someone_else (x INT) USING parquet")
    shared.release(spark)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("tablewise_")] == ["tablewise_of_someone_else"]
    spark.sql("DROP TABLE tablewise_of_someone_else")
    assert not other.exists() and other.parent.exists()
    assert not any(t.name.startswith("tablewise_") for t in spark.catalog.listTables())
    assert df.count() == 3


def test_now_is_in_milliseconds(spark):
    now = spark.range(1).select(scalars.now_millis()).first()[0]
    assert abs(now - time.time() * 1000) < 60_000
