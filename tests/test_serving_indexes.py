"""Sketches, the sparse matrix, written listings and the name index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewise.operators import matrix, name_index, pages, reach, serving


def test_reach_stays_in_its_error(spark):
    # 30,000 users enter over 60 hours, every third clicks; many come in several hours
    events = spark.range(120_000).selectExpr(
        "concat('u', id % 30000) AS user_id",
        "IF(id % 3 = 0, 'url_click', 'user_entered') AS event_type",
        "timestamp_millis(3600000 * (id % 60)) AS ts",
    )
    sketches = reach.hourly_sketches(events)
    assert sketches.agg(F.max(F.octet_length("users"))).first()[0] < 8 * 2**reach.SIZE + 200
    ranges = spark.createDataFrame([(0, 60), (10, 50), (70, 80), (5, 5)], "first_hour long, end_hour long")
    kinds = {"users_entered": "event_type = 'user_entered'", "users_clicked": "event_type = 'url_click'"}
    got = {(r.first_hour, r.end_hour): r for r in reach.reach(sketches, ranges).collect()}
    assert len(got) == 4
    for (first, end), row in got.items():
        inside = events.where((F.unix_millis("ts") >= first * 3_600_000) & (F.unix_millis("ts") < end * 3_600_000))
        for name, kind in kinds.items():
            exact = inside.where(kind).select("user_id").distinct().count()
            assert abs(row[name] - exact) <= 4 * reach.error() * exact
        assert abs(row.users_both + row.users_without_click - row.users_entered) <= 1


def test_matrix_in_narrow_slices(spark):
    rows = [("a", f"i{k:02d}", k % 5 + 1) for k in range(23)] + [("b", "i07", 2), ("c", "i03", 0), ("d", "x", None)]
    m = matrix.matrix(spark.createDataFrame(rows, "user_id string, gmap_id string, rating int"), width=10)
    got = {(r.user_id, r.slice): r for r in m.rows.collect()}
    assert {k: (r["size"], r.places) for k, r in got.items()} == {
        ("a", 0): (10, list(range(10))), ("a", 1): (10, list(range(10))), ("a", 2): (3, [0, 1, 2]), ("b", 0): (10, [7]),
    }
    back = {(r.user_id, r.gmap_id, r.rating) for r in matrix.cells(m).collect()}
    assert back == {(u, i, float(r)) for u, i, r in rows if r}
    assert matrix.cells(matrix.matrix(spark.createDataFrame([], "user_id string, gmap_id string, rating int"))).isEmpty()


def test_a_deep_page_reads_one_block(spark, tmp_path):
    path = str(tmp_path / "listing")
    items = spark.range(1000).selectExpr("concat('g', id) AS gmap_id", "'n' AS name", "IF(id % 7 = 0, NULL, double(id % 5)) AS Rating")
    pages.write_listing(items.withColumn("rank", F.lit(1)), path, block_rows=90)
    schema = "gmap_id string, name string, Rating double"
    assert tuple(pages.listing_size(spark, path).first()) == (1000, 34)
    for n in (1, 4, 33, 34, 35):
        page = pages.listing_page(spark, path, schema, n, block_rows=90)
        want = serving.list_items(items, page=n)
        assert [r.gmap_id for r in page.collect()] == [r.gmap_id for r in want.collect()]
        files = {f.rsplit("/", 2)[1] for f in page.inputFiles()}
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*block", plan) and files
    read = page.sparkSession.read.parquet(path).where("block = 11").select(F.input_file_name().alias("f")).distinct().count()
    assert read <= 2
    with pytest.raises(ValueError):
        pages.listing_page(spark, path, schema, 0)


@pytest.mark.parametrize(
    "pattern, runs",
    [
        ("small", [{"sma", "mal", "all"}]),
        ("RED|^blue$", [{"red"}, {"blu", "lue"}]),
        ("ab|small", None),
        (".*", None),
        (r"caf\.e", [{"caf", "af.", "f.e"}]),
        ("abcd?e", [{"abc"}]),
        ("ab+cdef", [{"cde", "def"}]),
        ("abc(def|x)ghi", [{"abc", "ghi"}]),
        ("abc[xyz]def", [{"abc", "def"}]),
        ("ab{2}xyz", [{"xyz"}]),
        (r"\bgrill\s", [{"gri", "ril", "ill"}]),
        ("(?=abc)def", None),
        (r"\Qabc\E", None),
    ],
)
def test_runs_that_a_pattern_needs(pattern, runs):
    assert name_index.required_runs(pattern) == runs


def test_search_by_index_finds_what_the_scan_finds(spark):
    rng = random.Random(3)
    parts = ["small", "Red", "ring", "Bolt", "café", "ab", "x.y", "GRILL", "über", "(a)", "ii"]
    rows = [(f"g{k}", " ".join(rng.choices(parts, k=rng.randint(0, 4)))) for k in range(400)] + [("n", None), ("e", "")]
    items = spark.createDataFrame(rows, "gmap_id string, name string").withColumn("held", F.lit(1))
    index = name_index.name_index(items).persist()
    patterns = ["small", "red|ring$", "^small red", "r[a-z]ng bolt", r"x\.y", "Caf.", "CAFÉ", "ÜBER", "(ring|bolt) small", "sma(ll)? red", "ab", "", "zzz", "gril+ ii", r"\(a\)", "small{0}red"]
    for p in patterns:
        got = sorted(r.gmap_id for r in name_index.indexed_search(items, index, p).collect())
        assert got == sorted(r.gmap_id for r in serving.search_items(items, p).collect()), p
    few = name_index.indexed_search(items, index, "small red")
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString() and few.columns == items.columns
