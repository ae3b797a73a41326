"""The curve step by step, and the law of the shards."""

from collections import Counter
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tablewise.llm import hilbert
from tablewise.llm.queries import QUERIES


@pytest.mark.parametrize("n, bits", [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    names = [f"x{k}" for k in range(n)]
    grid = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"{x} int" for x in names))
    rows = grid.select("*", hilbert.hilbert_index([F.col(x) for x in names], bits).alias("h")).collect()
    path = [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(1 << (bits * n)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_hilbert_shards"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    shards = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert sum(map(len, shards.values())) == len(docs)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "rows", None)
    # shards are narrow in their dimensions: far fewer (shard, language) pairs than all
    assert len({(r.shard, docs[r.doc_id].lang) for r in rows}) < 40


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x" * 300_000, "en", "a", 300_000)]
    rows += [(4, "same", "de", "b", 4)] * 50 + [(None, "same", "de", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("shard", "_part", "_place", "_start", "__curve", "__rank")])
    found = hilbert.assign(hilbert.measured(docs), 4).collect()
    counts = [sum(r.shard == s for r in found) for s in range(4)]
    assert sum(counts) == 54 and max(counts) - min(counts) <= 1
    assert hilbert.assign(hilbert.measured(docs.limit(0)), 4).count() == 0
    few = hilbert.assign(hilbert.measured(docs.limit(3)), 16).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_written_shards_keep_all_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hilbert.write(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()


def _divided(found):
    """Groups of equal texts with rows in several shards."""
    of = {}
    for r in found:
        of.setdefault((r.text_crc32, r.text_hash, r.size), set()).add(r.shard)
    return [k for k, v in of.items() if len(v) > 1]


def test_equal_texts_are_one_run(spark):
    docs = hilbert.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("text")
    found = hilbert.assign(docs).collect()
    groups = Counter((r.text_crc32, r.text_hash, r.size) for r in found)
    assert sum(n > 1 for n in groups.values()) > 30
    assert len(_divided(found)) <= 15
    run = [(r.text_crc32, r.text_hash, r.size) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert 1 + sum(a != b for a, b in zip(run, run[1:])) == len(groups)


def test_sources_with_a_common_head(spark):
    rows = [(k, "en", f"https://www.example.org/{k % 64:02d}", 100, 5, k, k) for k in range(6400)]
    names = "doc_id long, lang string, source string, n_chars long, size long, text_crc32 long, text_hash long"
    docs = spark.createDataFrame(rows, names)
    bounds = hilbert._text_bounds(docs, "source", 16)
    assert bounds == [f"https://www.example.org/{k:02d}" for k in range(3, 63, 4)]
    found = hilbert.assign(docs).collect()
    assert max(len({r.source for r in found if r.shard == s}) for s in range(16)) <= 5


def test_rows_stand_where_the_curve_says(spark):
    """Every row's place against cells, curve and order worked out in Python."""
    docs = hilbert.measured(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).drop("text")
    cells = hilbert.cells(docs, hilbert.DIMENSIONS, 4)
    rows = docs.select("*", *[c.alias(f"c{k}") for k, c in enumerate(cells)]).collect()
    places, states = hilbert.curve_tables(3)

    def index(cell):
        out = state = 0
        for bit in (3, 2, 1, 0):
            corner = sum(((c >> bit) & 1) << (2 - k) for k, c in enumerate(cell))
            out, state = out * 8 + places[state * 8 + corner], states[state * 8 + corner]
        return out

    langs = sorted(r.lang for r in rows)
    bounds = [langs[-(-k * len(langs) // 16) - 1] for k in range(1, 16)]
    assert all(r.c0 == sum(b < r.lang for b in bounds) for r in rows)
    key = lambda r: (r.text_hash, r.text_crc32, r.size)
    first = {}
    for r in rows:
        first[key(r)] = min(first.get(key(r), 1 << 60), index((r.c0, r.c1, r.c2)))
    order = sorted(rows, key=lambda r: (first[key(r)], r.text_crc32, r.text_hash, r.size, r.doc_id))
    n = len(order)
    want = {r.doc_id: (k * 16 // n, k - -(-(k * 16 // n) * n // 16)) for k, r in enumerate(order)}
    assert {r.doc_id: (r.shard, r.slot) for r in hilbert.assign(docs).collect()} == want
