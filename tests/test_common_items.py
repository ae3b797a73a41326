"""Pairs by the items' lists: entries of four bytes against whole ones."""

import numpy as np
import pytest

from tablewise.operators import common_items, similarity


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("list_rows, at_once", [(1_000, 1_000_000), (4, 7)])
def test_short_entries_give_what_whole_ones_give(spark, monkeypatch, both, list_rows, at_once):
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", f"i{i}", float(rng.integers(2, 11)) / 2, float(u)) for u in range(30) for i in range(12) if rng.random() < 0.4]
    rows += [(None, "i1", 2.0, 1.0), ("u1", None, 3.0, 1.0), ("u2", "i3", 10 / 3, 2.0), rows[0]]
    vectors = spark.createDataFrame(rows, "user_id string, gmap_id string, rating double, own double")
    monkeypatch.setattr(common_items, "_AT_ONCE", at_once)

    def finish(ids_a, ids_b, sums, more):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([ids_a, ids_b, *map(pa.array, [*sums, *more["own"]])], names=["a", "b", "n", "dot", "a2", "b2", "x", "y"])

    def pairs():
        found = common_items.common_sums(vectors, finish, "a string, b string, n double, dot double, a2 double, b2 double, x double, y double", ["own"], both, list_rows)
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found.collect())

    short = pairs()
    assert len(short) == len({r[:2] for r in short}) > 100
    monkeypatch.setattr(common_items, "CODED_USERS", 0)
    assert pairs() == short


def test_entries_travel_as_four_bytes(spark):
    rows = [(f"user number {u}", "i", 3.0) for u in range(50)]
    vectors = spark.createDataFrame(rows, "user_id string, gmap_id string, rating double")
    coded = common_items._coded(vectors, [])
    lists = common_items._lists_that_meet(coded.rows, coded.rows.entry, 1_000)
    out = lists.mapInArrow(common_items._spread_codes(False), "code int, entries binary").collect()
    assert sum(len(r.entries) for r in out) == 4 * (50 * 51 // 2 + 50)
    assert similarity.user_similarity(vectors, block_users=10).count() == 50 * 51 // 2
