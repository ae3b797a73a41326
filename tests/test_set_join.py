"""Similar users against all pairs, and how few pairs are looked at."""

import math

import numpy as np
import pytest

from tablewise.functions import distances
from tablewise.operators import common_items, set_join, similarity

RATINGS = "user_id string, gmap_id string, rating double"


def taste_groups(users=120, width=300, each=25):
    """Users take most items from their group's part, and some from anywhere; a few items are everybody's."""
    rng = np.random.default_rng(6)
    out = {}
    for u in range(users):
        own = (u % 12) * 25 + rng.choice(25, each - 12, replace=False)
        other = rng.choice(width, 9, replace=False)
        items = {int(i) for i in [*own, *other, 0, 1, 2]}
        out[f"u{u:03d}"] = {i: float(rng.integers(1, 6)) for i in items}
    return out


def frame(spark, users):
    return spark.createDataFrame([(u, f"i{i:03d}", r) for u, v in users.items() for i, r in v.items()], RATINGS)


def brute(users, min_common, least):
    norm = {u: sum(r * r for r in v.values()) for u, v in users.items()}
    out = {}
    for a in users:
        for b in users:
            common = users[a].keys() & users[b].keys()
            if a < b and len(common) >= min_common:
                dot = sum(users[a][i] * users[b][i] for i in common)
                cosine = dot / math.sqrt(norm[a] * norm[b])
                x, y = math.sqrt(norm[a]), math.sqrt(norm[b])
                s = cosine * (1 - abs(x - y) / max(x, y))
                if round(s, 9) >= least:
                    out[a, b] = (len(common), pytest.approx(s, abs=1e-8))
    return out


@pytest.mark.parametrize("min_common, least", [(1, 0.0), (8, 0.0), (1, 0.5), (6, 0.35)])
def test_pairs_are_those_of_brute_force(spark, min_common, least):
    users = taste_groups() | {"one": {0: 5.0}, "two": {0: 5.0}, "zero": {3: 0.0}}
    rows = set_join.similar_users(frame(spark, users), min_common, least).collect()
    users["zero"] = {}
    want = brute({u: v for u, v in users.items() if v}, min_common, least)
    got = {(r.user_a, r.user_b): (r.n_common, r.similarity) for r in rows}
    assert len(rows) == len(got) and got == want and want


def test_few_pairs_are_looked_at(spark):
    users = taste_groups()
    ratings = frame(spark, users)
    # three items are everybody's, so every pair has something in common
    assert len(brute(users, 1, 0.0)) == 120 * 119 // 2
    found = len(brute(users, 8, 0.0))
    looked_at = set_join.candidate_pairs(ratings, 8, 0.0).count()
    assert 0 < found <= looked_at < 0.6 * 120 * 119 // 2
    assert set_join.candidate_pairs(ratings, 8, 0.45).count() < looked_at


def test_empty_and_wrong_settings(spark):
    empty = spark.createDataFrame([], RATINGS)
    assert set_join.similar_users(empty, 2, 0.5).isEmpty()
    for common, least in ((0, 0.1), (1, 1.1), (1, -0.1)):
        with pytest.raises(ValueError):
            set_join.similar_users(empty, common, least)


def sparse_users(users=90, width=400, each=9):
    rng = np.random.default_rng(3)
    return {f"u{u:03d}": {int(i): float(rng.integers(1, 6)) for i in {0, *rng.choice(width, each)}} for u in range(users)}


@pytest.mark.parametrize("at_once, list_rows", [(1_000_000, 1_000), (50, 1_000), (200, 20)])
def test_sums_by_lists_of_raters_are_those_of_blocks(spark, monkeypatch, at_once, list_rows):
    monkeypatch.setattr(common_items, "_AT_ONCE", at_once)
    ratings = frame(spark, sparse_users())
    want = {(r.user_a, r.user_b): tuple(r)[2:] for r in similarity.pair_sums(ratings).collect()}
    listed = common_items.common_sums(ratings, similarity._listed_sums, similarity._PAIR_SUMS, list_rows=list_rows).collect()
    assert {(r.user_a, r.user_b): tuple(r)[2:] for r in listed} == want and len(listed) == len(want)


def test_few_common_items_take_no_blocks_and_no_candidates(spark, monkeypatch):
    users = sparse_users()
    for u in users.values():
        u.pop(0)
    ratings = frame(spark, users)
    groups = spark.createDataFrame([(u, n % 3) for n, u in enumerate(users)], "user_id string, cluster_id int")
    whole = [similarity.user_similarity(ratings).collect(), similarity.silhouette(ratings, groups, distances.COSINE).collect()]
    pairs = brute(users, 2, 0.0)

    def no(*_):
        raise AssertionError("copies of all rows")

    monkeypatch.setattr(similarity, "_blocks", no)
    monkeypatch.setattr(set_join, "candidate_pairs", no)
    rows = set_join.similar_users(ratings, 2).collect()
    assert {(r.user_a, r.user_b): (r.n_common, r.similarity) for r in rows} == pairs and pairs
    lists = [
        similarity.user_similarity(ratings, block_users=9).collect(),
        similarity.silhouette(ratings, groups, distances.COSINE, block_users=9).collect(),
    ]
    for got, want in zip(lists, whole):
        assert len(got) == len(want)
        assert {tuple(r)[:2]: r[2] for r in got} == pytest.approx({tuple(r)[:2]: r[2] for r in want})
