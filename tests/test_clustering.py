import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.functions import distances
from tablewise.operators import bounded, choice, clustering, seeding, similarity

RATINGS = "user_id string, gmap_id string, rating double"
CELLS = "cluster_id int, gmap_id string, value double"


def long_form(spark, rows, schema=RATINGS):
    return spark.createDataFrame(
        [(k, f"i{n}", float(v)) for k, vector in rows.items() for n, v in enumerate(vector) if v], schema
    )


def user_table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def masked(a, b):
    """The distance as it is defined, on dense vectors."""
    both = (a != 0) & (b != 0)
    if not both.any():
        return 1.0
    x, y = a[both], b[both]
    m, n = math.sqrt((x * x).sum()), math.sqrt((y * y).sum())
    return 1 - (x @ y) / (m * n) * (1 - abs(m - n) / max(m, n))


def random_vectors(n, width, seed, density=0.3):
    rng = np.random.default_rng(seed)
    return {f"u{i:03d}": rng.integers(1, 6, width) * (rng.random(width) < density) for i in range(n)}


@pytest.mark.parametrize(
    "a, b, distance", [((3, 4, 0), (3, 4, 5), 0.0), ((1, 0), (0, 1), 1.0), ((1, 1), (2, 2), 0.5)]
)
def test_masked_distance(spark, a, b, distance):
    r = long_form(spark, {"u": a})
    c = long_form(spark, {0: b}, CELLS)
    got = clustering.assign_clusters(r, user_table(spark, ["u"]), c, 1).first()
    assert got.distance == pytest.approx(distance)


@pytest.mark.parametrize("broadcast_cells", [0, 10**6])
def test_assignment_equals_brute_force(spark, broadcast_cells):
    users, centres = random_vectors(60, 25, 1), random_vectors(9, 25, 2, 0.4)
    cells = long_form(spark, dict(enumerate(centres.values())), CELLS)
    got = clustering.assign_clusters(
        long_form(spark, users), user_table(spark, users), cells, 9, broadcast_cells=broadcast_cells
    ).collect()
    for r in got:
        all_d = [round(masked(users[r.user_id].astype(float), c.astype(float)), 9) for c in centres.values()]
        assert r.distance == pytest.approx(min(all_d))
        assert r.cluster_id == int(np.argmin(all_d))
    assert len(got) == 60


def test_user_without_features_and_ties_go_to_the_lowest_cluster(spark):
    users = {"bare": (0, 0), "tied": (2, 3)}
    cells = long_form(spark, {1: (2, 3), 2: (2, 3)}, CELLS)
    got = clustering.assign_clusters(long_form(spark, users), user_table(spark, users), cells, 70)
    assert {r.user_id: (r.cluster_id, r.distance) for r in got.collect()} == {"bare": (0, 1.0), "tied": (1, 0.0)}


def test_absent_cluster_can_be_the_nearest(spark):
    # negative cells are farther than having nothing in common
    cells = spark.createDataFrame([(0, "i0", -4.0), (1, "i0", -4.0)], CELLS)
    got = clustering.assign_clusters(long_form(spark, {"u": (4,)}), user_table(spark, ["u"]), cells, 130).first()
    assert (got.cluster_id, got.distance) == (2, 1.0)
    # 64 clusters that all share the item leave none that is absent
    full = spark.createDataFrame([(c, "i0", -4.0) for c in range(64)], CELLS)
    got = clustering.assign_clusters(long_form(spark, {"u": (4,)}), user_table(spark, ["u"]), full, 64).first()
    assert (got.cluster_id, got.distance) == (0, 2.0)
    cells = spark.createDataFrame([(c, "i0", -4.0) for c in range(65)], CELLS)
    got = clustering.assign_clusters(long_form(spark, {"u": (4,)}), user_table(spark, ["u"]), cells, 66).first()
    assert (got.cluster_id, got.distance) == (65, 1.0)


def test_cluster_mean_counts_members_without_rating(spark):
    r = long_form(spark, {"a": (4,), "b": (0, 5)})
    assigned = spark.createDataFrame([("a", 3), ("b", 3)], "user_id string, cluster_id int")
    got = {x.gmap_id: x.value for x in clustering.update_centroids(r, assigned).collect()}
    assert got == {"i0": 2.0, "i1": 2.5}


def test_empty_cluster_has_an_empty_list(spark):
    r = long_form(spark, {"a": (4, 5)})
    assigned = spark.createDataFrame([("a", 1)], "user_id string, cluster_id int")
    listed = clustering.cluster_recommendations(r, assigned, n=1)
    lists = {x.cluster_id: [tuple(e) for e in x.recommendations] for x in clustering.cluster_lists(listed, 3).collect()}
    assert lists == {0: [], 1: [("i1", 5.0)], 2: []}


def test_zero_scores_can_be_kept(spark):
    r = long_form(spark, {"a": (0, 5)})
    features = spark.createDataFrame([("i0",), ("i1",), ("i2",)], "gmap_id string")
    assigned = spark.createDataFrame([("a", 1)], "user_id string, cluster_id int")
    listed = clustering.cluster_recommendations(r, assigned, 2, features=features)
    assert [(x.cluster_id, x.gmap_id, x.score) for x in listed.orderBy("rank").collect()] == [(1, "i1", 5.0), (1, "i0", 0.0)]


def reference_rounds(users, centres, max_iter, tol=1e-4, far=None):
    names = sorted(users)
    matrix = np.array([users[n] for n in names], dtype=float)
    centres = np.array(centres, dtype=float)
    errors = []
    for _ in range(max_iter):
        d = np.array([[round((far or masked)(u, c), 9) for c in centres] for u in matrix])
        labels = d.argmin(1)
        errors.append(d.min(1).sum())
        new = np.array([matrix[labels == c].mean(0) if (labels == c).any() else 0 * centres[0] for c in range(len(centres))])
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol or np.allclose(centres, new):
            break
        centres = new
    return dict(zip(names, labels.tolist())), errors


@pytest.mark.parametrize("hot_rows", [10**6, 12])
def test_rounds_equal_brute_force(spark, hot_rows):
    users = random_vectors(40, 30, 5, 0.4)
    start = [users[n] for n in sorted(users)[:4]]
    result = clustering.kmeans(
        long_form(spark, users),
        user_table(spark, users),
        4,
        init=long_form(spark, dict(enumerate(start)), CELLS),
        hot_rows=hot_rows,
    )
    labels, errors = reference_rounds(users, start, 100)
    assert {r.user_id: r.cluster_id for r in result.assignments.collect()} == labels
    assert result.errors == pytest.approx(errors)
    assert len(errors) < 100


def test_planted_groups_are_found(spark):
    rng = random.Random(3)
    users = {
        f"u{u:02d}": [(1 + (u % 5 + i % 5) % 5) * (rng.random() < 0.6) for i in range(40)] for u in range(60)
    }
    start = dict(enumerate(list(users.values())[:5]))
    result = clustering.kmeans(long_form(spark, users), user_table(spark, users), 5, init=long_form(spark, start, CELLS))
    groups = {}
    for r in result.assignments.collect():
        groups.setdefault(r.cluster_id, []).append(int(r.user_id[1:]) % 5)
    in_main = sum(max(g.count(x) for x in set(g)) for g in groups.values())
    assert in_main / 60 > 0.9
    sil = similarity.silhouette(long_form(spark, users), result.assignments).agg(F.avg("silhouette")).first()[0]
    assert sil > 0.1


def test_euclidean_start_and_table_of_errors(spark):
    users = random_vectors(30, 12, 8, 0.5)
    r, u = long_form(spark, users), user_table(spark, users)
    drawn = sorted(users, key=lambda n: (hashlib.md5(f"{n}|1".encode()).hexdigest(), n))[:3]
    centres = [users[n] for n in drawn]
    labels, errors = reference_rounds(users, centres, 100, far=lambda a, b: ((a - b) ** 2).sum())
    result = clustering.kmeans(r, u, 3, distances.SQUARED_EUCLIDEAN, init="random", seed=1)
    assert {x.user_id: x.cluster_id for x in result.assignments.collect()} == labels
    assert result.errors == pytest.approx(errors) and len(errors) < 100
    # the masked run starts where the Euclidean one has ended, which starts at users far apart
    spread = clustering.kmeans(r, u, 3, distances.SQUARED_EUCLIDEAN, init="k-means++", seed=1)
    both = clustering.kmeans(r, u, 3, init="euclidean", seed=1, max_iter=1)
    again = clustering.kmeans(r, u, 3, init=spread.centroids, max_iter=1)
    assert both.errors == pytest.approx(again.errors)


@pytest.mark.parametrize("init, distance", [("random", distances.MASKED_COSINE), ("k-means++", distances.SQUARED_EUCLIDEAN)])
def test_runs_advanced_together_end_as_they_do_alone(spark, init, distance):
    users = random_vectors(30, 12, 8, 0.5) | {"empty": np.zeros(12)}
    r, u = long_form(spark, users), user_table(spark, users)
    table = {x.k: x for x in choice.elbow(r, u, [4, 2, 2], distance, init, max_iter=2, seed=1, hot_rows=7).collect()}
    assert sorted(table) == [2, 4] and sum(x.chosen for x in table.values()) == 1
    alone = clustering.kmeans(r, u, 4, distance, init, max_iter=2, seed=1)
    assert (table[4].rounds, table[4].total_error) == (len(alone.errors), pytest.approx(clustering.total_error(alone.assignments)))


@pytest.mark.parametrize(
    "errors, chosen",
    [
        ([(2, 100.0), (4, 40.0), (6, 35.0), (8, 33.0)], 4),
        ([(2, 100.0), (4, 90.0), (6, 30.0), (8, 28.0)], 6),
        ([(1, 5.0), (2, 5.0), (3, 5.0)], 1),
        ([(3, 7.0)], 3),
        ([(1, 4.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, 0.0)], 2),
    ],
)
def test_knee_is_farthest_under_the_chord(spark, errors, chosen):
    rows = choice.knee(spark.createDataFrame(errors[::-1], "k int, total_error double")).collect()
    assert [x.k for x in rows if x.chosen] == [chosen] and len(rows) == len(errors)
    assert choice.knee(spark.createDataFrame([], "k int, total_error double")).isEmpty()


def planted_users(groups=6, each=20, width=60):
    """Groups with tastes far apart; most users are in the first one."""
    rng = np.random.default_rng(5)
    tastes = rng.integers(1, 6, (groups, width)) * (rng.random((groups, width)) < 0.5)
    sizes = [each * 6] + [each // 2] * (groups - 1)
    rows = {}
    for g, n in enumerate(sizes):
        for i in range(n):
            rows[f"g{g}-{i:03d}"] = np.clip(tastes[g] + rng.integers(-1, 2, width) * (tastes[g] > 0), 0, 5)
    return rows


def test_spread_start_has_a_lower_error_than_a_random_one(spark):
    users = planted_users()
    r, u = long_form(spark, users), user_table(spark, users)
    nearest = clustering.nearest_of([(r, u)], distances.SQUARED_EUCLIDEAN)
    spread = plain = 0.0
    for seed in range(3):
        start = seeding.plus_plus_start(r, u, 6, seed, nearest, rounds=2)
        assert {x.cluster_id for x in start.collect()} == set(range(6))
        spread += clustering.total_error(nearest(start, 6))
        plain += clustering.total_error(nearest(clustering.random_start(r, u, 6, seed), 6))
    assert spread < plain


def test_reduction_is_weighted_and_skips_equal_candidates():
    squares = np.array([[0.0, 0.0, 9.0], [0.0, 0.0, 9.0], [9.0, 9.0, 0.0]])
    picks = [seeding.reduced(["a", "b", "c"], np.array([1.0, 1.0, 1.0]), squares, 2, seed) for seed in range(40)]
    assert all(len(p) == 2 and 2 in p for p in picks)
    first = [seeding.reduced(["a", "b", "c"], np.array([1.0, 1.0, 50.0]), squares, 1, seed)[0] for seed in range(200)]
    assert first.count(2) > 180
    assert sorted(seeding.reduced(["a", "b", "c"], np.ones(3), squares, 5, 1)) == [0, 1, 2]


def test_bounds_skip_users_and_change_nothing(spark):
    users = planted_users(each=10, width=30) | {"empty": np.zeros(30)}
    r, u = long_form(spark, users), user_table(spark, users)
    start = clustering.random_start(r, u, 6, 3)
    plain = clustering.kmeans(r, u, 6, distances.SQUARED_EUCLIDEAN, init=start)
    got = bounded.kmeans(r, u, 6, start, hot_rows=14)
    rows = lambda x: {y.user_id: (y.cluster_id, pytest.approx(y.distance, abs=1e-6)) for y in x.assignments.collect()}
    assert rows(got) == rows(plain)
    assert got.errors == pytest.approx(plain.errors) and len(got.errors) > 2
    assert got.skipped[0] == 0 and max(got.skipped) > 0.5 and len(got.skipped) >= len(got.errors)
    alone = bounded.kmeans(r, u, 1, start.where("cluster_id = 0"), max_iter=3)
    assert {x.cluster_id for x in alone.assignments.collect()} == {0} and alone.skipped[1:] == [1.0] * (len(alone.skipped) - 1)


def test_start_with_few_and_empty_users(spark):
    users = {"a": (1, 2), "b": (1, 2), "c": (0, 0)}
    r, u = long_form(spark, users), user_table(spark, users)
    nearest = clustering.nearest_of([(r, u)], distances.SQUARED_EUCLIDEAN)
    cells = seeding.plus_plus_start(r, u, 3, 1, nearest).collect()
    assert sorted((x.gmap_id, x.value) for x in cells) == [("i0", 1.0), ("i0", 1.0), ("i1", 2.0), ("i1", 2.0)]
    assert seeding.plus_plus_start(r.limit(0), u.limit(0), 3, 1, nearest).isEmpty()
    alike = clustering.kmeans(r, u, 2, init="k-means++")
    assert alike.assignments.count() == 3


def test_full_norm_similarity(spark):
    r = long_form(spark, {"a": (3, 4, 0), "b": (3, 4, 5), "c": (0, 0, 0, 1)})
    got = {(x.user_a, x.user_b): round(x.similarity, 6) for x in similarity.user_similarity(r).collect()}
    assert got == {("a", "b"): 0.5, ("a", "a"): 1.0, ("b", "b"): 1.0, ("c", "c"): 1.0}


def brute_silhouette(users, labels):
    names = sorted(users)
    out = {}
    for n in names:
        mean = {}
        for c in set(labels.values()):
            others = [m for m in names if labels[m] == c and m != n]
            if others:
                mean[c] = np.mean([masked(users[n].astype(float), users[m].astype(float)) for m in others])
        own = mean.pop(labels[n], None)
        out[n] = 0.0 if own is None else (min(mean.values()) - own) / max(min(mean.values()), own)
    return out


@pytest.mark.parametrize("block_users, block_rows", [(1000, 500_000), (7, 500_000), (7, 5)])
def test_pairs_and_silhouette_equal_brute_force(spark, block_users, block_rows):
    users = random_vectors(25, 15, 11, 0.4)
    users["alone"] = np.array([5] * 15)
    labels = {n: i % 3 for i, n in enumerate(sorted(users))}
    labels["alone"] = 9
    assigned = spark.createDataFrame(list(labels.items()), "user_id string, cluster_id int")
    r = long_form(spark, users)
    got = similarity.silhouette(r, assigned, block_users=block_users, block_rows=block_rows).collect()
    want = brute_silhouette(users, labels)
    assert {x.user_id: x.silhouette for x in got} == pytest.approx(want)
    pairs = similarity.user_similarity(r, distances.MASKED_COSINE, block_users, block_rows).collect()
    assert len(pairs) == len({(p.user_a, p.user_b) for p in pairs})
    for p in pairs:
        d = masked(users[p.user_a].astype(float), users[p.user_b].astype(float))
        assert p.user_a <= p.user_b and p.similarity == pytest.approx(1 - d)
    names = [n for n in users if users[n].any()]
    n_common = sum(((users[a] != 0) & (users[b] != 0)).any() for a in names for b in names if a <= b)
    assert len(pairs) == n_common


def test_pairs_are_expanded_in_bounded_steps(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 200)
    monkeypatch.setattr(similarity, "_AT_ONCE", 700)
    steps = list(similarity._pairs_of_common_items(a, b, 5))
    got = {(int(x), int(y)) for left, right in steps for x, y in zip(left, right)}
    assert got == {(x, y) for x in range(300) for y in range(200) if a[x] == b[y]}
    assert sum(len(left) for left, _ in steps) == len(got)
    assert max(len(left) for left, _ in steps) <= 700 + 200


def test_elbow_query_takes_every_run_to_its_own_end(spark, monkeypatch):
    from tablewise.plans import clustering_queries

    calls = []
    monkeypatch.setattr(clustering_queries, "_input", lambda spark, folder: (None, None))
    monkeypatch.setattr(choice, "elbow", lambda *args, **given: calls.append(given) or spark.createDataFrame([(2, 1.0, 1, 0.0, True)], "k int, total_error double, rounds int, distance double, chosen boolean"))
    clustering_queries.elbow(spark, "")
    assert calls[0].get("tol", clustering.TOLERANCE) == 1e-4 and calls[0].get("max_iter", clustering.ROUNDS) == 100
