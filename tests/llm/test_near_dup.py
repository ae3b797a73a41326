"""Near duplicates against all pairs, compared in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tablewise.llm import near_dup
from tablewise.llm.near_dup import Settings
from tablewise.llm.queries import QUERIES

THREE = Settings(words=3, hundredths=85, bands=24, rows=5)


def shingles(text, k):
    words = bytes(text or "", "utf-8").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, hundredths):
    """doc_id to (set size, smallest id reachable), over all pairs with a common shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                if find(a) != find(b) and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                        lo, hi = sorted((find(a), find(b)))
                        root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(found, rows, k, hundredths):
    want = brute(rows, k, hundredths)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def copies(seed, n=160, words=60):
    """Chains of edits of one text, so that links join what is not alike itself."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            text[rnd.randrange(words)] = f"x{rnd.randrange(40)}"
        out.append((1000 * seed + i, " ".join(text)))
    return out


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(QUERIES["op5_near_duplicates"](spark, folder), rows, 3, 85)


@pytest.mark.parametrize("block", [1024, 40])
def test_groups_that_a_forest_does_not_settle(spark, block):
    rows = copies(1) + copies(2) + [(5, ""), (6, " \n"), (7, "one"), (8, "ONE"), (9, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = Settings(words=3, hundredths=85, bands=24, rows=5, block=block, exact_block=block // 4)
    check(near_dup.near_duplicates(docs, small), rows, 3, 85)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, None, 3), (None, "a b c d e f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int").withColumn(
        "kept", F.lit("x")
    )
    found = near_dup.near_duplicates(docs).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in found)
    assert got == [(-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(docs).count() == 0
    assert near_dup.one_of_each(docs).count() == 0


def test_defaults_for_other_uses():
    assert (Settings().words, Settings().hundredths) == (5, 80)
    for s in (Settings(), THREE):
        assert (1 - s.share**s.rows) ** s.bands < 1e-6 and s.packed * 16 >= s.minima


def test_one_id_with_several_texts(spark):
    """Of rows with one id one stays; texts that stay are in no exchange."""
    words = [f"w{k}" for k in range(40)]
    one, two = " ".join(words), " ".join(words[::-1])
    rows = [(1, one), (2, one), (3, two), (3, " ".join(words[5:25])), (4, " ".join(words[2:30])), (None, one), (None, one)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, id string, kept boolean")
    left = near_dup.one_of_each(docs)
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert left.columns == docs.columns
    assert [k for k, _ in got] == [0, 0, 1, 3, 4] and dict(got)[3] in (two, rows[3][1])
    assert near_dup.one_of_each(docs.limit(0)).isEmpty()


def test_texts_that_stay_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = near_dup.one_of_each(docs)._jdf.queryExecution().optimizedPlan().toString()
    straight = plan[: plan.index("Join")] if "Join" in plan else plan
    assert "Union" in straight and "Aggregate" not in straight.split("Union")[1].split("Relation")[0]
