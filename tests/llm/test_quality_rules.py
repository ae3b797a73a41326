"""Base measures against plain Python, and a cascade whose order never changes the verdict."""

import random
import re
from collections import Counter

from tablewise.llm import quality_rules as qr
from tablewise.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = len({i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, failed)


def row(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, folder).collect()
    assert {r.doc_id: row(r) for r in rows} == {i: plain(t) for i, t in texts.items()}
    judged = [(r.kept, marks[r.doc_id]) for r in rows if r.doc_id in marks and not r.base_failed]
    assert sum(k and not m for k, m in judged) <= 0.1 * sum(not m for _, m in judged)
    assert sum(m and not k for k, m in judged) <= 0.02 * sum(m for _, m in judged)


def test_base_on_random_texts(spark):
    rnd = random.Random(2)
    parts = ["a", "b", "é", "#", "<|", "\n", "\n", " ", "\t", " ", "漢", "\x0b", "a b a b a b a b a b"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "x y " * 50_000), (403, "a " * 7), (404, "a " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: row(r) for r in qr.judge(docs).collect()} == {i: plain(t) for i, t in rows}


def test_order_decides_cost_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.kept for r in qr.judge(docs).collect()}
    other = {r.doc_id: r.kept for r in qr.judge(docs, qr.RULES[::-1]).collect()}
    assert one == other and 0 < sum(one.values()) < len(one)


def test_sample_does_not_follow_the_order_of_rows(spark):
    docs = spark.createDataFrame([(k % 500, f"text {k % 500}") for k in range(1500)], "doc_id long, text string")
    one = qr.sample_of(docs, 60)
    assert 20 <= len(one) <= 60 and one == qr.sample_of(docs.orderBy("text").repartition(3), 60)
    assert qr.judge(docs.selectExpr("*", "1 AS __text")).count() == 1500


def test_plan_puts_rejection_per_cost_first():
    slow = qr.Rule("slow", lambda d: sum(range(20_000)) > 0)
    rare = qr.Rule("rare", lambda d: d.raw.startswith(b"zz"))
    quick = qr.Rule("quick", lambda d: len(d.raw) % 2 == 0)
    sample = [b" ".join(b"w%d" % (i * 31 + j) for j in range(30)) + b"!" * (i % 2) for i in range(50)]
    assert [r.name for r, _, _ in qr.plan(sample, [slow, rare, quick])] == ["quick", "slow", "rare"]
    assert [r.name for r, _, _ in qr.plan([], [slow, rare])] == ["slow", "rare"]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, kept string")
    assert qr.judge(docs).first().kept is False
    assert qr.judge(docs.limit(0)).count() == 0
