"""Found items against every window of every size, compared shingle by shingle."""

import math
import random
import re
from collections import Counter

import pytest

from tablewise.llm import decontaminate as dc
from tablewise.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, items):
    """(doc, item) pairs with a window of the item's size at 80 hundredths or more."""
    items = {i: words(t) for i, t in items if words(t)}

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: grams(w, min(5, len(w))) for i, w in items.items()}
    times = Counter(s for x in sets.values() for s in x)
    n = len(items)
    weight = lambda s: round(64 * (1 + math.log(n / max(1, times[s]))))
    out = set()
    for d, t in texts:
        w = words(t)
        have = {k: grams(w, k) for k in range(1, 6)}
        for i, item in items.items():
            k = min(5, len(item))
            if not have[k] & sets[i]:
                continue
            for at in range(len(w) - len(item) + 1):
                mine = grams(w[at : at + len(item)], k)
                both = sum(map(weight, mine & sets[i]))
                if both and 100 * both >= 80 * sum(map(weight, mine | sets[i])):
                    out.add((d, i))
                    break
    return out


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = QUERIES["op3_decontamination"](spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(docs, items) and found
    assert all(r.similarity >= 0.8 for r in found)


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(6)
    voc = [f"w{i}" for i in range(300)] + ["ümlaut", "Straße"]
    items = [(i, " ".join(rnd.choices(voc, k=rnd.randint(12, 50)))) for i in range(40)]
    items += [(90, "Only three words."), (91, ""), (92, items[0][1]), (93, " ".join(voc[:20] + voc[:20]))]
    texts = []
    for d in range(300):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            if w:
                w[rnd.choice([0, 1, len(w) - 1, rnd.randrange(len(w))])] = "edited"
        around = [rnd.choices(voc, k=rnd.randint(0, 60)) for _ in range(2)]
        texts.append((d, ", ".join([*around[0], *w, *around[1]]).upper()))
    texts += [(900, None), (901, ""), (902, "x " * 60_000 + items[3][1]), (903, (items[5][1] + " ") * 400)]
    return texts, items


def test_planted_passages_and_edits(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.matches(docs, bench).collect()
    pairs = [(r.doc_id, r.item_id) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(texts, items)
    hit = {d for d, _ in pairs}
    left = dc.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _ in texts} - hit


def test_blocks_of_items_find_verbatim_copies(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame([(i, t) for i, t in items if t], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = dc.Settings(block_items=10)
    pairs = {(r.doc_id, r.item_id) for r in dc.matches(docs, bench, small).collect()}
    assert {(i, i) for i, t in items if t} <= pairs
    assert dc.clean(docs, bench, small).count() == 0


def test_blocks_give_the_pairs_and_similarities_of_one(spark, planted):
    texts, items = planted
    common = "a line that many of the items have at their end".split()
    items = [(i, t if i % 2 else " ".join([*t.split(), *common])) for i, t in items]
    edited = [(2000 + i, " ".join([*t.split()[1:-1], "edited"])) for i, t in items]
    docs, bench = frames(spark, [*texts, *edited], items)
    small = dc.Settings(block_items=10)
    found = similarities(dc.matches(docs, bench, small))
    assert found == pytest.approx(similarities(dc.matches(docs, bench)))
    assert found == pytest.approx(exact([*texts, *edited], items))
    assert sum(s < 1 for s in found.values()) > 20


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    items = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for _ in range(500)], dtype=np.uint64)
    probes = items[rng.integers(0, 60, 500)] ^ flips
    s = dc.Settings()
    window, item = dc._Index(items, s).search(probes, s)
    want = np.argwhere(np.bitwise_count(probes[:, None] ^ items[None]) <= s.radius)
    assert sorted(map(list, zip(window.tolist(), item.tolist()))) == want.tolist()


def exact(texts, items):
    """(doc, item) pairs and their best similarity over all windows; a text shorter than an item is one."""
    items = {i: words(t) for i, t in items if words(t)}

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: grams(w, min(5, len(w))) for i, w in items.items()}
    times = Counter(s for x in sets.values() for s in x)
    weight = lambda s: round(64 * (1 + math.log(len(items) / max(1, times[s]))))
    out = {}
    for d, t in texts:
        w = words(t)
        have = {k: grams(w, k) for k in range(1, 6)}
        for i, item in items.items():
            k = min(5, len(item))
            if not have[k] & sets[i]:
                continue
            for at in range(max(1, len(w) - len(item) + 1)):
                mine = grams(w[at : at + len(item)], k)
                both, whole = sum(map(weight, mine & sets[i])), sum(map(weight, mine | sets[i]))
                if both and 100 * both >= 80 * whole:
                    out[d, i] = max(out.get((d, i), 0), both / whole)
    return out


def similarities(found):
    return {(r.doc_id, r.item_id): r.similarity for r in found.collect()}


def frames(spark, texts, items):
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_texts_shorter_than_an_item(spark):
    voc = iter(range(100_000))
    items = [(size, " ".join(f"v{next(voc)}" for _ in range(size))) for size in (59, 30, 15, 9, 4, 2)]
    texts = []
    for size, text in items:
        w = text.split()
        for cut in range(size):
            texts += [(1000 * size + cut, " ".join(w[cut:])), (1000 * size + 100 + cut, " ".join(w[: size - cut]))]
            texts.append((1000 * size + 200 + cut, " ".join(["around", *w[cut:]])))
    docs, bench = frames(spark, texts, items)
    found, want = similarities(dc.matches(docs, bench)), exact(texts, items)
    assert found == pytest.approx(want)
    assert {(59_010, 59), (59_110, 59), (30_004, 30), (15_002, 15)} <= set(found)
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}


def test_words_are_runs_of_unicode_letters_marks_and_numbers():
    text = "\u201eÜber\u201c \u00ab\u00a0l\u2019été\u00a0\u00bb \u00bfQué\u2014no? e\u0301t \u0661\u0662 \u65e5\u672c\u3001x_y \u2167"
    want = ["über", "l", "été", "qué", "no", "e\u0301t", "\u0661\u0662", "\u65e5\u672c", "x", "y", "\u2177"]
    assert [w.decode() for w in dc.words_of(text.encode())] == want
    assert dc.words_of(b"a\xffb c") == [b"a", b"b", b"c"]


@pytest.mark.parametrize("left, right, between", [
    ("\u201e", "\u201c", " "), ("\u00ab\u00a0", "\u00a0\u00bb", " "), ("\u00bf", "?", " "), ("\u2019", "\u2019", "\u00a0"), ("\u2014", "\u2013", " \u2014 "),
])
def test_quoted_passages(spark, left, right, between):
    rnd = random.Random(3)
    voc = ["straße", "été", "niño", *[f"w{i}" for i in range(400)]]
    items = [(n, " ".join(rnd.choices(voc, k=n))) for n in (3, 6, 8, 14, 21, 40)]
    texts = [(n, "er sagte " + left + between.join(t.split()) + right + " und ging") for n, t in items]
    texts += [(100 + n, left + t.upper() + right) for n, t in items]
    docs, bench = frames(spark, texts, [(i, left + t + right) if i % 2 else (i, t) for i, t in items])
    found = similarities(dc.matches(docs, bench))
    assert found == pytest.approx(exact(texts, items))
    assert all(found[i, i] == found[100 + i, i] == 1.0 for i, _ in items)


def test_pairs_at_the_threshold_are_never_lost(spark):
    """Small items, windows whose other shingles belong to other items, and phrases that an item repeats."""
    rnd = random.Random(11)
    voc = [f"w{i}" for i in range(5000)]
    items = [(i, rnd.choices(voc, k=rnd.choice([5, 6, 9, 13, 22, 40]))) for i in range(120)]
    for i in range(120, 180):  # an item's words with another's at an end
        head, tail = rnd.choice(items)[1], rnd.choice(items)[1]
        items.append((i, [*head, *tail][: len(head)] if i % 3 else [*head[: -2], *tail[:2]]))
    for i in range(180, 220):
        items.append((i, rnd.choices(voc, k=6) * 3 + rnd.choices(voc, k=rnd.choice([4, 12]))))
    texts = []
    for d in range(900):
        w = list(rnd.choice(items)[1])
        lost = max(1, round(len(w) / 9.5)) if len(w) > 5 else 0
        other = rnd.choice(items)[1]
        w = [*w[: len(w) - lost], *other[:lost]] if d % 2 else [*other[-lost:], *w[lost:]]
        texts.append((d, " ".join([*rnd.choices(voc, k=d % 4), *w, *rnd.choices(voc, k=d % 3)])))
    for i in range(300, 400):  # four of five shingles
        items.append((i, rnd.choices(voc, k=9)))
        texts.append((1000 + i, " ".join(items[-1][1][:-1])))
    items = [(i, " ".join(w)) for i, w in items]
    docs, bench = frames(spark, texts, items)
    found, want = similarities(dc.matches(docs, bench)), exact(texts, items)
    assert found == pytest.approx(want) and {(1000 + i, i) for i in range(300, 400)} <= set(found)
    assert sum(s < 0.82 for s in want.values()) > 50


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.matches(docs.limit(0), bench).count() == 0 and dc.matches(docs, bench.limit(0)).count() == 0
    assert dc.clean(docs, bench.limit(0)).count() == 1 and dc.clean(docs, bench).count() == 0


def test_recall_of_the_fingerprints_alone(spark, planted):
    texts, items = planted
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    long = [(1000 + i, " ".join(rnd.choices(vocabulary, k=rnd.randint(15, 120)))) for i in range(120)]
    edited = []
    for d, (_, item) in enumerate(long * 5):
        w = item.split()
        # as many edits as the threshold bears, at an end or next to each other
        for k in range(rnd.randrange(max(1, len(w) // 12))):
            w[-1 - k] = "edited"
        edited.append((2000 + d, " ".join([*rnd.choices(vocabulary, k=40), *w, *rnd.choices(vocabulary, k=40)])))
    docs = spark.createDataFrame([*texts, *edited], "doc_id long, text string")
    bench = spark.createDataFrame([*items, *long], "item_id long, text string")
    pairs = lambda s: {(r.doc_id, r.item_id) for r in dc.matches(docs, bench, s).collect()}
    alone, all_ = pairs(dc.Settings(exact=False)), pairs(dc.Settings())
    assert all_ == brute([*texts, *edited], [*items, *long])
    assert alone <= all_ and len(alone) >= 0.97 * len(all_) and len(all_) > 600
