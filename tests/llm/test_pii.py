"""Grown spans against the patterns themselves, scanned from left to right."""

import hashlib
import random
import re

import pytest

from tablewise.llm import pii
from tablewise.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(d) for d in digits[-1::-2]] + [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def scanned(text):
    found = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return [(s, kind, e) for s, _, kind, e in sorted(found)]


def test_fuzz_against_the_patterns():
    rnd, cues = random.Random(5), pii.automaton()
    parts = ["1", "23", "255", "256", "4111111111111111", "+1", "+", " ", "-", ".", "@", "a", "b.c", "é", "(", ")", "%"]
    parts += ["4539 1488 0343 6467", "x@y.com", "1.2.3.4", "\n", "0", "+49 (30) 123-4567", "٣"]
    for _ in range(30_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in pii.spans(text, cues) if s[1] in pii.BASE] == scanned(text), text


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = scanned(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[1] == k for w in want) for k in pii.BASE)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text, spans",
    [
        ("see https://a.example/x?y=1 now", [(4, "url", 27)]),
        ("IBAN: DE89 3704 0044 0532 0130 00 end", [(6, "iban", 33)]),
        ("IBAN DE88370400440532013000", []),
        ("Iban: DE89 3704 0044 0532 0130 00", [(6, "iban", 33)]),
        ("my iban DE89370400440532013000.", [(8, "iban", 30)]),
        ("pay GB82-WEST-1234-5698-7654-32 or BE71 0961 2345 6769 now", [(4, "iban", 31), (35, "iban", 54)]),
        ("DE89370400440532013000 12 and xDE89370400440532013000", [(0, "iban", 22)]),
        ("ACCOUNT 12345678", [(8, "account", 16)]),
        ("Kontonummer 12345678", [(12, "account", 20)]),
        ("número de CUENTA NR: 1234-5678", [(21, "account", 30)]),
        ("account of 12345678", []),
        ("account no. 123 456 789", [(12, "account", 23)]),
        ("", []),
    ],
)
def test_added_kinds(text, spans):
    assert [s for s in pii.spans(text, pii.automaton()) if s[1] in pii.ADDED] == spans


def test_masks_nulls_long_texts_and_clashing_columns(spark):
    long = "x " * 200_000 + "a.b@c.de"
    rows = [(1, None, 1), (2, "", 2), (3, "mail a@b.cd, 1.2.3.4", 3), (3, "mail a@b.cd, 1.2.3.4", 3), (4, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    assert pii.find(docs.selectExpr("*", "1 AS __text")).count() == 5
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == 5 and found[3].n_email == 1 and found[1].spans == ""
    assert found[4].spans == "email:400000:400008"
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[1] is None and texts[3] == "mail [EMAIL], [IP]" and texts[4].endswith("x [EMAIL]")
    assert pii.find(docs.limit(0)).count() == 0
