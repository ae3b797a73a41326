"""Quality rules as a short-circuit cascade.

Measures that everyone wants (``BASE``) are taken of every text. Then rules run one after the other,
each only on the texts that all rules before it have passed. Their order comes from a sample: a rule
that rejects much for little time goes first (rejections per second). A text is kept when no rule
rejects it, so the order decides the cost and never the verdict.

Words are runs without the six ASCII blanks. A text without words, null or empty, has measures of
zero and fails the base. Repeated rows get equal results.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.rows import TEXT, with_text_columns

WINDOW = 8  # words of a repeated passage

# fixed values: characters that count as symbols
SYMBOLS = b"#*$%&|<>"
_CONTINUES = bytes(range(128, 192))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = bytes(97 if chr(c).isalpha() or c > 127 else c if c in b" \t\n\r\x0b\x0c" else 46 for c in range(256))


@dataclass
class Text:
    """A text as bytes, its words and its base measures."""

    raw: bytes
    words: list[bytes]
    word_chars: int = 0
    n_symbols: int = 0
    n_lines: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = field(default=False)


def measured(texts: Sequence[bytes | None], hashes: dict) -> list[Text]:
    out = [Text(t or b"", (t or b"").split()) for t in texts]
    for d in out:
        plain = d.raw.translate(None, b" \t\n\r\x0b\x0c")
        # every byte of UTF-8 that does not continue a character is one code point
        d.word_chars = len(plain.translate(None, _CONTINUES))
        d.n_symbols = len(plain) - len(plain.translate(None, SYMBOLS))
        lines = [x for x in d.raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        d.n_lines, d.n_dup_lines = len(lines), len(lines) - len(set(lines))
    for d, n in zip(out, _repeats([d.words for d in out], hashes)):
        d.n_repeat_words = n
        d.base_failed = len(d.words) < 20 or 100 * n > 30 * len(d.words)
    return out


class Hashes(dict):
    """Bounded by the caller."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _repeats(docs: list[list[bytes]], hashes: dict) -> list[int]:
    """Words of each text that lie in an 8-word window found twice or more in it.

    Windows are compared by a rolling mix of 64-bit word hashes; those that look equal are then
    compared hash by hash, and a text in which a mix lied is counted by its windows themselves.
    """
    sizes = np.array([len(w) for w in docs], dtype=np.int64)
    out = np.zeros(len(docs), dtype=np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return out.tolist()
    h = np.fromiter((hashes[w] for d in docs for w in d), dtype=np.uint64, count=total)
    owner = np.repeat(np.arange(len(docs)), sizes)
    n = total - WINDOW + 1
    mix = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(WINDOW):
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order = starts[np.argsort(mix[starts], kind="stable")]
    same = np.flatnonzero(mix[order[1:]] == mix[order[:-1]])
    if not len(same):
        return out.tolist()
    a, b = order[same], order[same + 1]
    lied = (owner[a] != owner[b]) | (h[a[:, None] + np.arange(WINDOW)] != h[b[:, None] + np.arange(WINDOW)]).any(axis=1)
    covered = np.zeros(total + 1, dtype=np.int64)
    twice = np.unique(np.concatenate([a, b]))
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out += np.bincount(owner[inside], minlength=len(docs))
    for d in np.unique(np.concatenate([owner[a[lied]], owner[b[lied]]])):
        out[d] = _repeats_exact(docs[d])
    return out.tolist()


def _repeats_exact(words: list[bytes]) -> int:
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(WINDOW)}
    return len(inside)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _shouts(d: Text) -> bool:
    letters = len(d.raw) - len(d.raw.translate(None, _LETTERS))
    upper = len(d.raw) - len(d.raw.translate(None, _UPPER))
    return 2 * upper > letters > 0


def _one_word(d: Text) -> bool:
    return 10 * Counter(d.words).most_common(1)[0][1] > 3 * len(d.words)


def _stutters(d: Text) -> bool:
    return 5 * sum(map(bytes.__eq__, d.words, d.words[1:])) > len(d.words)


def _wordless(d: Text) -> bool:
    return 5 * sum(b"a" in w for w in d.raw.translate(_MARKS).split()) < 3 * len(d.words)


RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > len(d.words)),
    Rule("repeated lines", lambda d: 10 * d.n_dup_lines > 3 * d.n_lines),
    Rule("word length", lambda d: not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words)),
    Rule("exclamations", lambda d: 10 * d.raw.count(b"!") > 3 * len(d.words)),
    Rule("capitals", _shouts),
    Rule("one word", _one_word),
    Rule("stutter", _stutters),
    Rule("words without letters", _wordless),
)



def plan(sample: Sequence[bytes], rules: Sequence[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules in the order to run them, with seconds per text and share rejected on the sample.

    Each rule is timed on the whole sample. One that rejects nothing comes last, cheapest first;
    without a sample the given order stays.
    """
    docs = measured(sample, Hashes())
    docs = [d for d in docs if not d.base_failed]
    rated = []
    for rule in rules:
        begun = time.perf_counter()
        rejected = sum(rule.rejects(d) for d in docs)
        cost = (time.perf_counter() - begun) / max(1, len(docs))
        rated.append((rule, max(cost, 1e-9), rejected / max(1, len(docs))))
    if not docs:
        return rated
    return sorted(rated, key=lambda r: (-r[2] / r[1], r[1]))


def sample_of(docs: DataFrame, rows: int = 1000, max_bytes: int = 50_000) -> list[bytes]:
    """Texts of the ids with the smallest hashes, without those over ``max_bytes``: a bounded sample that
    does not depend on how the rows are stored."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias(TEXT)).where(f"length({TEXT}) <= {max_bytes}")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(TEXT).alias(TEXT))
    return [bytes(r[1]) for r in sorted(found.collect())]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with the base measures, ``base_failed`` and ``kept``."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    order = [r.name for r, _, _ in plan(sample_of(docs), rules)]
    named = {r.name: r for r in rules}
    cascade = [named[n] for n in order]

    def make():
        hashes = Hashes()

        def columns(texts: list) -> list:
            if len(hashes) > 500_000:
                hashes.clear()
            found = measured(texts, hashes)
            left = [k for k, d in enumerate(found) if not d.base_failed]
            for rule in cascade:
                left = [k for k in left if not rule.rejects(found[k])]
            kept = np.zeros(len(found), dtype=bool)
            kept[left] = True
            return [
                [len(d.words) for d in found],
                [d.word_chars for d in found],
                [d.n_symbols for d in found],
                [d.n_dup_lines for d in found],
                [d.n_repeat_words for d in found],
                [d.base_failed for d in found],
                kept,
            ]

        return columns

    added = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
        " base_failed boolean, kept boolean"
    )
    return with_text_columns(docs, "text", keep, added, make)
