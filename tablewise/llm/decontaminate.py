"""Benchmark decontamination: SimHash of item-sized windows, verified by weighted shingles, without misses.

Words are lower-cased runs of Unicode letters, marks and numbers (categories L, M, N); an item is the set of its
shingles of five words (of all its words, if it has fewer), each weighted by how rare it is among all items. For
every distinct item size, each window of that many words of a text is held against the items of that size: the
weight of the common shingles by the weight of all shingles of window and item, foreign ones at full weight.
A text with fewer words than an item is one window as a whole.

A window whose shingles known to the benchmark weigh less than ``hundredths`` of the lightest item of
its size cannot reach the threshold; that bound is exact and spares clean text nearly all the work. Every other
window gets a SimHash, the signs of the weighted sum of the bit vectors of its distinct known shingles, and a
multi-index gives all items of its size whose fingerprint is within ``radius`` bits: of six blocks of the 64 bits one
differs in a sixth of them at most, and items are filed under all values that near. These candidates are verified by
their exact weighted similarity. Sums of distinct shingles come for all windows at once, since a shingle counts in the
windows that begin after its last occurrence.

At the threshold about 10 of 64 bits differ, and no selective radius is without misses, so what the fingerprints do
not give is looked up in an exact way behind them: of an item, a matching window lacks less than the rest to a hundred
by weight, so it holds one of any shingles that weigh more than that, and items are also filed under their rarest
such shingles. The items found there that no fingerprint gave are verified as the others. ``exact=False`` leaves
this out, to measure what the fingerprints find alone.

Texts are read in pieces of bounded size that overlap by an item.

Texts and items without words match nothing. Items with equal words all match. Repeated rows match
alike; ``matches`` returns each pair of ids once. Rows with a null id are in no pair but can be
rejected. The benchmark is taken in blocks of ``block_items`` that are broadcast one after the other, each with
the counts of all shingles that two or more items share, so blocks give the same similarities as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.rows import TEXT, _pieces, with_text_columns, words_of

_PIECE = 4096  # window starts that are looked at together
_MASK = (1 << 20) - 1


@dataclass(frozen=True)
class Settings:
    words: int = 5
    hundredths: int = 80
    radius: int = 16  # bits of 64 in which a fingerprint may differ
    blocks: int = 6
    block_items: int = 20_000
    exact: bool = True  # also look for what the fingerprints miss


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    value = np.full(max(n, 0), np.uint64(size))
    for j in range(size if n > 0 else 0):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


class _Index:
    """Items of one size: their fingerprints under all block values within the block radius."""

    def __init__(self, prints: np.ndarray, settings: Settings):
        self.prints = prints
        edges = np.linspace(0, 64, settings.blocks + 1).astype(int)
        widths, near = np.diff(edges), settings.radius // settings.blocks
        self.shift = edges[:-1].astype(np.uint64)
        self.mask = np.array([(1 << w) - 1 for w in widths.tolist()], dtype=np.uint64)
        # values of all blocks in one table: where a block begins, and where a value's items begin
        self.base = np.append(0, np.cumsum(1 << widths[:-1]))
        values, starts, items = self._values(prints) - self.base, [], []
        for k, width in enumerate(widths.tolist()):
            flips = [sum(1 << b for b in c) for r in range(near + 1) for c in combinations(range(width), r)]
            filed = (values[:, k, None] ^ np.array(flips)[None]).ravel()
            owner = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(filed, kind="stable")
            starts.append(np.searchsorted(filed[order], np.arange(1 << width)) + sum(map(len, items)))
            items.append(owner[order])
        self.items = np.concatenate(items)
        self.starts = np.append(np.concatenate(starts), len(self.items))

    def _values(self, prints: np.ndarray) -> np.ndarray:
        """Place in the table of each block's value."""
        return ((prints[:, None] >> self.shift) & self.mask).astype(np.int64) + self.base

    def search(self, prints: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, each once."""
        values = self._values(prints).ravel()
        lo = self.starts[values]
        n = self.starts[values + 1] - lo
        window = np.repeat(np.arange(len(values)) // settings.blocks, n)
        place = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
        pair = np.unique(window * len(self.prints) + self.items[place])
        window, item = pair // len(self.prints), pair % len(self.prints)
        ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= settings.radius
        return window[ok], item[ok]


@dataclass(frozen=True)
class Rarity:
    """Number of items with words in the whole benchmark, and of those that have a shingle, where it is two or more."""

    items: int
    shared: np.ndarray
    times: np.ndarray


class Benchmark:
    """A block of items, ready to be searched for; picklable, to be broadcast."""

    def __init__(self, items: list[tuple[int, bytes]], rarity: Rarity, settings: Settings = Settings()):
        self.settings, hashes = settings, Hashes()
        named = [(i, words_of(t)) for i, t in items]
        named = [(i, np.array([hashes[x] for x in w], dtype=np.uint64)) for i, w in named if w]
        sets = [np.unique(shingles(h, min(settings.words, len(h)))) for _, h in named]
        # shingles of items in other blocks weigh in a window too, those of one item only as much as foreign ones
        known = np.unique(np.concatenate([*sets, rarity.shared]))
        times = np.ones(len(known), dtype=np.int64)
        times[np.searchsorted(known, rarity.shared)] = rarity.times
        # whole numbers, so that running totals are exact
        self.known = known
        self.foreign = round(64 * (1 + np.log(max(1, rarity.items))))
        self.weight = np.round(64 * (1 + np.log(max(1, rarity.items) / times))).astype(np.int64)
        self.maybe = np.zeros(_MASK + 1, dtype=bool)
        self.maybe[(known & np.uint64(_MASK)).astype(np.int64)] = True
        self.by_size: dict[int, _Items] = {}
        for size in sorted({len(h) for _, h in named}):
            mine = [k for k, (_, h) in enumerate(named) if len(h) == size]
            places = [np.searchsorted(known, sets[k]) for k in mine]
            self.by_size[size] = _Items([named[k][0] for k in mine], places, self)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        """Weighted signs of the bits of known shingles."""
        bits = (self.known[places, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return (2 * bits.astype(np.int64) - 1) * self.weight[places, None]

    def places(self, values: np.ndarray) -> np.ndarray:
        """Place of each shingle among the known ones, -1 for foreign."""
        out = np.full(len(values), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.maybe[(values & np.uint64(_MASK)).astype(np.int64)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, values[maybe]), len(self.known) - 1)
            ok = self.known[at] == values[maybe]
            out[maybe[ok]] = at[ok]
        return out

    def matches(self, h: np.ndarray) -> dict[int, float]:
        """Item ids found in the words of a text, with the best similarity of a window."""
        best: dict[int, float] = {}
        ready: dict[int, tuple] = {}
        for size, items in self.by_size.items():
            k = min(self.settings.words, size)
            if k not in ready:
                values = shingles(h, k)
                places = self.places(values)
                hits = np.flatnonzero(places >= 0)
                ready[k] = values, places, hits, int(self.weight[places[hits]].sum())
            values, places, hits, whole = ready[k]
            if not len(hits) or 100 * whole < self.settings.hundredths * items.least:
                continue  # not even the whole text has the weight
            per_window = min(size - k + 1, len(values))  # a shorter text is one window
            reached = np.concatenate([hits, np.maximum(hits - per_window + 1, 0)])
            for piece in np.unique(reached // _PIECE):
                lo, hi = piece * _PIECE, min((piece + 1) * _PIECE + per_window - 1, len(values))
                if hi - lo >= per_window:
                    self._piece(values[lo:hi], places[lo:hi], per_window, items, best)
        return best

    def _piece(self, values, places, n, items, best) -> None:
        own = np.where(places >= 0, self.weight[places], 0)
        total = np.concatenate([[0], np.cumsum(own)])
        if not (100 * (total[n:] - total[:-n]) >= self.settings.hundredths * items.least).any():
            return  # not even with repeated shingles
        hits = np.flatnonzero(places >= 0)
        first = _first_starts(places[hits], hits, n)
        count = len(values) - n + 1
        whole = _windows(first, hits, self.weight[places[hits]], count)
        starts = np.flatnonzero(100 * whole >= self.settings.hundredths * items.least)
        if not len(starts):
            return
        # hits that some such window holds
        near = np.searchsorted(starts, hits - n + 1) < np.searchsorted(starts, hits, side="right")
        candidates = items.alike(self, places, hits[near], first[near], starts)
        if self.settings.exact:
            rest = items.sharing(places[hits[near]])
            candidates = np.concatenate([candidates, np.setdiff1d(rest, candidates, assume_unique=True)])
        if not len(candidates):
            return
        strange = np.flatnonzero(places < 0)
        whole = whole + self.foreign * _windows(_first_starts(values[strange], strange, n), strange, 1, count)
        for item in candidates.tolist():
            mine = items.places[item]
            at = np.minimum(np.searchsorted(mine, places[hits]), len(mine) - 1)
            held = mine[at] == places[hits]
            common = _windows(first[held], hits[held], self.weight[places[hits[held]]], count)
            union = whole + items.weights[item] - common
            ok = (100 * common >= self.settings.hundredths * union) & (common > 0)
            if ok.any():
                found = float((common[ok] / union[ok]).max())
                best[items.ids[item]] = max(best.get(items.ids[item], 0.0), found)


class _Items:
    """The items of one size, with the means to find those that a window can match."""

    def __init__(self, ids: list, places: list[np.ndarray], block: Benchmark):
        self.ids, self.places, self.settings, self.index = ids, places, block.settings, None
        self.weights = [int(block.weight[p].sum()) for p in places]
        self.least = min(self.weights)
        self.prints = _signs(np.stack([block.vectors(p).sum(axis=0) for p in places]))
        filed, owners = [], []
        for k, (p, whole) in enumerate(zip(places, self.weights)):
            rare = p[np.argsort(-block.weight[p], kind="stable")]
            # the first that weigh more than what a matching window may lack
            lack = (100 - block.settings.hundredths) * whole
            enough = int(np.searchsorted(100 * np.cumsum(block.weight[rare]), lack, side="right")) + 1
            filed.append(rare[:enough])
            owners.append(np.full(len(filed[-1]), k))
        filed, owners = np.concatenate(filed), np.concatenate(owners)
        order = np.argsort(filed, kind="stable")
        self.filed, self.owners = filed[order], owners[order]

    def alike(self, block: Benchmark, places, hits, first, starts) -> np.ndarray:
        """Items with a fingerprint near that of a window from one of ``starts``, each once."""
        if self.index is None:  # made in the task, not sent to it
            self.index = _Index(self.prints, self.settings)
        # running totals over what has begun and what has ended at a start; runs of windows share both
        order = np.argsort(first, kind="stable")
        begun = np.searchsorted(first[order], starts, side="right")
        ended = np.searchsorted(hits, starts, side="left")
        new = np.append(True, (begun[1:] != begun[:-1]) | (ended[1:] != ended[:-1]))
        values = block.vectors(places[hits])
        none = np.zeros((1, 64), dtype=np.int64)
        sums = np.concatenate([none, np.cumsum(values[order], axis=0)])[begun[new]]
        sums -= np.concatenate([none, np.cumsum(values, axis=0)])[ended[new]]
        prints = np.unique(_signs(sums))
        return np.unique(self.index.search(prints, self.settings)[1])

    def sharing(self, places: np.ndarray) -> np.ndarray:
        """Items filed under one of the shingles, each once."""
        seen = np.unique(places)
        lo, hi = np.searchsorted(self.filed, seen), np.searchsorted(self.filed, seen, side="right")
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(lo, hi)] or [hi]))


def _first_starts(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """First window of ``n`` shingles in which the value at a place has not come before."""
    order = np.argsort(values, kind="stable")
    before = np.full(len(at), -1, dtype=np.int64)
    same = values[order[1:]] == values[order[:-1]]
    before[order[1:][same]] = at[order[:-1][same]]
    return np.maximum(np.maximum(before + 1, at - n + 1), 0)


def _windows(first: np.ndarray, at: np.ndarray, weight, count: int) -> np.ndarray:
    """For each of ``count`` windows, the weight of its distinct shingles: each counts from ``first`` to ``at``."""
    step = np.zeros(count + 1, dtype=np.int64)
    on = first < count
    weight = np.broadcast_to(weight, at.shape)[on]
    np.add.at(step, first[on], weight)
    np.add.at(step, np.minimum(at[on] + 1, count), -weight)
    return np.cumsum(step[:-1])


def _signs(sums: np.ndarray) -> np.ndarray:
    bits = np.packbits(sums > 0, axis=1, bitorder="little")
    return bits.view("<u8").ravel().astype(np.uint64)


def rarity(items: DataFrame, settings: Settings = Settings()) -> Rarity:
    """Counts over all items, of a binary column ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sets = Hashes(), []
            for text in batch.column("t").to_pylist():
                h = np.array([hashes[x] for x in words_of(text)], dtype=np.uint64)
                if len(h):
                    sets.append(np.unique(shingles(h, min(settings.words, len(h)))))
            # a null for each item
            found = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found, pa.nulls(len(sets), pa.int64())])], names=["shingle"])

    counts = items.select("t").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    got = counts.where("shingle IS NULL OR times > 1").toArrow()
    shingle, times = got.column("shingle"), got.column("times").to_numpy()
    null = shingle.is_null().to_numpy()
    return Rarity(int(times[null].sum()), shingle.drop_null().to_numpy().view(np.uint64), times[~null])


def benchmark_blocks(benchmark: DataFrame, settings: Settings = Settings()) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_items`` by the hash of their id."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").alias("i"), F.col("text").cast("binary").alias("t"))
    blocks, counted = max(1, -(-items.count() // settings.block_items)), rarity(items, settings)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        yield Benchmark(sorted((r[0], bytes(r[1])) for r in rows), counted, settings)


def _finder(shared):
    """Per task: texts to the matches of each."""
    hashes, block = Hashes(), shared.value

    def found(texts: list) -> list[dict[int, float]]:
        if len(hashes) > 500_000:
            hashes.clear()
        words = [words_of(t) for t in texts]
        return [block.matches(np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))) for w in words]

    return found


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``item_id`` and best ``similarity`` of every item found in a document."""
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias(TEXT))
    out = None
    for block in benchmark_blocks(benchmark, settings):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = _finder(shared)
            for whole in batches:
                for batch in _pieces(whole, 4 << 20):
                    ids = batch.column("doc_id").to_pylist()
                    rows = [
                        (i, item, sim)
                        for i, m in zip(ids, found(batch.column(TEXT).to_pylist()))
                        for item, sim in m.items()
                    ]
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else []
                    if rows:
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity"])

        part = texts.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without any benchmark item, with all their columns; no shuffle."""
    for block in benchmark_blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            found = _finder(shared)
            return lambda texts: [[not m for m in found(texts)]]

        docs = with_text_columns(docs, "text", docs.columns, "__ok boolean", make, only="__ok")
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
