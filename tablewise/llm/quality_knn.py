"""Quality by nearest neighbours in a latent semantic space.

A text is a bag of hashed words, word shapes and repetitions, damped by the logarithm and weighted by
rarity among the labelled texts. A truncated singular value decomposition of the labelled bags,
by random projection and power rounds in numpy, gives the latent space. The labelled vectors are
broadcast (their number is bounded by ``sample_docs``), every text's cosine with every one of them
is computed in blocks, and the nearest vote with their label, weighted by a power of the similarity.

A null or empty text, and one that shares nothing with the labelled ones, has no neighbours: its score
is the share of good texts among the labelled, one half without labels. Ties between equally near
neighbours go to the one with the smaller id. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.rows import held_out, with_text_columns


@dataclass(frozen=True)
class Settings:
    """Size of the space and of the vote; the sample bounds what is broadcast."""

    words: int = 1 << 12  # buckets of words
    shapes: int = 1 << 9  # buckets of word shapes
    shape_weight: float = 2.0
    dimensions: int = 48
    neighbours: int = 15
    power: float = 6.0
    sample_docs: int = 6000  # labelled texts, at most
    sample_bytes: int = 20_000  # longer labelled texts are left out of the fit
    seed: int = 11

    @property
    def features(self) -> int:
        return self.words + self.shapes + len(_COUNTS)


@dataclass
class Model:
    settings: Settings
    rarity: np.ndarray
    space: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, of length one
    labels: np.ndarray
    share: float


_COUNTS = ("repeated", "seen", "lines")
_SHAPE = bytes(
    ord("a") if 97 <= c <= 122 or c > 127 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Words(dict):
    """Word bucket of each word; shape buckets are kept beside it."""

    def __init__(self, settings: Settings):
        super().__init__()
        self.settings, self.codes = settings, array("i")

    def __missing__(self, word: bytes) -> int:
        s = self.settings
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        self.codes.extend((crc32(word.lower()) % s.words, s.words + crc32(shape) % s.shapes))
        self[word] = n = len(self)
        return n


def _bags(texts: list, words: _Words) -> np.ndarray:
    """Damped counts of the features, texts x features."""
    s = words.settings
    if len(words) > 300_000:  # a cache only; memory stays bounded
        words.clear()
        words.codes = array("i")
    places, sizes, lines = [], [], []
    for t in texts:
        found = (t or b"").split()
        places.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
        sizes.append(len(found))
        lines.append((t or b"").count(b"\n"))
    ids = np.concatenate(places) if places else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = np.array(words.codes, dtype=np.int64).reshape(-1, 2)
    base = owner * s.features
    bag = np.bincount(np.concatenate([base + codes[ids, 0], base + codes[ids, 1]]), minlength=len(texts) * s.features)
    bag = bag.reshape(len(texts), s.features).astype(np.float32)
    again = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    different = np.array([len(set(p.tolist())) for p in places])
    n = np.array(sizes)
    shares = [200 * again / (n + 20), 20 * (n - different) / (n + 20), lines]  # short texts count less
    bag[:, -3:] = np.stack(shares, axis=1).reshape(-1, 3)
    np.log1p(bag, out=bag)
    bag[:, s.words :] *= s.shape_weight
    return bag


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def train(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """Space and labelled vectors; equal input gives an equal model."""
    s, rng = settings, np.random.default_rng(settings.seed)
    y = np.array(labels, dtype=np.float32)
    share = float(y.mean()) if len(y) else 0.5
    words = _Words(s)
    step = 500
    bags = [_bags(texts[i : i + step], words) for i in range(0, len(texts), step)]
    bags = np.concatenate(bags) if bags else np.zeros((0, s.features), dtype=np.float32)
    rarity = np.log((1 + len(texts)) / (1 + (bags > 0).sum(axis=0))).astype(np.float32)
    rarity = np.maximum(rarity, 0.1)
    rarity[-3:] = 1
    bags = _unit(bags * rarity)
    width = s.dimensions + 16
    sketch = bags.T @ (bags @ rng.normal(size=(s.features, width)).astype(np.float32))
    for _ in range(3):
        sketch = np.linalg.qr(sketch)[0]
        sketch = bags.T @ (bags @ sketch)
    basis = np.linalg.qr(sketch)[0].astype(np.float32)
    space = basis
    if len(texts):
        turned = np.linalg.svd(bags @ basis, full_matrices=False)[2]
        space = (basis @ turned.T)[:, : s.dimensions].astype(np.float32)
    return Model(s, rarity, space, _unit(bags @ space), y, share)


def vectors(model: Model, texts: list, words: _Words) -> np.ndarray:
    return _unit((_bags(texts, words) * model.rarity) @ model.space)


def vote(model: Model, found: np.ndarray, block: int = 256) -> np.ndarray:
    """Score of each latent vector: the labels of its nearest, weighted by similarity."""
    out = np.full(len(found), model.share)
    k = min(model.settings.neighbours, len(model.labels))
    for at in range(0, len(found) if k else 0, block):
        # rounded, so that equal vectors are equal in every block
        close = np.round(found[at : at + block] @ model.vectors.T, 5)
        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(close, near, axis=1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((close >= least).sum(axis=1) > k):
            # of those at the last similarity the smaller ids, which come first
            above, level = np.flatnonzero(close[row] > least[row]), np.flatnonzero(close[row] == least[row])
            near[row] = np.append(above, level[: k - len(above)])
        weight = np.maximum(np.take_along_axis(close, near, axis=1), 0) ** model.settings.power
        total = weight.sum(axis=1)
        voted = (weight * model.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        out[at : at + block] = np.where(total > 0, voted, model.share)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the labelled rows outside the held-out fold.

    The fit takes at most ``sample_docs`` labelled ids, chosen by their hash, of which texts over
    ``sample_bytes`` are left out; the ids are a bounded table, so the documents are not shuffled. A
    document with several labels counts as good only if all say so; of repeated documents one is
    taken.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__good"))
    sample = marks.where(~held_out(F.col("__id"), 3, 1)).orderBy(F.xxhash64("__id"), "__id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    rows = (
        texts.where(F.length("__text") <= settings.sample_bytes)
        .join(F.broadcast(sample.limit(settings.sample_docs)), F.col("doc_id") == F.col("__id"))
        .groupBy("__id")
        .agg(F.min("__text").alias("__text"), F.first("__good").alias("__good"))
        .collect()
    )
    rows = sorted(rows)
    return train([bytes(r[1]) for r in rows], [int(r[2]) for r in rows], settings)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, words = shared.value, _Words(shared.value.settings)

        def columns(texts: list) -> list:
            value = np.concatenate(
                [vote(model, vectors(model, texts[i : i + 512], words)) for i in range(0, len(texts), 512)]
                or [np.zeros(0)]
            )
            return [value, (value >= 0.5).astype(np.int32)]

        return columns

    return with_text_columns(docs, "text", keep, "score double, predicted int", make)
