"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the rows that the word itself and its first letters hash to, so
that an unseen word of a known stem is not a stranger. Filters one, two and three words wide run
over the text, each keeps its largest response, and a logistic layer reads them. Training is plain
numpy on the driver over a bounded sample; scoring is a map over whole texts with the filters'
responses worked out once per distinct word.

The score is calibrated by language: texts are put into a language by their function words (the
table's language column is not read), and each language has its own threshold, which lands on 0.5.

Null and empty texts get the score of a text without words. Words are lower-cased runs of Unicode
letters, marks and numbers. Repeated rows get equal scores. A training set without both labels gives the constant
share of toxic rows (0 for none).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.rows import held_out, with_text_columns, words_of

# fixed values: function words that tell a language, none of them shared by two
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "was", "for", "it", "this", "are", "from"],
    "de": ["der", "und", "die", "das", "den", "mit", "von", "ist", "nicht", "ein", "zu", "auf", "für"],
    "fr": ["le", "les", "des", "et", "est", "dans", "une", "pour", "que", "sur", "du", "au", "pas"],
    "es": ["el", "los", "las", "y", "por", "con", "del", "se", "su", "como", "para", "al", "no"],
}
LANGUAGES = ["other", *FUNCTION_WORDS]

WIDTHS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """Size of the network and of its training; the sample bounds what the driver holds."""

    buckets: int = 1 << 18
    dim: int = 6
    filters: int = 4
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)  # bytes
    epochs: int = 6
    batch: int = 32
    rate: float = 0.02
    prior: float = 6.0  # documents that a hashed piece has to outvote before training
    sample_docs: int = 6000  # labelled rows the classifier is fitted on, at most
    sample_bytes: int = 20_000  # longer labelled texts are left out of the fit
    calibration: float = 0.25  # share of the sample that sets the thresholds
    least: int = 5  # calibration rows of each label that a language needs for its own threshold
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    table: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # per width: width x dim x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray  # logit per language


class _Words(dict):
    """Ids of words from 1 in order of first sight, with the hashed pieces of each."""

    def __init__(self, settings: Settings):
        super().__init__()
        self.settings, self.pieces, self.tells = settings, array("i"), array("b")
        self.language = {w.encode(): i + 1 for i, k in enumerate(FUNCTION_WORDS) for w in FUNCTION_WORDS[k]}

    def __missing__(self, word: bytes) -> int:
        mask = self.settings.buckets - 1
        ends = [word[:n] for n in self.settings.prefixes]
        self.pieces.extend([crc32(word, 1) & mask, *[crc32(p) & mask for p in ends]])
        self.tells.append(self.language.get(word, 0))
        self[word] = n = len(self) + 1
        return n

    def start_again(self) -> None:
        self.clear()
        self.pieces, self.tells = array("i"), array("b")

    def pieces_from(self, first: int) -> np.ndarray:
        width = 1 + len(self.settings.prefixes)
        return np.array(self.pieces[first * width :], dtype=np.int32).reshape(-1, width)


def _flat(texts: list, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row, 0 for none, with two zeros behind each text; and starts.

    A text without words has one zero of its own, so that every text has a place to look at.
    """
    ids, starts = [], []
    for t in texts:
        starts.append(len(ids))
        found = words_of(t)
        ids.extend(map(words.__getitem__, found) if found else (0,))
        ids.extend((0, 0))
    return np.array(ids, dtype=np.int32), np.array(starts, dtype=np.int64)


def _guess(ids: np.ndarray, starts: np.ndarray, tells: np.ndarray) -> np.ndarray:
    """Language number of each text: the one with most function words, 0 for none or a tie at the
    smallest number otherwise."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    told = tells[ids]
    hits = np.stack([np.add.reduceat((told == k).astype(np.int32), starts) for k in range(1, len(LANGUAGES))])
    best = hits.argmax(axis=0) + 1
    return np.where(hits.max(axis=0) > 0, best, 0)


def _reach(model_filters: list[np.ndarray], vectors: np.ndarray) -> list[list[np.ndarray]]:
    """Responses of each filter's positions for each word: [width][position] is words x filters."""
    return [[vectors @ f[j] for j in range(f.shape[0])] for f in model_filters]


def _pool(reach, ids: np.ndarray, starts: np.ndarray, bias: np.ndarray):
    """Largest response of each filter per text, texts x (widths * filters)."""
    ends = np.append(starts[1:], len(ids))
    return np.concatenate([np.maximum.reduceat(_responses(p, ids, ends), starts, axis=0) for p in reach], axis=1) + bias


def _responses(positions: list[np.ndarray], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Response of each filter of one width at each place; none where it would reach into the next text."""
    total = positions[0][ids]
    for j in range(1, len(positions)):
        total[:-j] += positions[j][ids[j:]]
    for j in range(1, len(positions)):
        total[ends - j] = -np.inf
    return total


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _vectors(table: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Sum of the rows of each word's pieces, a column of pieces at a time."""
    out = np.zeros((len(pieces), table.shape[1]), dtype=table.dtype)
    for column in pieces.T:
        out += table[column]
    return out


def _first_guess(docs: list, y: np.ndarray, pieces: np.ndarray, settings: Settings) -> np.ndarray:
    """Log odds of toxic documents among those that have a hashed piece, against the whole share."""
    counts = np.zeros((2, settings.buckets))
    for ids, mark in zip(docs, y):
        counts[int(mark), np.unique(pieces[np.unique(ids[ids > 0]) - 1])] += 1
    share, a = y.mean(), settings.prior
    odds = np.log((counts[1] + a * share) / (counts[0] + a * (1 - share)) * (1 - share) / share)
    return odds.astype(np.float32)


def train(texts: list[bytes], toxic: list[int], settings: Settings = Settings()) -> Model:
    """Fit filters, embeddings and thresholds; equal input gives an equal model.

    The first embedding column starts at the log odds of its pieces, and one filter of each width
    starts by reading it; the rest starts at random. All of it is then trained by Adagrad.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    n_features = len(WIDTHS) * s.filters
    table = rng.normal(0, 0.05, (s.buckets, s.dim)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, s.dim, s.filters)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(n_features, dtype=np.float32)
    weights = rng.normal(0, 0.1, n_features).astype(np.float32)
    y = np.array(toxic, dtype=np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        flat = np.zeros(len(LANGUAGES))
        return Model(s, table, filters, bias, 0 * weights, 30.0 if share else -30.0, flat)

    words = _Words(s)
    docs = [_flat([t], words)[0] for t in texts]
    pieces, tells = words.pieces_from(0), np.array([0, *words.tells])
    order = rng.permutation(len(docs))
    n_held = int(len(docs) * s.calibration)
    held, fit = order[:n_held], order[n_held:]
    if not (0 < y[fit].sum() < len(fit) and 0 < y[held].sum() < len(held)):
        held = fit = order
    table[:, 0] = _first_guess([docs[i] for i in fit], y[fit], pieces, s) / pieces.shape[1]
    for k, f in enumerate(filters):
        f[:, :, 0] = 0
        f[:, 0, 0] = 1
        bias[k * s.filters] = -2
        weights[k * s.filters] = 1
    offset = 0.0

    dense = [*filters, bias, weights]
    seen_dense = [np.full_like(p, 1e-3) for p in dense]
    seen_table = np.full(s.buckets, 1e-3, dtype=np.float32)
    for _ in range(s.epochs):
        for at in range(0, len(fit), s.batch):
            chosen = fit[at : at + s.batch]
            ids = np.concatenate([docs[i] for i in chosen])
            lengths = np.array([len(docs[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            seen, local = np.unique(ids, return_inverse=True)
            real = (seen > 0).astype(np.float32)
            own = np.maximum(seen - 1, 0)
            vectors = table[pieces[own]].sum(axis=1) * real[:, None]
            tops, places = [], []
            for positions in _reach(filters, vectors):
                total = _responses(positions, local, starts + lengths)
                place = np.stack([a + total[a : a + m].argmax(axis=0) for a, m in zip(starts, lengths)])
                tops.append(np.take_along_axis(total, place, axis=0))
                places.append(place)
            active = np.tanh((np.concatenate(tops, axis=1) + bias) / 4)
            p = _sigmoid(4 * (active @ weights) + offset)
            error = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            g_pool = np.outer(error, weights).astype(np.float32) * (1 - active**2)
            grads = [np.zeros_like(f) for f in filters] + [g_pool.sum(axis=0), 4 * (active.T @ error)]
            offset -= s.rate * 4 * float(error.sum())
            g_vec = np.zeros_like(vectors)
            for k, place in enumerate(places):
                g = g_pool[:, k * s.filters : (k + 1) * s.filters]
                for j in range(filters[k].shape[0]):
                    w = local[place + j]
                    grads[k][j] += np.einsum("tfd,tf->df", vectors[w], g)
                    np.add.at(g_vec, w, g[:, :, None] * filters[k][j].T[None])
            live = np.flatnonzero(np.abs(g_vec).sum(axis=1) * real)
            rows, where = np.unique(pieces[own[live]], return_inverse=True)
            g_rows = np.zeros((len(rows), s.dim), dtype=np.float32)
            np.add.at(g_rows, where.ravel(), np.repeat(g_vec[live], pieces.shape[1], axis=0))
            seen_table[rows] += (g_rows**2).sum(axis=1)
            table[rows] -= s.rate * g_rows / np.sqrt(seen_table[rows])[:, None]
            for p_, g_, n_ in zip(dense, grads, seen_dense):
                n_ += g_ * g_
                p_ -= s.rate * g_ / np.sqrt(n_)
        fit = rng.permutation(fit)

    model = Model(s, table, filters, bias, weights, offset, np.zeros(len(LANGUAGES)))
    none = np.zeros((1, s.dim), dtype=np.float32)
    reach = _reach(filters, np.concatenate([none, _vectors(table, pieces)]))
    logits, languages = np.empty(len(held)), np.empty(len(held), dtype=np.int64)
    start = np.zeros(1, dtype=np.int64)
    for n, i in enumerate(held):
        logits[n] = _logit(model, reach, docs[i], start)[0]
        languages[n] = _guess(docs[i], start, tells)[0]
    overall = _threshold(logits, y[held])
    for k in range(len(LANGUAGES)):
        mine = languages == k
        enough = min(y[held][mine].sum(), (1 - y[held][mine]).sum()) >= s.least
        model.thresholds[k] = _threshold(logits[mine], y[held][mine]) if enough else overall
    return model


def _logit(model: Model, reach, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    pooled = _pool(reach, ids, starts, model.bias)
    return 4 * (np.tanh(pooled / 4) @ model.weights) + model.offset


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    found = t[::-1].cumsum()[::-1]
    f1 = 2 * found / (np.arange(len(z), 0, -1) + t.sum())
    cuts = np.flatnonzero(f1 >= f1.max() - 1e-12)
    below = np.where(cuts > 0, z[cuts - 1], z[0] - 2)
    widest = np.argmax(z[cuts] - below)
    return float((z[cuts[widest]] + below[widest]) / 2)


class _Room:
    """Responses of the words met so far; row 0 is no word."""

    def __init__(self, reach):
        self.reach, self.tells, self.used = reach, np.zeros(1, dtype=np.int64), 1

    def add(self, more, tells: np.ndarray) -> None:
        end = self.used + len(tells)
        size = max(end, 2 * len(self.tells)) if end > len(self.tells) else len(self.tells)
        self.reach = [[self._put(a, b, size, end) for a, b in zip(x, z)] for x, z in zip(self.reach, more)]
        self.tells = self._put(self.tells, tells, size, end)
        self.used = end

    def _put(self, old, new, size: int, end: int):
        if size > len(old):
            old = np.concatenate([old[: self.used], np.zeros((size - self.used, *old.shape[1:]), old.dtype)])
        old[self.used : end] = new
        return old


def scorer(model: Model) -> Callable[[], Callable[[list], list]]:
    """Per task: texts to [score, predicted]."""

    def make():
        words = _Words(model.settings)
        reach = [[np.zeros((1, f.shape[2]), dtype=np.float32)] * f.shape[0] for f in model.filters]
        room = _Room(reach)

        def score(texts: list) -> list:
            if len(words) > 300_000:  # a cache only; memory stays bounded
                words.start_again()
                room.used = 1
            ids, starts = _flat(texts, words)
            if len(words) >= room.used:
                fresh = words.pieces_from(room.used - 1)
                room.add(
                    _reach(model.filters, _vectors(model.table, fresh)),
                    np.array(words.tells[room.used - 1 :], dtype=np.int64),
                )
            if not len(starts):
                return [np.zeros(0), np.zeros(0, dtype=np.int32)]
            logit = _logit(model, room.reach, ids, starts)
            value = _sigmoid(logit - model.thresholds[_guess(ids, starts, room.tells)])
            value = value.astype(np.float64)
            return [value, (value >= 0.5).astype(np.int32)]

        return score

    return make


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the labelled rows outside the held-out fold.

    The fit takes at most ``sample_docs`` labelled ids, chosen by their hash, of which texts over
    ``sample_bytes`` are left out; the ids are a bounded table, so the documents are not shuffled.
    Rows without label or text are left out; a document with several labels counts as toxic if one
    says so, and of repeated documents one is taken.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    sample = marks.where(~held_out(F.col("__id"), 5, 0)).orderBy(F.xxhash64("__id"), "__id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    rows = (
        texts.where(F.length("__text") <= settings.sample_bytes)
        .join(F.broadcast(sample.limit(settings.sample_docs)), F.col("doc_id") == F.col("__id"))
        .groupBy("__id")
        .agg(F.min("__text").alias("__text"), F.first("__toxic").alias("__toxic"))
        .collect()
    )
    rows = sorted(rows)
    return train([bytes(r[1]) for r in rows], [int(r[2]) for r in rows], settings)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    return with_text_columns(docs, "text", keep, "score double, predicted int", scorer(model))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with all their columns."""

    def make():
        run = scorer(model)()
        return lambda texts: [run(texts)[1] == 0]

    return with_text_columns(docs, "text", docs.columns, "__ok boolean", make, only="__ok")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: toxic documents go."""
    return reject(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
