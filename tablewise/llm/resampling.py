"""Importance resampling towards a target distribution over hashed word runs.

A text's words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. Its
features are all runs of 1 to ``grams`` consecutive words, joined by one space, repeats counted; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. A bucket's gain says how much more
likely the target table is to use it than the source table (both smoothed by one), a text's weight is
the floored mean of its features' gains, and the highest weights plus Gumbel noise are drawn: a sample
without replacement in proportion to the exponential of the weight. The noise is a hash of the id.

Hashing is done in tasks on CRC matrices: the distinct features of a run of texts are grouped by
length into two-dimensional byte arrays, all CRCs of a group advance together, one column at a time,
and the results are scattered back to the occurrences. A feature beyond ``LONG`` bytes, of which a
group holds few, is left to zlib, which gives the same number.

Texts are read twice (counts, then weights) and never shuffled. What reaches the driver and goes back
to the tasks is one number per bucket. Ranks need only rows at or above the score at which the quota
is reached; that score comes from the rows per distinct score (whole numbers).

Null and empty texts, and texts without words, have no features and weight 0. A null id hashes like an
empty one and comes last among equal scores. Rows that repeat an id are rows of their own; when they
tie in score, too, their ranks are interchangeable. An empty source table gives no rows, an empty
target table the gains of an empty target. Extra columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.rows import with_text_columns
from tablewise.operators.ranking import global_rank
from tablewise.shared import stored

LONG = 1024  # bytes from which a feature is hashed by itself
_RUN = 8 << 20  # bytes of text that are hashed together


@dataclass(frozen=True)
class Settings:
    grams: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10  # of the documents long enough
    min_words: int = 20


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC: eight steps of the reflected polynomial of CRC-32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_STEP = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crcs(features: pa.Array) -> np.ndarray:
    """CRC-32 of every value of a large-binary array without nulls, as uint32."""
    offsets = np.frombuffer(features.buffers()[1], dtype=np.int64)[features.offset :][: len(features) + 1]
    raw = features.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros(len(features), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        size = int(sizes[rows[0]])
        if size > LONG:
            out[rows] = [zlib.crc32(data[offsets[k] : offsets[k] + size]) for k in rows]
            continue
        matrix = data[offsets[rows][:, None] + np.arange(size)]
        crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for column in range(size):
            crc = _STEP[(crc ^ matrix[:, column]) & 255] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def _words(texts: Sequence[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text that each is from."""
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    joined = b"\n".join([b"", *(t or b"" for t in texts), b""])  # a word never starts or ends the bytes
    data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = _IN_WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]
    )
    return words, np.searchsorted(np.cumsum(sizes + 1), starts - 1, side="right")


def features(texts: Sequence[bytes | None], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the number of words of every text."""
    words, text = _words(texts)
    found, of = [], []
    for n in range(1, settings.grams + 1):
        if len(words) < n:
            break
        last = len(words) - n + 1
        same = text[:last] == text[n - 1 :]
        runs = words
        if n > 1:
            parts = [words.slice(k, last) for k in range(n)]
            runs = pc.filter(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), pa.array(same))
        distinct = runs.dictionary_encode()
        buckets = crcs(distinct.dictionary).astype(np.int64) % settings.buckets
        found.append(buckets[distinct.indices.to_numpy()])
        of.append(text[:last][same])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found or none), np.concatenate(of or none), np.bincount(text, minlength=len(texts))


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """How often each bucket is hit by the column ``text``: one number per bucket for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for piece in _runs(batch.column("text").to_pylist()):
                total += np.bincount(features(piece, settings)[0], minlength=settings.buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(settings.buckets, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def _runs(texts: list) -> Iterator[list]:
    """Runs of texts of about ``_RUN`` bytes; a longer text is a run of its own."""
    left, size = [], 0
    for t in texts:
        if left and size + len(t or b"") > _RUN:
            yield left
            left, size = [], 0
        left.append(t)
        size += len(t or b"")
    if left:
        yield left


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of the smoothed ratio of each bucket, floored."""
    n = len(source)
    over, under = float(source.sum() + n), float(target.sum() + n)
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in pairs], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, settings: Settings, keep: Sequence[str]) -> DataFrame:
    """The columns to keep, ``n_words``, ``n_features`` and ``weight`` of every row's ``text``."""

    def make():
        def columns(texts: list):
            bucket, text, words = features(texts, settings)
            count = np.bincount(text, minlength=len(texts))
            total = np.zeros(len(texts), dtype=np.int64)
            np.add.at(total, text, gain[bucket])
            return words, count, total // np.maximum(count, 1)

        return columns

    return with_text_columns(docs, "text", keep, "n_words bigint, n_features bigint, weight bigint", make, budget=_RUN)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel number made from the id, floored."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def _scored(docs: DataFrame, target: DataFrame, settings: Settings, keep: Sequence[str]) -> DataFrame:
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    weighed = weigh(docs, gain, settings, keep)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed))


def draw(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` of every row of ``docs``, and its ``rank`` among
    the drawn ones, null for the others."""
    scored = stored(_scored(docs.select("doc_id", "text"), target, settings, ["doc_id"]), "weights")
    enough = F.col("n_words") >= settings.min_words
    quota = scored.where(enough).count() * settings.percent // 100
    # scores are whole numbers between the bounds of gains and noise: one row each is few
    sizes = scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("rows"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sizes.withColumn("upto", F.sum("rows").over(down)).where(F.col("upto") >= quota)
    last = reached.orderBy(F.desc("score")).first()
    shown = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if not quota:
        return scored.select(*shown, none)
    near = enough & (F.col("score") >= last["score"])
    ranked = global_rank(scored.where(near).select(*shown), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = ranked.select(*shown, F.when(F.col("rank") <= quota, F.col("rank").cast("bigint")).alias("rank"))
    return drawn.unionByName(scored.where(~near).select(*shown, none))


def sample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    The drawn ids come from ``draw``; texts only meet them in the join. Rows that repeat an id stay or
    go together, rows with a null id go.
    """
    drawn = draw(docs, target, settings).where("rank IS NOT NULL AND doc_id IS NOT NULL")
    return docs.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
