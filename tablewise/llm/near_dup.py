"""Near duplicates by b-bit MinHash.

Every text becomes the set of its word shingles and a signature of minima. Bands of whole minima
find candidates; of each minimum only the low bits are kept, packed, and the share of equal packed
values, corrected for chance agreement, estimates the similarity of candidates. What the estimate
does not rule out is confirmed on the full sets, in whole numbers.

How groups of any size stay in bounds:

- equal sets count once, by a hash of the whole set; a group of copies is one row from there on;
- a band value with many members is cut into blocks, and blocks are compared pairwise in tasks;
- within a block no pair becomes a row except those that hold a part of the group together: a
  spanning forest of the estimates, or all of them while they are at most a few per member;
- pairs that a forest leaves out matter only if its own links fail. Where confirmed links leave such
  a group in several pieces, its members meet again in blocks with their full sets, and every pair of
  different pieces is compared exactly;
- components come from rounds over stored link tables.

A document without words has an empty set and is linked with nothing. A null id takes part in
nothing: its component is null and it is kept. Repeated rows of one id are equal sets, so both carry
the same component. ``kept`` is true where the id is its component's smallest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.graph import components
from tablewise.llm.rows import bounds, groups, with_text_columns
from tablewise.operators.ranking import free_name
from tablewise.shared import stored

_BITS = 4  # kept of each minimum
_SLOTS = 16  # packed in 64 bits
_PLACES = np.uint64(0x1111111111111111)
_EMIT = 4  # estimated pairs per member that are confirmed without a forest


@dataclass(frozen=True)
class Settings:
    """Shingle size, threshold (a share in hundredths) and shape of the signature.

    A pair at the threshold is missed by all bands with probability (1 - t ** rows) ** bands: below
    one in a million for the two settings in use.
    """

    words: int = 5
    hundredths: int = 80
    bands: int = 28
    rows: int = 4
    block: int = 512  # members of a band value compared in one task, per side
    exact_block: int = 256  # the same for full sets
    filter_bits: int = 1 << 26  # of the bitmap that says whose sets are needed; its size is fixed

    @property
    def share(self) -> float:
        return self.hundredths / 100

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def packed(self) -> int:
        return -(-self.minima // _SLOTS)

    @property
    def cut(self) -> float:
        """Estimates below this are ruled out: five standard errors under the threshold."""
        chance = 2.0**-_BITS
        p = chance + (1 - chance) * self.share
        return self.share - 5 * math.sqrt(p * (1 - p) / self.minima) / (1 - chance)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Shingles:
    """Sorted sets of 64-bit shingle hashes; the cache of words is bounded."""

    def __init__(self, words: int):
        self.words, self.cache = words, _Hashes()

    def __call__(self, texts: list) -> list[np.ndarray]:
        if len(self.cache) > 500_000:
            self.cache.clear()
        out, k = [], self.words
        for t in texts:
            found = (t or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
            n = len(found)
            if not n:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            h = np.fromiter(map(self.cache.__getitem__, found), dtype=np.uint64, count=n)
            size = min(k, n)
            value = _mixed(h[: n - size + 1] + np.uint64(size))
            for j in range(1, size):
                value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
            out.append(np.unique(value))
        return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """``id``, ``n_shingles``, ``set_key`` (null without words), packed ``sig`` and ``keys`` of bands."""

    def make():
        shingles = _Shingles(settings.words)
        rng = np.random.default_rng(1)
        mult = rng.integers(0, 1 << 63, settings.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, settings.minima, dtype=np.uint64)
        seeds = rng.integers(0, 1 << 63, settings.bands, dtype=np.uint64)
        slots = settings.packed * _SLOTS
        shift = np.arange(_SLOTS, dtype=np.uint64) * np.uint64(_BITS)

        def columns(texts: list) -> list:
            sizes, set_keys, sigs, keys = [], [], [], []
            for s in shingles(texts):
                sizes.append(len(s))
                if not len(s):
                    set_keys.append(None), sigs.append(None), keys.append([])
                    continue
                least = np.full(settings.minima, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(s), 512):
                    part = s[at : at + 512, None] * mult + plus
                    np.minimum(least, part.min(axis=0), out=least)
                least = _mixed(least)
                band = seeds.copy()
                for row in least.reshape(settings.bands, settings.rows).T:
                    band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + row)
                low = np.zeros(slots, dtype=np.uint64)
                low[: settings.minima] = least & np.uint64((1 << _BITS) - 1)
                set_keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append((low.reshape(-1, _SLOTS) << shift).sum(axis=1, dtype=np.uint64).tobytes())
                keys.append(band.view(np.int64))
            return [sizes, set_keys, sigs, keys]

        return columns

    named = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    added = "n_shingles bigint, set_key binary, sig binary, keys array<bigint>"
    return with_text_columns(named, "text", ["id"], added, make)


def _estimates(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarity from packed signatures: the share of equal values, less what chance gives."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & _PLACES).sum(axis=-1, dtype=np.int32)
    chance = 2.0**-_BITS
    return (1 - differ / settings.minima - chance) / (1 - chance)


def _forest(near: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``near`` (square, boolean) that join pieces; ``labels`` is updated in place."""
    out = []
    for x in range(len(near)):
        ys = np.flatnonzero(near[x])
        roots, first = np.unique(labels[ys], return_index=True)
        other = roots != labels[x]
        if other.any():
            out += [(x, int(ys[i])) for i in first[other]]
            labels[np.isin(labels, roots[other])] = labels[x]
    return out


def _candidates(settings: Settings):
    """Sorted rows of band values to pairs to confirm."""
    t, cut = settings.hundredths, settings.cut
    few = 2 * _EMIT + 1
    at = {s: np.triu_indices(s, 1) for s in range(2, few + 1)}

    def of_block(ids, sigs, sizes, side):
        m = len(ids)
        near = np.zeros((m, m), dtype=bool)
        sure = np.zeros((m, m), dtype=bool)
        for x in range(0, m, 64):
            e = _estimates(sigs[x : x + 64, None], sigs[None], settings)
            small = np.minimum(sizes[x : x + 64, None], sizes[None])
            large = np.maximum(sizes[x : x + 64, None], sizes[None])
            ok = (e >= cut) & (100 * small >= t * large)
            near[x : x + 64] = ok
            sure[x : x + 64] = ok & (e >= settings.share)
        np.fill_diagonal(near, False)
        if side[0] != side[-1] or (side != side[0]).any():
            near &= side[:, None] != side[None]
        sure &= near
        if near.sum() <= 2 * _EMIT * m:
            a, b = np.nonzero(np.triu(near))
            return list(zip(a, b)), False
        labels = np.arange(m)
        return _forest(sure, labels) + _forest(near, labels), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "i", "j"]):
            ends = bounds(table, ["key", "i", "j"])
            ids, sizes = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
            side, i, j = (table.column(c).to_numpy() for c in ("side", "i", "j"))
            raw = b"".join(table.column("sig").to_pylist())
            sigs = np.frombuffer(raw, dtype=np.uint64).reshape(len(ids), settings.packed)
            starts, counts = ends[:-1], np.diff(ends)
            found_a, found_b, dense = [], [], []
            for s, (p, q) in at.items():
                mine = starts[(counts == s) & (i[starts] == j[starts])]
                if len(mine):
                    a, b = (mine[:, None] + p).ravel(), (mine[:, None] + q).ravel()
                    e = _estimates(sigs[a], sigs[b], settings)
                    ok = e >= cut
                    ok &= 100 * np.minimum(sizes[a], sizes[b]) >= t * np.maximum(sizes[a], sizes[b])
                    found_a.append(ids[a[ok]]), found_b.append(ids[b[ok]])
                    dense.append(np.zeros(int(ok.sum()), dtype=bool))
            for k in np.flatnonzero((counts > few) | ((i[starts] != j[starts]) & (counts > 1))):
                own = slice(starts[k], ends[k + 1])
                pairs, left = of_block(ids[own], sigs[own], sizes[own], side[own])
                if pairs:
                    p, q = np.array(pairs).T + starts[k]
                    found_a.append(ids[p]), found_b.append(ids[q])
                    dense.append(np.full(len(p), left))
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                arrays = [np.minimum(a, b), np.maximum(a, b), np.concatenate(dense)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "dense"])

    return run


def _blocks(rows: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """One row per pair of blocks that a member takes part in; ``n`` is the size of its group."""
    blocks = F.ceil(F.col("n") / F.lit(size)).cast("int")
    cut = rows.withColumn("__blocks", blocks).withColumn(
        "side", F.pmod(F.xxhash64(group, member), F.col("__blocks")).cast("int")
    )
    pair = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("__blocks") - 1),
            lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j")),
        )
    )
    return cut.withColumn("__pair", pair).select("*", "__pair.i", "__pair.j").drop("__blocks", "__pair", "n")


def _needed(ids: DataFrame, settings: Settings) -> np.ndarray:
    """Bitmap of the hashes of ``id``: a fixed number of bits, so a bounded result for the driver."""
    bit = F.pmod(F.xxhash64("id"), F.lit(settings.filter_bits))
    words = (
        ids.select(F.shiftright(bit, 5).alias("w"), F.pmod(bit, F.lit(32)).cast("int").alias("k"))
        .groupBy("w")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k"))).alias("v"))
        .toPandas()
    )
    out = np.zeros(settings.filter_bits // 32, dtype=np.uint32)
    out[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _full_sets(docs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """``id`` and its whole set, for the ids in question; texts are read again and never shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_needed(ids, settings))
    hashed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("id"),
        F.pmod(F.xxhash64("doc_id"), F.lit(settings.filter_bits)).alias("__bit"),
        F.col("text").cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, needed = _Shingles(settings.words), shared.value
        for batch in batches:
            bit = batch.column("__bit").to_numpy()
            ok = (needed[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
            part = batch.filter(pa.array(ok))
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                sets = [s.tobytes() for s in shingles(piece.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(sets, type=pa.binary())], names=["id", "shingles"]
                )

    found = hashed.mapInArrow(run, "id bigint, shingles binary")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                one = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                two = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate([one, two]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * shared >= settings.hundredths * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


def _rest(settings: Settings):
    """Links between different pieces of a group, from full sets in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster", "i", "j"]):
            ends = bounds(table, ["cluster", "i", "j"])
            for lo, hi in zip(ends[:-1], ends[1:]):
                ids, piece = (table.column(c).to_numpy()[lo:hi] for c in ("id", "component"))
                side, i, j = (table.column(c).to_numpy()[lo:hi] for c in ("side", "i", "j"))
                if (piece == piece[0]).all():
                    continue
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")[lo:hi]]
                sizes = np.array([len(s) for s in sets])
                union = sizes[:, None] + sizes[None]
                inter = _intersections(sets, sizes)
                near = 100 * inter >= settings.hundredths * (union - inter)
                near &= piece[:, None] != piece[None]
                if i[0] != j[0]:
                    near &= side[:, None] != side[None]
                labels = np.unique(piece, return_inverse=True)[1]
                pairs = _forest(near, labels)
                if pairs:
                    a, b = ids[np.array(pairs).T]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Sizes of all intersections: products of slices of the member x shingle matrix."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    seen, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[lo:hi], code[lo:hi] - at] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    marked = stored(signatures(docs, settings), "signatures")
    real = marked.where(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    reps = stored(
        real.groupBy("set_key").agg(
            F.min("id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
            F.first("keys").alias("keys"),
        ),
        "representatives",
    )
    bands = reps.select(F.explode("keys").alias("key"), "rep")
    shared = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    members = bands.join(shared, "key").join(reps.select("rep", "n_shingles", "sig"), "rep")
    dealt = _blocks(members, "key", "rep", settings.block).repartition("key", "i", "j")
    dealt = dealt.sortWithinPartitions("key", "i", "j", "rep")
    found = dealt.mapInArrow(_candidates(settings), "a bigint, b bigint, dense boolean")
    pairs = stored(found.groupBy("a", "b").agg(F.max("dense").alias("dense")), "pairs")

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(_full_sets(docs, stored(ids, "ids"), settings), "sets")
    links = stored(_confirmed(pairs, sets, settings), "confirmed")
    parts = stored(components(links), "components")

    dense = pairs.where("dense").select("a", "b")
    if not dense.isEmpty():
        groups_ = stored(components(dense), "groups").withColumnRenamed("component", "cluster")
        placed = stored(
            groups_.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed"
        )
        open_ = (
            placed.groupBy("cluster", "component").count().groupBy("cluster")
            .agg(F.sum("count").alias("n"), F.count("*").alias("__pieces"))
            .where("__pieces > 1").drop("__pieces")
        )
        again = placed.join(stored(open_, "open"), "cluster")
        again = _blocks(again, "cluster", "id", settings.exact_block).join(sets, "id")
        again = again.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
        more = stored(again.mapInArrow(_rest(settings), "a bigint, b bigint"), "more")
        if not more.isEmpty():
            parts = stored(components(links.unionByName(more)), "components")

    of_set = reps.select("set_key", "rep").join(parts, F.col("rep") == F.col("id"), "left")
    of_set = stored(of_set.select("set_key", F.coalesce("component", "rep").alias("__found")), "found")
    return (
        marked.select("id", "n_shingles", "set_key")
        .join(of_set, "set_key", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("__found", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents kept, with all their columns. Of rows that repeat an id one stays, whatever their
    texts; rows without an id all stay.

    Texts are not shuffled, but those of ids that go or repeat, and the few more that a bitmap of fixed
    size takes for them; an exact join follows.
    """
    found = stored(near_duplicates(docs, settings).select("doc_id", "kept"), "kept")
    ids = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    moved = ids.agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1")
    moved = stored(moved.select("id", "kept"), "moved")
    shared = docs.sparkSession.sparkContext.broadcast(_needed(moved.select("id"), settings))

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    # Python sees the hash of the id alone
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(settings.filter_bits))
    near = F.col("doc_id").isNotNull() & maybe(hashed)
    mark, row = free_name(docs, "__moved"), F.struct(*docs.columns).alias("row")
    marked = docs.withColumn(mark, F.coalesce(near, F.lit(False)))
    asked = marked.where(mark).select(F.col("doc_id").cast("bigint").alias("id"), row)
    known = asked.join(moved, "id", "left").where("kept IS NULL OR kept")
    alone = known.where("kept IS NULL").select("row.*")
    # an id that repeats: a plain aggregate would sort whole rows, so the first in each group is taken
    again = known.where("kept").groupBy("id").agg(F.first("row").alias("row")).select("row.*")
    return marked.where(~F.col(mark)).drop(mark).unionByName(alone).unionByName(again)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays."""
    return one_of_each(docs)
