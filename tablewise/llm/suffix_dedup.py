"""Removal of long byte strings that come more than once, by suffix arrays in shards.

Texts are bytes of UTF-8. Every byte covered by a string of ``length`` bytes that also starts anywhere
else (in another row or the same one) goes; overlaps count, no string crosses rows, and all strings are
judged on the input. That is exact; only 128-bit digests stand for equal texts, segments and windows.

1. *Segments.* Of the ``gram``-byte runs within a window of ``length`` bytes the one with the smallest
   hash (the first of equals) is the window's anchor. Equal windows have equal anchors, so a text is cut
   into runs of window starts with one anchor: segments, about one per hundred bytes. Segments that are
   equal byte for byte are counted before any text moves, so a group of copies is one segment with a
   count. An anchor that comes once holds no repeat and goes no further.
2. *Shards.* The different segments of an anchor meet in a shard, many anchors to a shard. A shard sorts
   its suffixes by Larsson and Sadakane's refinement (groups of equal ranks are split by the rank ``h``
   bytes on, ``h`` doubles, sorted groups are left alone) and gets the common prefixes of neighbours as
   Kasai does, many stretches of text in step. Windows whose common prefix is ``length`` are equal; a
   window is repeated if its equals in the shard, with their counts, are two or more.
3. *Merging.* The segments of a frequent anchor (over ``hot`` different ones) are dealt to several shards,
   whose windows have to meet, too. First every ``stride``-th place, counted from the anchor, sends the digest
   of the string that the windows around it have in common; the sorted runs of all shards meet by digest, and
   binary search in the merged run finds strings that several shards hold. Only windows around these
   send digests of their own, each different one of a shard once, and are merged in the same way.
4. *Cutting.* Repeated starts go back to the texts that hold the segment; a text with any is cut. A text
   that comes twice as a whole and has ``length`` bytes needs no cutting: all of it goes.

Texts move through a shuffle only to be cut or to hand segments to shards; fixed-size bitmaps keep back
the others, and an exact join follows. Null and empty texts have 0 bytes and no spans, as do all texts
shorter than ``length``. Ids may be null or repeated: every row counts as a place of its own. An empty
table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.rows import bounds, groups
from tablewise.shared import stored


@dataclass(frozen=True)
class Settings:
    length: int = 400  # bytes of a string that may come once
    gram: int = 128  # bytes of an anchor: a power of two from 8 on, at most ``length``
    shard_bytes: int = 1 << 20  # bytes sorted together
    hot: int = 1000  # different segments of one anchor in one shard
    stride: int = 16  # windows that are merged by a common string first
    filter_bits: int = 1 << 26  # of the bitmaps that keep texts back


# --- suffix arrays ---------------------------------------------------------------------------------


def _eights(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), order + "u8", padded.data, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` bytes at least.

    ``rank`` is the place of the first member of a suffix's group. Only groups with several members
    are looked at again, and their members are sorted by the rank of the suffix ``h`` bytes on.
    """
    n = len(data)
    first = _eights(data, ">")
    order = np.argsort(first, kind="stable")
    key = first[order]
    head = np.append(True, key[1:] != key[:-1])[:n]
    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(head, at, 0))
    rank[order] = group
    h = 8
    while h < depth:
        # slots of groups that are not sorted yet
        alone = head & np.append(head[1:], True)[:n]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        here = order[slots]
        further = np.where(here + h < n, rank[np.minimum(here + h, n - 1)], -1)
        key = group[slots] * (n + 1) + further + 1
        move = np.argsort(key, kind="stable")
        key, here = key[move], here[move]
        order[slots] = here
        head[slots] = np.append(True, key[1:] != key[:-1])
        group[slots] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        rank[here] = group[slots]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, stretch: int = 256) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, ``limit`` at most.

    Kasai: a suffix shares at least one byte less with its neighbour than the suffix one byte before
    does with its own. Stretches of the text are walked in step, each with its own running value.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    eights = _eights(data, "<")
    starts = np.arange(0, n, stretch)
    running = np.zeros(len(starts), dtype=np.int64)
    found = np.zeros(n, dtype=np.int64)
    for step in range(min(stretch, n)):
        here = starts + step
        if here[-1] >= n:
            here, running = here[:-1], running[:-1]
            starts = starts[:-1]
        there = before[here]
        most = np.minimum(limit, n - np.maximum(here, there))
        running = np.where(there < 0, 0, np.minimum(np.maximum(running - 1, 0), most))
        open_ = np.flatnonzero((there >= 0) & (running < most))
        while len(open_):
            i, j, h = here[open_], there[open_], running[open_]
            differ = eights[i + h] ^ eights[j + h]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            running[open_] = np.minimum(h + same, most[open_])
            open_ = open_[(same == 8) & (running[open_] < most[open_])]
        found[here] = running
    return found[order]


# --- segments --------------------------------------------------------------------------------------

_PLACE = np.uint64((1 << 24) - 1)  # low bits of a key: where it is
_PIECE = 1 << 20  # window starts that are looked at together


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position on."""
    n = len(data) - gram + 1
    h = _eights(data, "<") * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 8
    while size < gram:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        size *= 2
    h ^= h >> np.uint64(31)
    return h[:n]


def segments(data: np.ndarray, ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """Cut joined texts (up to 16 MB, each with ``length`` bytes or more, given by their ends) into
    segments: first window start, number of starts, hash of the anchor and where it is."""
    hashes = _gram_hashes(data, settings.gram)
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    wide, have = settings.length - settings.gram + 1, 1
    while 2 * have <= wide:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < wide:
        key = np.minimum(key[: len(key) - (wide - have)], key[wide - have :])
    ok = np.ones(len(key), dtype=bool)
    last = ends[:-1] - settings.length + 1  # the starts from here to the text's end cross it
    for k in range(settings.length - 1):
        ok[last + k] = False
    starts = np.flatnonzero(ok)
    owner = (key[starts] & _PLACE).astype(np.int64)
    new = np.append(True, (np.diff(starts) != 1) | (np.diff(owner) != 0))
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), hashes[owner[first]].view(np.int64), owner[first]


def _pieces(texts: Sequence[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (text number, offset, bytes) with about ``_PIECE`` starts; long texts in overlapping parts."""
    left, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, _PIECE):
            part = text[at : at + _PIECE + length - 1]
            if left and size + len(part) > _PIECE + length:
                yield left
                left, size = [], 0
            left.append((k, at, part))
            size += len(part)
    if left:
        yield left


_SEGMENT = "anchor bigint, digest binary, text_key binary, at bigint, starts bigint, place bigint, times bigint"


def _cut(settings: Settings):
    """Rows of texts to rows of segments; equal segments behind each other are one row with a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("text_key"), batch.column("text").to_pylist()
            for piece in _pieces(texts, settings.length):
                data = b"".join(p for *_, p in piece)
                ends = np.cumsum([len(p) for *_, p in piece])
                at, starts, anchor, owner = segments(np.frombuffer(data, dtype=np.uint8), ends, settings)
                stop = at + starts + settings.length - 1
                raw = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), stop.tolist())])
                halves = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
                on = (halves[1:] == halves[:-1]).all(axis=1) & (at[1:] == at[:-1] + starts[:-1])
                first = np.flatnonzero(np.append(True, ~on))
                times = np.diff(np.append(first, len(at)))
                of = np.searchsorted(ends, at[first], side="right")
                text, offset = np.array([k for k, *_ in piece]), np.array([o for _, o, _ in piece])
                begin = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[first]),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(raw)])
                        .take(pa.array(first))
                        .cast(pa.binary()),
                        keys.take(pa.array(text[of])),
                        pa.array(at[first] - begin[of] + offset[of]),
                        pa.array(starts[first]),
                        pa.array(owner[first] - at[first]),
                        pa.array(times),
                    ],
                    names=["anchor", "digest", "text_key", "at", "starts", "place", "times"],
                )

    return run


# --- shards ----------------------------------------------------------------------------------------

_FOUND = "merge boolean, anchor bigint, part bigint, digest binary, low bigint, high bigint, window1 bigint, window2 bigint"


def _shards(table: pa.Table, settings: Settings) -> Iterator[pa.Table]:
    """Runs of whole groups with about ``shard_bytes`` of text."""
    size = np.array([len(b) for b in table.column("body").to_pylist()], dtype=np.int64)
    anchor, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
    upto, start = np.append(0, np.cumsum(size)), 0
    for end in [*edge.tolist(), len(size)]:
        if end == len(size) or upto[end] - upto[start] >= settings.shard_bytes:
            yield table.slice(start, end - start)
            start = end


def repeated_windows(bodies: Sequence[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For all window starts of the bodies in suffix order: place in the joined bodies, number of the
    run of equal windows, and how often the run's windows come together."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    body = np.repeat(np.arange(len(bodies)), sizes)
    # to the end: Kasai's rule holds for suffixes in full order only
    order = suffix_array(data, len(data))
    run = np.cumsum(common_prefixes(data, order, length) < length)
    whole = (np.cumsum(sizes)[body] - np.arange(len(data)) >= length)[order]
    place, run = order[whole], run[whole]
    total = np.zeros(int(run.max()) + 1 if len(run) else 0, dtype=np.int64)
    np.add.at(total, run, times[body[place]])
    return place, run, total[run]


def _judge(settings: Settings):
    """Segments, sorted by anchor, part and digest, to ranges of repeated starts; for an anchor in
    several parts also the digests of strings that its windows have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["anchor", "part"]):
            for shard in _shards(table, settings):
                yield from judged(shard)

    def judged(shard: pa.Table) -> Iterator[pa.RecordBatch]:
        digests = shard.column("digest").to_pylist()
        anchors = shard.column("anchor").to_numpy()
        # a segment may have been read from several rows with one id and text
        new = [k for k in range(len(digests)) if not k or digests[k] != digests[k - 1] or anchors[k] != anchors[k - 1]]
        shard = shard.take(pa.array(new, type=pa.int64()))
        bodies = shard.column("body").to_pylist()
        begin = np.append(0, np.cumsum([len(b) for b in bodies]))
        place, _, count = repeated_windows(bodies, shard.column("times").to_numpy(), settings.length)
        hit = np.sort(place[count >= 2])
        body = np.searchsorted(begin, hit, side="right") - 1
        first = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(body) != 0))) if len(hit) else hit
        low = hit[first] - begin[body[first]]
        high = low + np.diff(np.append(first, len(hit)))
        yield _found(shard, False, body[first], low, high, b"")
        split = np.flatnonzero(shard.column("parts").to_numpy() > 1).tolist()
        anchor_at = shard.column("place").to_numpy()
        spots = [(k, at) for k in split for at in _spots(len(bodies[k]), int(anchor_at[k]), settings)]
        size = settings.length - settings.stride + 1
        raw = b"".join([blake2b(bodies[k][at : at + size], digest_size=16).digest() for k, at in spots])
        body, low = np.array([k for k, _ in spots], dtype=np.int64), np.array([at for _, at in spots], dtype=np.int64)
        yield _found(shard, True, body, low, low + 1, raw)

    return run


def _spots(size: int, anchor_at: int, settings: Settings) -> range:
    """Places in a body of which each window has the next one, counted from the anchor, in its first bytes."""
    starts = size - settings.length + 1
    first = (anchor_at % settings.stride) if settings.stride > 1 else 0
    return range(first, starts - 1 + settings.stride, settings.stride)


def _windows_around(settings: Settings):
    """Bodies with a matched spot, sorted by anchor and part, to the windows around it: of equal ones in
    a part one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["anchor", "part"]):
            edges = bounds(table, ["anchor", "part"])
            bodies, spots = table.column("body").to_pylist(), table.column("low").to_pylist()
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                seen: dict[bytes, tuple[int, int]] = {}
                for k in range(start, end):
                    last = min(spots[k], len(bodies[k]) - settings.length)
                    for at in range(max(0, spots[k] - settings.stride + 1), last + 1):
                        window = blake2b(bodies[k][at : at + settings.length], digest_size=16).digest()
                        seen.setdefault(window, (k, at))
                body = np.array([k for k, _ in seen.values()], dtype=np.int64)
                low = np.array([at for _, at in seen.values()], dtype=np.int64)
                yield _found(table, True, body, low, low + 1, b"".join(seen))

    return run


def _found(table: pa.Table, merge: bool, body: np.ndarray, low: np.ndarray, high: np.ndarray, raw: bytes) -> pa.RecordBatch:
    halves = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2) if raw else np.zeros((len(body), 2), dtype=np.int64)
    chosen = table.select(["anchor", "part", "digest"]).take(pa.array(body, type=pa.int64()))
    columns = [pa.array(np.full(len(body), merge)), *(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in chosen.columns)]
    columns += [pa.array(low), pa.array(high), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _FOUND.split(", ")])


_MERGED = "anchor bigint, part bigint, digest binary, low bigint, high bigint"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of digests to the rows whose digest came from several parts."""
    for table in groups(batches, ["window1"]):
        one, two = table.column("window1").to_numpy(), table.column("window2").to_numpy()
        part = table.column("part").to_numpy()
        left, right = np.searchsorted(one, one, side="left"), np.searchsorted(one, one, side="right")
        # within equal first halves the rows are sorted by the second half, then by part
        hit = np.zeros(len(one), dtype=bool)
        for a, b in np.unique(np.stack([left, right], axis=1)[right - left > 1], axis=0).tolist():
            low, high = (a + np.searchsorted(two[a:b], two[a:b], side=side) for side in ("left", "right"))
            hit[a:b] = part[low] != part[high - 1]
        yield from table.select([f.split()[0] for f in _MERGED.split(", ")]).filter(pa.array(hit)).to_batches()


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose digest several parts of an anchor have sent."""
    runs = rows.repartition("window1").sortWithinPartitions("window1", "window2", "part")
    return runs.mapInArrow(_merge, _MERGED)


# --- the operator ----------------------------------------------------------------------------------


def _bitmap(rows: DataFrame, keys: Sequence[str], settings: Settings) -> np.ndarray:
    """Bits of the hashes of the keys: a fixed number, whatever the rows."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(settings.filter_bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(32)).cast("int"))
    words = rows.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(one).alias("v")).toPandas()
    out = np.zeros(settings.filter_bits // 32, dtype=np.uint32)
    out[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _texts_of(texts: DataFrame, wanted: DataFrame, keys: Sequence[str], settings: Settings) -> DataFrame:
    """``texts`` joined to ``wanted`` on the keys (nulls are equal); what the bitmap rules out is not shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(wanted, keys, settings))
    hashed = texts.withColumn("bit", F.pmod(F.xxhash64(*keys), F.lit(settings.filter_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = shared.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            ok = (needed[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
            yield batch.filter(pa.array(ok))

    near = hashed.mapInArrow(run, hashed.schema).drop("bit")
    right = wanted.select(*[F.col(k).alias(f"wanted_{k}") for k in keys], *[c for c in wanted.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"wanted_{k}")) for k in keys]
    return near.join(right, same).drop(*[f"wanted_{k}" for k in keys])


def _bodies(settings: Settings):
    """Texts with the segments asked of them to rows of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                asked = row.column("asked").flatten()
                text = memoryview(row.column("text")[0].as_buffer())
                at, starts = asked.field("at").to_numpy(), asked.field("starts").to_numpy()
                body = [bytes(text[a : a + n + settings.length - 1]) for a, n in zip(at.tolist(), starts.tolist())]
                names = ["anchor", "part", "parts", "digest", "times", "place"]
                yield pa.RecordBatch.from_arrays(
                    [*(asked.field(c) for c in names), pa.array(body, type=pa.binary())], names=[*names, "body"]
                )

    return run


def _repeated(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole rows without their text, how often each text comes, and the texts with their repeated starts."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    hashed = docs.select("doc_id", raw.alias("text")).withColumn("sha256", F.sha2("text", 256))
    # half of the SHA-256 names a text
    texts = hashed.select("doc_id", _key(F.col("sha256")).alias("text_key"), "text").where(F.octet_length("text") >= settings.length)
    slim = stored(hashed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "sha256"), "texts")
    of_text = slim.where(F.col("n_bytes") >= settings.length).groupBy(_key(F.col("sha256")).alias("text_key"))
    of_text = stored(of_text.agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id")), "copies")

    cut = stored(texts.select("text_key", "text").mapInArrow(_cut(settings), _SEGMENT), "segments")
    kinds = cut.groupBy("anchor", "digest").agg(
        F.sum("times").alias("times"), F.min(F.struct("text_key", "at", "starts", "place")).alias("first")
    )
    kinds = stored(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all"))
    known = stored(kinds.join(anchors.where(F.col("all") > 1).drop("all"), "anchor"), "known")

    parts = F.ceil(F.col("kinds") / F.lit(settings.hot)).cast("bigint")
    several = known.where(F.col("kinds") > 1).select(
        "anchor",
        F.pmod(F.xxhash64("digest"), parts).alias("part"),
        parts.alias("parts"),
        "digest",
        "times",
        "first.*",
    )
    asked = several.groupBy("text_key").agg(
        F.collect_list(F.struct("anchor", "part", "parts", "digest", "times", "at", "starts", "place")).alias("asked")
    )
    asked = stored(asked.join(of_text.drop("rows"), "text_key"), "asked")
    schema = "anchor bigint, part bigint, parts bigint, digest binary, times bigint, place bigint, body binary"
    bodies = _texts_of(texts, asked, ["text_key", "doc_id"], settings).select("text", "asked")
    bodies = stored(bodies.mapInArrow(_bodies(settings), schema), "bodies")
    sorted_ = bodies.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "digest")
    judged = stored(sorted_.mapInArrow(_judge(settings), _FOUND), "judged")

    ranges = ["anchor", "digest", "low", "high"]
    spots = _met(judged.where("merge")).select("anchor", "part", "digest", "low")
    near = spots.join(bodies.where("parts > 1").select("anchor", "part", "digest", "body"), ["anchor", "part", "digest"])
    near = near.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    merged = _met(near.mapInArrow(_windows_around(settings), _FOUND)).select(*ranges)
    alone = known.where("kinds = 1").selectExpr("anchor", "digest", "0L AS low", "first.starts AS high")
    hits = judged.where("NOT merge").select(*ranges).unionByName(merged).unionByName(alone)
    hits = hits.groupBy("anchor", "digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    # texts that come once: the others go as a whole
    once = cut.join(of_text.where("rows > 1").select("text_key"), "text_key", "left_anti")
    placed = once.join(hits, ["anchor", "digest"]).selectExpr(
        # a segment that follows itself is repeated as a whole
        "text_key",
        "at",
        "IF(times > 1, array(struct(0L AS low, starts * times AS high)), ranges) AS ranges",
    )
    in_text = "transform(ranges, r -> struct(at + r.low AS low, at + r.high AS high)) AS ranges"
    spans = placed.selectExpr("text_key", in_text).groupBy("text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    spans = stored(spans, "spans")
    return slim, of_text, _texts_of(texts, spans, ["text_key"], settings)


def _key(sha256: Column) -> Column:
    return F.unhex(F.substring(sha256, 1, 32))


def covered(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows that start in the ranges."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] - 1 + length)
    first = np.append(True, low[1:] > end[:-1])
    return low[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(low) - 1)]


def _keep(length: int, whole_characters: bool):
    """Texts with their repeated starts to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                ranges = batch.column("ranges").slice(k, 1).flatten()
                low, high = covered(ranges.field("low").to_numpy(), ranges.field("high").to_numpy(), length)
                edges = zip([0, *high.tolist()], [*low.tolist(), len(text)])
                left = b"".join([text[a:b] for a, b in edges])
                kept.append(left.decode("utf-8", "ignore").encode() if whole_characters else left)
                removed.append(int((high - low).sum()))
                spans.append(len(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), pa.array(kept, type=pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=["text_key", "kept", "removed", "spans"],
            )

    return run


def _kept(docs: DataFrame, settings: Settings, whole_characters: bool = False) -> tuple[DataFrame, ...]:
    slim, of_text, found = _repeated(docs, settings)
    schema = "text_key binary, kept binary, removed bigint, spans bigint"
    texts = found.select("text_key", "text", "ranges")
    return slim, of_text, texts.mapInArrow(_keep(settings.length, whole_characters), schema)


def repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` of the bytes left."""
    slim, of_text, kept = _kept(docs, settings)
    cut = stored(kept.select("text_key", "removed", "spans", F.sha2("kept", 256).alias("left")), "cut")
    of_text = of_text.select("text_key", "rows").join(cut, "text_key", "left")
    of_text = of_text.where("rows > 1 OR removed IS NOT NULL")
    rows = slim.withColumn("text_key", F.when(F.col("n_bytes") >= settings.length, _key(F.col("sha256"))))
    nothing = F.sha2(F.lit(b""), 256)
    copied = F.col("rows") > 1
    return rows.join(of_text, "text_key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("left", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows with all their columns, ``text`` cut to what is left; a character cut in two goes.

    A null text stays null. Here the texts meet their cut forms in a join, so they may be shuffled.
    """
    _, of_text, kept = _kept(docs, settings, whole_characters=True)
    cut = of_text.select("text_key", "rows").join(kept.select("text_key", "kept"), "text_key", "left")
    cut = cut.where("rows > 1 OR kept IS NOT NULL").select(
        F.col("text_key").alias("key"), F.coalesce("kept", F.lit(b"")).cast("string").alias("left")
    )
    raw = F.col("text").cast("binary")
    key = F.when(F.octet_length(raw) >= settings.length, _key(F.sha2(raw, 256)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), "text")
    rows = rows.join(cut, "key", "left").withColumn("text", F.coalesce("left", "text"))
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
