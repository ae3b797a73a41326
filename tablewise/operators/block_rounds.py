"""Rounds of clustering over blocks of users and of items, for runs side by side.

A round is one job. An item block sums the ratings of its items per cluster from the users' labels and sends the sums
to the user blocks that rate the items, in the narrowest type that holds a row exactly; a user block takes the nearest
cluster of its users. Only labels, errors and cluster sizes come to the driver. Blocks are laid out once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.distances import Distance, Sums
from tablewise.operators.ratings import rated
from tablewise.shared import stored

# ratings: so many make a task worth while; in a unit of users, a block of items, and a block of users at most
TASK_RATINGS, UNIT_RATINGS, ITEM_RATINGS, USER_RATINGS = 50_000, 1_000_000, 3_000_000, 12_000_000
# numbers that are summed at once; clusters of the runs that share a job; users whose labels may come to the driver
CELLS_AT_ONCE, CLUSTERS_AT_ONCE, MOST_USERS = 500_000, 64, 50_000_000

_UNIT = "unit int, block int, ids binary, weights binary, squares binary, places binary, ratings binary"
_COLUMNS = ["unit", "block", "ids", "weights", "squares", "places", "ratings"]


class Narrow(NamedTuple):
    """A matrix whose rows are bytes where these hold them, and longer numbers where not."""

    small: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]


class Piece(NamedTuple):
    """Ratings of a unit's users for the items of a block; ``at`` is the item's place in what the block sends."""

    user: np.ndarray
    at: np.ndarray
    codes: np.ndarray
    values: np.ndarray


class Unit(NamedTuple):
    ids: bytes
    weights: np.ndarray
    squares: np.ndarray
    pieces: dict[int, Piece]


class ItemBlock(NamedTuple):
    """``starts`` are the places of the items' first ratings; a rating weighs as much as its user. ``send`` are the
    items that a block of users rates."""

    ids: pa.Array
    starts: np.ndarray
    user: np.ndarray
    codes: np.ndarray
    values: np.ndarray
    send: list[np.ndarray]


class Laid(NamedTuple):
    spark: SparkSession
    users: RDD  # a partition's units by number
    items: RDD
    offsets: np.ndarray  # place of each unit's first label
    n_items: int  # blocks of items
    n_users: int  # blocks of users


class Labels(NamedTuple):
    """Centroids as means of the users' clusters: labels and sizes by run."""

    labels: dict[int, np.ndarray]
    sizes: dict[int, np.ndarray]


class Start(NamedTuple):
    """Centroids from a table; one list of ``(run, cluster, item, value)`` per block of items."""

    cells: RDD


class Run(NamedTuple):
    errors: list[float]
    error: float  # of the last assignment
    source: Labels | Start
    labels: np.ndarray


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as places in a short list of different ones, where there is one."""
    found, codes = np.unique(values, return_inverse=True)
    if len(found) <= 256:
        return codes.astype(np.uint8), found
    if len(found) <= 65536:
        return codes.astype(np.uint16), found
    return np.empty(0, np.uint8), values


def _numbers(codes: np.ndarray, values: np.ndarray, here: slice) -> np.ndarray:
    return values[codes[here]] if len(codes) else values[here]


def _one(array: Any) -> pa.Array:
    """A column as one array."""
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _ipc(array: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("ids", pa.string())])) as out:
        out.write_batch(pa.record_batch([array.cast(pa.string())], names=["ids"]))
    return sink.getvalue().to_pybytes()


def _from_ipc(data: bytes) -> pa.Array:
    return _one(pa.ipc.open_stream(data).read_all()["ids"])


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal neighbours."""
    return np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []


def _pack_unit(table: pa.Table) -> pa.Table:
    """The users of a unit as one row without a block, and their ratings as a row per block of items."""
    coded = _one(pc.dictionary_encode(_one(table["user_id"]), null_encoding="encode"))
    user, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    weight, rating, block = (table[c].to_numpy() for c in ("weight", "rating", "block"))
    asked = table["weight"].is_valid().to_numpy()
    weights = np.bincount(user[asked], weights=weight[asked], minlength=len(names)).astype(np.int64)
    kept = np.flatnonzero(weights)
    place = np.cumsum(weights > 0) - 1
    # ratings of users that are not asked for count nowhere, and no rating belongs to a null
    own = np.flatnonzero(~asked & (weights[user] > 0) & names.is_valid().to_numpy(zero_copy_only=False)[user])
    squares = np.bincount(place[user[own]], weights=rating[own] ** 2, minlength=len(kept))
    unit = table["unit"][0].as_py()
    rows = [(unit, -1, _ipc(names.take(pa.array(kept))), weights[kept].tobytes(), squares.astype(float).tobytes(), b"", b"")]
    own = own[np.lexsort((user[own], block[own]))]
    gmap, twice = _one(table["gmap_id"]), bool((weights > 1).any())
    for some in _groups(block[own]):
        at = own[some]
        cells = weights[user[at]].tobytes() if twice else b"", b"", place[user[at]].astype(np.int32).tobytes()
        rows.append((unit, int(block[at[0]]), _ipc(gmap.take(pa.array(at))), *cells, rating[at].astype(float).tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 5)], names=_COLUMNS)


def _pack_items(part: int, rows, offsets: np.ndarray, each: int, n_users: int):
    """The block of items, and pieces for the blocks of users, which are ``each`` units."""
    found = sorted(((r.unit, r.ids, r.weights, r.places, r.ratings) for _, r in rows), key=lambda x: x[0])
    names = _one(pa.chunked_array([_from_ipc(x[1]) for x in found], pa.string()))
    coded = _one(pc.dictionary_encode(names, null_encoding="encode"))
    order = pc.sort_indices(coded.dictionary, null_placement="at_end").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = coded.dictionary.take(pa.array(order))
    item = rank[coded.indices.to_numpy(zero_copy_only=False)]
    known = len(ids) - ids.null_count
    counts = [len(x[3]) // 4 for x in found]
    unit = np.repeat(np.array([x[0] for x in found], np.int64), counts)
    place = np.concatenate([np.empty(0, np.int32), *[np.frombuffer(x[3], np.int32) for x in found]])
    rating = np.concatenate([np.empty(0), *[np.frombuffer(x[4], float) for x in found]])
    weight = np.concatenate([np.empty(0), *[np.frombuffer(x[2], np.int64) if x[2] else np.ones(n) for x, n in zip(found, counts)]])
    found = None
    send = []
    for to in range(n_users):
        # an item without an id is a cell of its centroids, and in common with nobody
        here = np.flatnonzero((unit // each == to) & (item < known))
        wanted = np.unique(item[here])
        send.append(wanted.astype(np.int32))
        at = np.searchsorted(wanted, item[here]).astype(np.uint16 if len(wanted) <= 65536 else np.int32)
        for some in _groups(unit[here]):
            yield to, (int(unit[here[some[0]]]), part, Piece(place[here[some]], at[some], *_codes(rating[here[some]])))
    by_item = np.argsort(item, kind="stable")
    user = (offsets[unit] + place)[by_item].astype(np.int32 if offsets[-1] < 2**31 else np.int64)
    starts = np.searchsorted(item[by_item], np.arange(len(ids) + 1))
    yield -1, ItemBlock(ids, starts, user, *_codes((rating * weight)[by_item]), send)


def _pack_users(rows) -> Iterator[dict[int, Unit]]:
    units: dict[int, Unit] = {}
    pieces: dict[int, dict[int, Piece]] = {}
    for _, x in rows:
        if len(x) == 3:
            pieces.setdefault(x[0], {})[x[1]] = x[2]
        else:
            units[x[0]] = Unit(x[1], np.frombuffer(x[2], np.int64), np.frombuffer(x[3], float), {})
    for unit, found in pieces.items():
        units[unit].pieces.update(sorted(found.items()))
    yield dict(sorted(units.items()))


def lay_out(ratings: DataFrame, users: DataFrame, hot_rows: int) -> Laid | None:
    """Blocks of ratings and users; none if a user has over ``hot_rows`` ratings, an item too many for a block, or
    there are too many users for their labels on the driver."""
    spark = ratings.sparkSession
    own = ratings.where(rated()).select("user_id", "gmap_id", F.col("rating").cast("double").alias("rating"))
    n = own.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // TASK_RATINGS)))
    n_items, n_users = max(tasks, -(-n // ITEM_RATINGS)), max(tasks, -(-n // USER_RATINGS))
    each = max(1, -(-n // (n_users * UNIT_RATINGS)))
    unit = F.pmod(F.xxhash64("user_id"), F.lit(n_users * each)).cast("int").alias("unit")
    block = F.pmod(F.xxhash64("gmap_id"), F.lit(n_items)).cast("int").alias("block")
    most = lambda df: df.agg(F.max("count")).first()[0] or 0
    # few units have more ratings than a user may have; only then users are counted
    if most(own.groupBy(unit).count()) > hot_rows and most(own.groupBy("user_id").count()) > hot_rows:
        return None
    if most(own.groupBy(block).count()) > 2 * ITEM_RATINGS and most(own.groupBy("gmap_id").count()) > ITEM_RATINGS:
        return None
    rows = own.select(unit, "user_id", F.lit(None).cast("bigint").alias("weight"), block, "gmap_id", "rating")
    people = users.groupBy("user_id").agg(F.count(F.lit(1)).alias("weight"))
    if users.count() > MOST_USERS:
        return None
    none = [F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("gmap_id", "string"), ("rating", "double"))]
    both = rows.unionByName(people.select(unit, "user_id", "weight", *none))
    packed = stored(both.groupBy("unit").applyInArrow(_pack_unit, _UNIT), "units")
    counts = np.zeros(n_users * each, np.int64)
    for r in packed.where("block < 0").select("unit", (F.octet_length("weights") / 8).alias("n")).collect():
        counts[r.unit] = r.n
    offsets = np.append(0, np.cumsum(counts))
    by_item = packed.where("block >= 0").select("unit", "block", "ids", "weights", "places", "ratings").rdd
    cells = by_item.map(lambda r: (r.block, r)).partitionBy(n_items, int)
    cells = cells.mapPartitionsWithIndex(partial(_pack_items, offsets=offsets, each=each, n_users=n_users)).persist(StorageLevel.DISK_ONLY)
    items = cells.filter(lambda x: x[0] < 0).map(lambda x: x[1]).persist(StorageLevel.MEMORY_AND_DISK)
    names = packed.where("block < 0").select("unit", "ids", "weights", "squares").rdd
    units = names.map(lambda r: (r.unit // each, (r.unit, r.ids, r.weights, r.squares)))
    found = cells.filter(lambda x: x[0] >= 0).union(units).partitionBy(n_users, int).mapPartitions(_pack_users)
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    items.count()
    found.count()
    for rdd in (cells, found):
        rdd._jrdd.rdd().cleanShuffleDependencies(True)
    cells.unpersist()
    return Laid(spark, found, items, offsets, n_items, n_users)


def close(laid: Laid) -> None:
    laid.users.unpersist()
    laid.items.unpersist()


def table_start(laid: Laid, cells: DataFrame, ks: Sequence[int]) -> Start | None:
    """Centroids ``(k, cluster_id, gmap_id, value)``; none if a cell comes twice or is of no cluster."""
    n, whole, most = cells.count(), cells.select("k", "cluster_id", "gmap_id").distinct().count(), F.col("k").isin(list(ks))
    if n != whole or not cells.where(~(most & F.col("cluster_id").between(0, F.col("k") - 1)) | F.col("value").isNull()).isEmpty():
        return None
    block = F.pmod(F.xxhash64("gmap_id"), F.lit(laid.n_items)).cast("int").alias("block")
    rows = cells.select(block, "k", "cluster_id", "gmap_id", F.col("value").cast("double")).rdd.map(lambda r: (r[0], tuple(r)[1:]))
    found = rows.partitionBy(laid.n_items, int).mapPartitions(lambda it: [[x for _, x in it]]).persist(StorageLevel.MEMORY_AND_DISK)
    return Start(found)


class _Given(NamedTuple):
    """What a task needs of centroids: a label array and divisors by column, or cells of a table."""

    labels: Any  # broadcast by run, or None
    sizes: np.ndarray


def _columns(ks: Sequence[int]) -> list[int]:
    return [int(x) for x in np.cumsum([0, *ks])]


class _Sums:
    """Sums of a block's items per column, a range of items at a time, with the divisors of the columns."""

    def __init__(self, block: ItemBlock, given: _Given, cells, ks: Sequence[int]):
        self.block, self.ks, self.given = block, ks, given
        self.low = _columns(ks)
        self.apart = np.empty((0, 2))  # column and value of cells whose item nobody has rated
        if given.labels is None:
            at = {k: lo for k, lo in zip(ks, self.low)}
            cells = [x for x in cells if x[0] in at]
            names = pa.array([x[2] for x in cells], pa.string())
            # an item without an id comes last
            place = pc.index_in(names, value_set=block.ids, skip_nulls=False) if len(block.ids) else pa.nulls(len(cells), pa.int32())
            place = place.fill_null(-1).to_numpy(zero_copy_only=False)
            column = np.array([at[x[0]] + x[1] for x in cells], np.int64)
            value = np.array([x[3] for x in cells], float)
            self.apart = np.stack([column[place < 0], value[place < 0]], 1)
            order = np.argsort(place, kind="stable")
            order = order[place[order] >= 0]
            self.cells = place[order], column[order], value[order]

    def of(self, low: int, high: int) -> np.ndarray:
        n, width = high - low, self.low[-1]
        if self.given.labels is None:
            place, column, value = self.cells
            here = slice(*np.searchsorted(place, [low, high]))
            return np.bincount((place[here] - low) * width + column[here], weights=value[here], minlength=n * width).reshape(n, width)
        b = self.block
        here = slice(b.starts[low], b.starts[high])
        rating, user = _numbers(b.codes, b.values, here), b.user[here]
        item = np.repeat(np.arange(n) * width, np.diff(b.starts[low : high + 1]))
        out = np.zeros(n * width)
        for k, lo in zip(self.ks, self.low):
            out += np.bincount(item + (lo + self.given.labels.value[k][user].astype(np.int64)), weights=rating, minlength=n * width)
        return out.reshape(n, width)


def _narrow(parts: list[np.ndarray]) -> Narrow:
    small, rows, start = [], [], 0
    for m in parts:
        byte = ((m >= 0) & (m < 256) & (m == np.floor(m))).all(axis=1)
        small.append(np.where(byte[:, None], m, 0).astype(np.uint8))
        rest = np.flatnonzero(~byte)
        short = (m[rest].astype(np.float32) == m[rest]).all(axis=1)
        for some, kind in ((rest[short], np.float32), (rest[~short], np.float64)):
            if len(some):
                rows.append((some + start, m[some].astype(kind)))
        start += len(m)
    return Narrow(np.concatenate(small), rows)


def _sent(part: int, both, now: _Given, old: _Given | None, ks: Sequence[int], rtol: float, atol: float):
    """The block's sums for every block of users, with its squares and the cells that differ from the old ones per column."""
    for block, cells, old_cells in both:
        width = sum(ks)
        new, before = _Sums(block, now, cells, ks), old and _Sums(block, old, old_cells, ks)
        squares, moved = np.zeros(width), np.zeros(width, np.int64)
        for x in (new, before):
            if x is not None and len(x.apart):
                column, value = x.apart[:, 0].astype(int), x.apart[:, 1]
                if x is new:
                    squares += np.bincount(column, weights=value * value, minlength=width)
                else:
                    moved += np.bincount(column[np.abs(value) > atol], minlength=width)
        parts: list[list[np.ndarray]] = [[np.empty((0, width))] for _ in block.send]
        n = len(block.ids)
        step = max(1, CELLS_AT_ONCE // width)
        for low in range(0, n, step):
            high = min(n, low + step)
            sums = new.of(low, high)
            value = sums / now.sizes
            squares += (value * value).sum(axis=0)
            if before is not None:
                moved += (np.abs(before.of(low, high) / old.sizes - value) > atol + rtol * np.abs(value)).sum(axis=0)
            for to, wanted in enumerate(block.send):
                parts[to].append(sums[wanted[slice(*np.searchsorted(wanted, [low, high]))] - low])
        for to, found in enumerate(parts):
            yield to, (part, _narrow(found), squares, moved)


def _nearest(units: dict[int, Unit], came, distance: Distance, sizes: np.ndarray, ks: Sequence[int], places: int):
    """Per unit the labels, distances and weights by run; the last entry has the cells that have moved."""
    came.sort(key=lambda x: x[0])
    width, low = sum(ks), _columns(ks)
    norms, moved = sum(x[2] for x in came), sum(x[3] for x in came)
    sent = {}
    for part, narrow, *_ in came:
        where = None
        if narrow.rows:
            where = np.full(len(narrow.small), -1, np.int32)
            where[np.concatenate([r for r, _ in narrow.rows])] = np.arange(sum(len(r) for r, _ in narrow.rows))
        sent[part] = narrow.small, where, np.concatenate([m.astype(np.float64) for _, m in narrow.rows]) if narrow.rows else None
    came.clear()
    shared = distance.absent is not None
    for number, unit in units.items():
        n = len(unit.weights)
        dot, a2, b2 = (np.zeros((n if i == 0 or shared else 0, width)) for i in range(3))
        for part, piece in unit.pieces.items():
            small, where, long = sent[part]
            step = max(1, CELLS_AT_ONCE // width)
            for i in range(0, len(piece.user), step):
                here = slice(i, i + step)
                at = piece.at[here]
                cells = small[at].astype(float)
                if where is not None:
                    longer = where[at]
                    some = np.flatnonzero(longer >= 0)
                    cells[some] = long[longer[some]]
                rating = _numbers(piece.codes, piece.values, here)[:, None]
                first = np.flatnonzero(np.diff(piece.user[here], prepend=-1))
                who = piece.user[here][first]
                dot[who] += np.add.reduceat(rating * cells, first)
                if shared:
                    a2[who] += np.add.reduceat((rating * rating) * (cells != 0), first)
                    b2[who] += np.add.reduceat(np.square(cells, out=cells), first)
        with np.errstate(divide="ignore", invalid="ignore"):
            full = (unit.squares[:, None], norms[None, :]) if distance.full_norms else (None, None)
            d = distance.formula(Sums(dot / sizes, a2, b2 / (sizes * sizes) if shared else b2, *full), np.maximum)
        d = np.round(np.broadcast_to(d, (n, width)), places)
        if shared:
            d = np.where(a2 > 0, d, distance.absent)
        dot = a2 = b2 = None
        runs = []
        for k, lo in zip(ks, low):
            label = d[:, lo : lo + k].argmin(axis=1)
            runs.append((label, d[np.arange(n), lo + label]))
        yield number, unit, runs
    yield -1, moved, None


def _figures(part: int, both, **given):
    ks = given["ks"]
    for units, came in both:
        for number, unit, runs in _nearest(units, came, **given):
            if number < 0:
                yield number, unit if part == 0 else 0, None, None
                continue
            kind = np.uint8 if max(ks) <= 256 else np.int32
            labels = [label.astype(kind) for label, _ in runs]
            yield number, labels, [float((unit.weights * d).sum()) for _, d in runs], [
                np.bincount(label, weights=unit.weights, minlength=k) for k, (label, _) in zip(ks, runs)
            ]


def _listed(part: int, both, **given):
    for units, came in both:
        for number, unit, runs in _nearest(units, came, **given):
            if number >= 0 and len(unit.weights):
                times = np.repeat(np.arange(len(unit.weights)), unit.weights)
                ids = _from_ipc(unit.ids).take(pa.array(times))
                label, d = runs[0]
                yield (_table([ids, pa.array(label[times], pa.int32()), pa.array(d[times], pa.float64())], ["user_id", "cluster_id", "distance"]),)


def _table(columns: list[pa.Array], names: list[str]) -> bytearray:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(columns, names=names)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return bytearray(sink.getvalue().to_pybytes())


def _unpacked(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from pa.ipc.open_stream(data.as_buffer())


def _frame(spark: SparkSession, rdd: RDD, schema: str) -> DataFrame:
    return spark.createDataFrame(rdd, "data binary").mapInArrow(_unpacked, schema)


def _given(source: Labels | Start, ks: Sequence[int], sc) -> _Given:
    if isinstance(source, Start):
        return _Given(None, np.ones(sum(ks)))
    sizes = np.concatenate([source.sizes[k] for k in ks])
    return _Given(sc.broadcast({k: source.labels[k] for k in ks}), np.maximum(sizes, 1.0))


def _job(laid: Laid, distance: Distance, ks: Sequence[int], source, old, rules: tuple[float, float, int], work: Callable):
    """The job's rows as an RDD, and what to drop after it."""
    sc = laid.spark.sparkContext
    now, before = _given(source, ks, sc), old and _given(old, ks, sc)
    blocks = laid.items
    for x in (source, old):
        if isinstance(x, Start):
            blocks = blocks.zip(x.cells)
        else:
            blocks = blocks.map(lambda b: (b, None))
    flat = blocks.map(lambda x: (x[0][0], x[0][1], x[1]))
    rtol, atol, places = rules
    sent = flat.mapPartitionsWithIndex(partial(_sent, now=now, old=before, ks=ks, rtol=rtol, atol=atol))
    came = sent.partitionBy(laid.n_users, int).mapPartitions(lambda it: [[x for _, x in it]])
    out = laid.users.zip(came).mapPartitionsWithIndex(partial(work, distance=distance, sizes=now.sizes, ks=ks, places=places))
    return out, [x.labels for x in (now, before) if x and x.labels is not None]


def _round(laid: Laid, distance: Distance, ks: Sequence[int], source, old, rules):
    """``(labels, error, sizes, cells that have moved)`` by run."""
    out, sent = _job(laid, distance, ks, source, old, rules, _figures)
    rows = out.collect()
    out._jrdd.rdd().cleanShuffleDependencies(False)
    for x in sent:
        x.destroy()
    moved = sum(x[1] for x in rows if x[0] < 0)
    low, found = _columns(ks), sorted((x for x in rows if x[0] >= 0), key=lambda x: x[0])
    out = {}
    for i, k in enumerate(ks):
        labels = np.concatenate([x[1][i] for x in found]) if found else np.empty(0, np.uint8)
        sizes = sum((x[3][i] for x in found), np.zeros(k))
        out[k] = labels, sum(x[2][i] for x in found), sizes, int(np.sum(moved[low[i] : low[i] + k]))
    return out


def rounds(laid: Laid, start: Start | Labels, ks: Sequence[int], distance: Distance, max_iter: int, tol: float, rules: tuple[float, float, int]) -> dict[int, Run]:
    """All runs to their own end, as ``clustering.kmeans`` says it. ``rules`` are the tolerances of cells and the places of distances."""
    groups: list[list[int]] = []
    for k in sorted(ks):
        if not groups or sum(groups[-1]) + k > CLUSTERS_AT_ONCE:
            groups.append([])
        groups[-1].append(k)
    done: dict[int, Run] = {}
    for open_ in groups:
        errors: dict[int, list[float]] = {k: [] for k in open_}
        source, old, before = start, None, {}
        for turn in range(max_iter + 1):
            found = _round(laid, distance, open_, source, old, rules)
            for k, (labels, error, _, moved) in found.items():
                if turn and not moved:
                    # the round before was the last one
                    done[k] = Run(errors[k], before[k][1], old, before[k][0])
                elif turn == max_iter:
                    done[k] = Run(errors[k], error, source, labels)
                else:
                    errors[k].append(error)
                    if turn and abs(errors[k][-2] - error) < tol:
                        done[k] = Run(errors[k], error, source, labels)
            open_ = [k for k in open_ if k not in done]
            if not open_:
                break
            source, old, before = Labels({k: found[k][0] for k in open_}, {k: found[k][2] for k in open_}), source, found
    return done


def assigned(laid: Laid, run: Run, k: int, distance: Distance, rules) -> DataFrame:
    """``(user_id, cluster_id, distance)`` of the run's end."""
    out, _ = _job(laid, distance, [k], run.source, None, rules, _listed)
    table = stored(_frame(laid.spark, out, "user_id string, cluster_id int, distance double"), "assigned")
    out._jrdd.rdd().cleanShuffleDependencies(False)
    return table


def centroids(laid: Laid, run: Run, k: int) -> DataFrame:
    """The cells the run's assignments belong to, made when they are read."""
    given = _given(run.source, [k], laid.spark.sparkContext)
    found = laid.items.mapPartitions(partial(_cells, given=given, k=k))
    return _frame(laid.spark, found, "cluster_id int, gmap_id string, value double")


def _cells(blocks, given: _Given, k: int):
    for block in blocks:
        sums, n, step = _Sums(block, given, (), [k]), len(block.ids), max(1, CELLS_AT_ONCE // k)
        for low in range(0, n, step):
            value = sums.of(low, min(n, low + step)) / given.sizes
            item, cluster = np.nonzero(value)
            ids = block.ids.take(pa.array(item + low))
            yield (_table([pa.array(cluster, pa.int32()), ids, pa.array(value[item, cluster])], ["cluster_id", "gmap_id", "value"]),)
