"""Sums over common items of all user pairs that have one, by way of the items' lists of raters.

Every rating goes to its user's task with the raters of its item that follow it, so what is shuffled grows with the
pairs of ratings of one item and not with the pairs of users. An item with more than ``LIST_ROWS`` raters has several
lists, and each meets each. A task sums a bounded number of entries at a time, and holds the sums of one user.

Up to a number of users that all tasks can know, and of different ratings that a byte can tell apart, an entry is four
bytes: the user's rank by id and the rating's place among the different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.ranking import global_rank
from tablewise.shared import stored

# raters in one list
LIST_ROWS = 1_000
# users and different ratings, at most, of entries of four bytes: the sign stays free
CODED_USERS, CODED_RATINGS = 1 << 23, 1 << 8
# entries that are handled at once inside a task
_AT_ONCE = 1_000_000

# ids of both sides, n, dot, a2 and b2, and the other columns of both sides, to a batch of the result
Finish = Callable[[pa.Array, pa.Array, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]], pa.RecordBatch]


def entries(vectors: DataFrame) -> int:
    """Pairs of ratings of one item, each once."""
    raters = vectors.groupBy("gmap_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return int(raters.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 0)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``length`` of each, one range behind the other."""
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)


def _spread(extras: Sequence[str], both: bool, schema: pa.Schema):
    """Two lists of one item to rows of the first one's ratings with the second one's that follow them, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("own", "others")]
            upto = np.cumsum(sizes[0] * sizes[1])
            edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, _AT_ONCE), side="right"))
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                yield spread(batch.slice(low, high - low), sizes[0][low:high], sizes[1][low:high])

    def spread(lists: pa.RecordBatch, n_own: np.ndarray, n_others: np.ndarray) -> pa.RecordBatch:
        own, others = lists.column("own").flatten(), lists.column("others").flatten()
        in_list = np.repeat(np.arange(len(n_own)), n_own)
        end = np.cumsum(n_others)
        start = (end - n_others)[in_list]
        if not both:
            # lists are sorted by id, and codes are in the ids' order
            ids = pa.chunked_array([own.field("user_id"), others.field("user_id")]).combine_chunks()
            code = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
            step = int(code.max(initial=0)) + 1
            place = np.repeat(np.arange(len(n_others)), n_others) * step + code[len(own) :]
            start = np.searchsorted(place, in_list * step + code[: len(own)], side="left")
        length = end[in_list] - start
        taken = others.take(pa.array(_ranges(start, length)))
        offsets = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
        columns = [own.field("user_id"), own.field("rating"), *(own.field(c) for c in extras)]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, taken)], schema=schema)

    return run


def _summed(extras: Sequence[str], finish: Finish):
    """Rows of a user's ratings with others' of the same items, sorted by user, to finished pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            upto = np.cumsum(pc.list_value_length(whole.column("others")).to_numpy().astype(np.int64))
            edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, _AT_ONCE), side="right"))
            for low, high in zip(edges, [*edges[1:], whole.num_rows]):
                table = summed(unfolded(whole.slice(low, high - low)), held)
                ids = table.column("a").combine_chunks()
                # the last user goes on, perhaps
                first = pc.index(ids, ids[-1]).as_py()
                if first:
                    yield finished(table.slice(0, first))
                held = table.slice(first)
        if held is not None:
            yield finished(held)

    def unfolded(rows: pa.RecordBatch) -> pa.Table:
        others = rows.column("others")
        length = pc.list_value_length(others).to_numpy()
        flat, row = others.flatten(), pa.array(np.repeat(np.arange(rows.num_rows), length))
        x, y = rows.column("rating").take(row).to_numpy(), flat.field("rating").to_numpy()
        columns = {"a": rows.column("user_id").take(row), "b": flat.field("user_id")}
        columns |= {"n": np.ones(len(x)), "dot": x * y, "a2": x * x, "b2": y * y}
        for c in extras:
            columns |= {f"{c}_a": rows.column(c).take(row), f"{c}_b": flat.field(c)}
        return pa.table(columns)

    def summed(table: pa.Table, held: pa.Table | None) -> pa.Table:
        table = table if held is None else pa.concat_tables([held, table])
        codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("a", "b")]
        # the rows of a user follow each other, so its code grows
        key = codes[0].indices.to_numpy().astype(np.int64) * (len(codes[1].dictionary) + 1) + codes[1].indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        table = table.take(pa.array(order))
        sums = {c: np.add.reduceat(table.column(c).to_numpy(), first) for c in ("n", "dot", "a2", "b2")}
        kept = table.take(pa.array(first))
        return pa.table({c: sums.get(c, kept.column(c)) for c in table.column_names})

    def finished(table: pa.Table) -> pa.RecordBatch:
        sums = np.stack([table.column(c).to_numpy() for c in ("n", "dot", "a2", "b2")])
        more = {c: (table.column(f"{c}_a").to_numpy(), table.column(f"{c}_b").to_numpy()) for c in extras}
        return finish(table.column("a").combine_chunks(), table.column("b").combine_chunks(), sums, more)

    return run


class Coded(NamedTuple):
    """``(gmap_id, entry)`` rows, and what the numbers in an entry stand for."""

    rows: DataFrame
    users: Any  # broadcast (ids, extras by name), by code
    ratings: np.ndarray


def _coded(rows: DataFrame, extras: Sequence[str]) -> Coded | None:
    """The rows with entries of four bytes; none if there are too many users or ratings, or two values of one user."""
    spark = rows.sparkSession
    found = [r[0] for r in rows.select("rating").distinct().limit(CODED_RATINGS + 1).collect()]
    if None in found:
        return None
    people = stored(rows.select("user_id", *extras).distinct(), "raters")
    n = people.count()
    if n > CODED_USERS or len(found) > CODED_RATINGS or n != people.select("user_id").distinct().count():
        return None
    ranked = global_rank(people, F.asc("user_id"), rank="at").select((F.col("at") - 1).cast("int").alias("code"), "user_id", *extras)
    ranked = stored(ranked, "rater-codes")
    table = ranked.toArrow().sort_by("code")
    known = _whole(table["user_id"]), {c: table[c].to_numpy() for c in extras}
    marks = spark.createDataFrame(list(zip(found, range(len(found)))), "rating double, mark int")
    entry = F.shiftleft("code", 8).bitwiseOR(F.col("mark")).alias("entry")
    coded = rows.select("user_id", "gmap_id", "rating").join(F.broadcast(marks), "rating").join(ranked.select("user_id", "code"), "user_id")
    return Coded(coded.select("gmap_id", entry), spark.sparkContext.broadcast(known), np.array(found, float))


def _whole(column: Any) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _spread_codes(both: bool):
    """As ``_spread``, to rows of a user's code and its own entry with the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("own", "others")]
            upto = np.cumsum(sizes[0] * sizes[1])
            edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, _AT_ONCE), side="right"))
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                yield spread(batch.slice(low, high - low), sizes[0][low:high], sizes[1][low:high])

    def spread(lists: pa.RecordBatch, n_own: np.ndarray, n_others: np.ndarray) -> pa.RecordBatch:
        own, others = (lists.column(c).flatten().to_numpy() for c in ("own", "others"))
        in_list = np.repeat(np.arange(len(n_own)), n_own)
        end = np.cumsum(n_others)
        start = (end - n_others)[in_list]
        if not both:
            # lists are sorted by code
            place = (np.repeat(np.arange(len(n_others)), n_others) << 32) + (others >> 8)
            start = np.searchsorted(place, (in_list << 32) + (own >> 8), side="left")
        length = end[in_list] - start
        offsets = np.append(0, np.cumsum(length + 1))
        data, first = np.empty(offsets[-1], np.int32), np.zeros(offsets[-1], bool)
        first[offsets[:-1]] = True
        data[first], data[~first] = own, others[_ranges(start, length)]
        buffers = [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(data)]
        entries = pa.Array.from_buffers(pa.binary(), len(own), buffers)
        return pa.RecordBatch.from_arrays([pa.array((own >> 8).astype(np.int32)), entries], names=["code", "entries"])

    return run


def _summed_codes(coded: Coded, extras: Sequence[str], finish: Finish):
    """As ``_summed``, of rows sorted by code."""
    users, ratings = coded.users, coded.ratings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            column = batch.column("entries")
            _, places, data = column.buffers()
            ends = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
            whole = np.frombuffer(data, np.int32)[: ends[-1]] if data is not None else np.empty(0, np.int32)
            upto = np.cumsum(np.diff(ends))
            edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, _AT_ONCE), side="right"))
            for low, high in zip(edges, [*edges[1:], batch.num_rows]):
                key, sums = summed(*unfolded(whole, ends[low : high + 1]), held)
                # the last user goes on, perhaps
                last = np.searchsorted(key, key[-1] >> 32 << 32)
                if last:
                    yield finished(key[:last], sums[:, :last])
                held = key[last:], sums[:, last:]
        if held is not None:
            yield finished(*held)

    def unfolded(whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, at = whole[ends[0] : ends[-1]], ends[:-1] - ends[0]
        first = np.zeros(len(part), bool)
        first[at] = True
        own, others = np.repeat(part[at], np.diff(ends) - 1), part[~first]
        x, y = ratings[own & 255], ratings[others & 255]
        return ((own >> 8).astype(np.int64) << 32) + (others >> 8), np.stack([np.ones(len(x)), x * y, x * x, y * y])

    def summed(key: np.ndarray, sums: np.ndarray, held) -> tuple[np.ndarray, np.ndarray]:
        if held is not None:
            key, sums = np.concatenate([held[0], key]), np.concatenate([held[1], sums], axis=1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        return key[first], np.stack([np.add.reduceat(row[order], first) for row in sums])

    def finished(key: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        ids, values = users.value
        sides = key >> 32, key & 0xFFFFFFFF
        more = {c: (values[c][sides[0]], values[c][sides[1]]) for c in extras}
        return finish(*(ids.take(pa.array(side)) for side in sides), sums, more)

    return run


def common_sums(
    vectors: DataFrame, finish: Finish, schema: str, extras: Sequence[str] = (), both: bool = False, list_rows: int = LIST_ROWS
) -> DataFrame:
    """What ``finish`` makes of the pairs of users with a common item, ``user_a <= user_b`` or, with ``both``, either way
    round. All rows of a user as the first of a pair come to one task, in one call of ``finish``.

    ``vectors`` has ``user_id``, ``gmap_id``, ``rating`` and the ``extras``, values of the user.
    """
    rows = vectors.where(F.col("user_id").isNotNull() & F.col("gmap_id").isNotNull()).select(
        "gmap_id", "user_id", F.col("rating").cast("double").alias("rating"), *extras
    )
    coded = _coded(rows, extras)
    if coded is not None:
        lists = _lists_that_meet(coded.rows, F.col("entry"), list_rows)
        out = lists.mapInArrow(_spread_codes(both), "code int, entries binary")
        out = out.repartition("code").sortWithinPartitions("code")
        return out.mapInArrow(_summed_codes(coded, extras, finish), schema)
    entry = F.struct("user_id", "rating", *extras)
    spread = rows.select("user_id", "rating", *extras, F.array(entry).alias("others")).schema
    shape = pa.schema([(f.name, _arrow(f.dataType)) for f in spread])
    out = _lists_that_meet(rows, entry, list_rows).mapInArrow(_spread(extras, both, shape), spread)
    out = out.repartition("user_id").sortWithinPartitions("user_id")
    return out.mapInArrow(_summed(extras, finish), schema)


def _lists_that_meet(rows: DataFrame, entry: Column, list_rows: int) -> DataFrame:
    """Pairs of sorted lists ``own`` and ``others`` of the entries of one item."""
    raters = rows.groupBy("gmap_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).alias("lists"))
    hot = stored(raters.where("lists > 1"), "hot-items")
    lists = F.sort_array(F.collect_list(entry)).alias("own")
    plain = rows.join(hot, "gmap_id", "left_anti").groupBy("gmap_id").agg(lists).select("own", F.col("own").alias("others"))
    dealt = rows.join(hot, "gmap_id").withColumn("list", F.pmod(F.xxhash64(entry), F.col("lists")))
    dealt = stored(dealt.groupBy("gmap_id", "list").agg(lists), "hot-lists")
    met = dealt.join(dealt.select("gmap_id", F.col("own").alias("others")), "gmap_id").select("own", "others")
    return plain.unionByName(met.repartition("own"))


def _arrow(kind) -> pa.DataType:
    plain = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
    if kind.typeName() == "array":
        return pa.list_(pa.struct([(f.name, _arrow(f.dataType)) for f in kind.elementType]))
    return plain[kind.simpleString()]
