"""Ranks and top-N lists with every tie broken by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.shared import cut


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows of a total order; each task keeps its own best ``n`` only."""
    return df.orderBy(*order).limit(n)


def first_by_count(df: DataFrame, n: int, count: str, key: str) -> DataFrame:
    """The ``n`` rows with the highest count, ties by key, for an ``n`` too large for one task.

    The rows per count value give the value at which ``n`` is reached: rows above it are in, and only
    the rows at it are ranked. One row per count value is summed in one task. ``df`` is read more
    than once, so it should be stored.
    """
    sizes = df.groupBy(count).agg(F.count(F.lit(1)).alias("_rows"))
    down = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sizes.withColumn("_upto", F.sum("_rows").over(down)).where(F.col("_upto") >= n)
    last = reached.orderBy(F.desc(count)).first()
    if last is None:
        return df
    open_ = n - (last["_upto"] - last["_rows"])
    ties = global_rank(df.where(F.col(count) == last[count]), key, rank="_at").where(F.col("_at") <= open_)
    return df.where(F.col(count) > last[count]).unionByName(ties.drop("_at"))


def top_n_per(
    df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column | str], rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key, numbered from 1.

    The ``row_number() <= n`` form lets Spark limit every map task to ``n`` rows per key before the
    shuffle, so a key that holds a third of the rows still sends only ``n`` per task.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= n)


def global_rank(df: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """Number all rows from 1 in a total order, without a single-task window.

    Range-sorted partitions are fixed by a checkpoint; a row's number is its place in its partition
    plus the row counts of the partitions before it. Only one row per partition is summed in one
    task.
    """
    part, place, size, start = (free_name(df, n) for n in ("_part", "_place", "_size", "_start"))
    placed = cut(df.orderBy(*order)).select(
        "*",
        F.spark_partition_id().alias(part),
        (F.monotonically_increasing_id() % F.lit(1 << 33)).alias(place),
    )
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(part, (F.sum(size).over(before) - F.col(size)).alias(start))
    # one row per partition, so its size is bounded by the number of partitions
    return (
        placed.join(F.broadcast(starts), part)
        .withColumn(rank, F.col(start) + F.col(place) + 1)
        .drop(part, place, start)
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
