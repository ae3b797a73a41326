"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by quantiles of all rows, the cells are ordered along the curve, and the
order is cut into runs of equal length. Rows near each other in every dimension share a shard and,
within it, neighbouring files, so files can be left out by the minimum and maximum of any of the
dimensions. Everything is DataFrame functions: the curve is a table-driven state machine run by
``aggregate`` over the bits of the cells.

Text dimensions are quantised by whole values: the distinct ones are counted, range-sorted and summed up,
and the values at which the sum passes a quantile are the bounds. A null cell comes first. Rows with equal
texts (null and empty are equal) take the first cell on the curve that any of them has, and rows in one
cell are ordered by the text's CRC and hash, then by size and id. So equal texts are one run, which
only a cut between shards can divide, and a cell with very many rows is split like any other. Rows that are
equal in all of these take their places in any order. A dimension that holds only nulls or one value has
one cell; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.ranking import free_name, global_rank
from tablewise.shared import cut, stored

DIMENSIONS = ("lang", "source", "n_chars")


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For every state and corner of an n-cube: the corner's place on the curve, and the next state.

    A state is the corner the curve enters at and the direction it leaves along; the corner is first
    turned into the standard position, where its place is the inverse of the Gray code.
    """
    full = (1 << n) - 1

    def turned(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & full

    def place_of(code: int) -> int:
        out = 0
        while code:
            out ^= code
            code >>= 1
        return out

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    places, states = [], []
    for state in range((full + 1) * n):
        enter, along = divmod(state, n)
        for corner in range(full + 1):
            w = place_of(turned(corner ^ enter, along + 1))
            first = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ ((2 * ((w - 1) // 2)) >> 1)
            step = 0 if w == 0 else trailing_ones(w if w % 2 else w - 1) % n
            places.append(w)
            states.append((enter ^ turned(first, n - (along + 1) % n)) * n + (along + step + 1) % n)
    return places, states


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Place of a cell (one whole number per dimension, below 2 ** bits) on the curve."""
    n = len(cells)
    places, states = curve_tables(n)
    place, after = F.array(*map(F.lit, places)), F.array(*map(F.lit, states))
    coordinates = F.array(*[c.cast("bigint") for c in cells])

    def step(acc: Column, shift: Column) -> Column:
        corner = F.aggregate(
            coordinates,
            F.lit(0).cast("bigint"),
            lambda code, c: code * 2 + F.call_function("shiftright", c, shift).bitwiseAND(1),
        )
        at = (acc["state"] * (1 << n) + corner + 1).cast("int")
        return F.struct(
            (acc["index"] * (1 << n) + F.element_at(place, at)).cast("bigint").alias("index"),
            F.element_at(after, at).cast("bigint").alias("state"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).cast("bigint").alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def _text_bounds(df: DataFrame, name: str, cells_: int) -> list[str]:
    """Values of a text column up to which each share of the rows that have one lies: one per cut."""
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(values.orderBy("value")).withColumn("part", F.spark_partition_id())
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per partition
    starts = sizes.select("part", (F.sum("rows").over(upto) - F.col("rows")).alias("start"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("sum", F.sum("n").over(within)).join(F.broadcast(starts), "part")
    passed = summed.selectExpr(
        "value", f"(start + sum) * {cells_} DIV all - (start + sum - n) * {cells_} DIV all AS cuts"
    )
    return [r.value for r in passed.where("cuts > 0").orderBy("value").collect() for _ in range(r.cuts)][: cells_ - 1]


def cells(df: DataFrame, dimensions: Sequence[str], bits: int) -> list[Column]:
    """Quantile cell of each dimension, 0 for null; bounds come from all rows."""
    texts = [d for d in dimensions if dict(df.dtypes)[d] == "string"]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = {d: _text_bounds(df, d, 1 << bits) for d in texts}
    numbers = [d for d in dimensions if d not in texts]
    if numbers:
        asked = [F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numbers]
        bounds |= df.agg(*asked).first().asDict()

    def cell(name: str) -> Column:
        kind = "string" if name in texts else "double"
        value = F.col(name).cast(kind)
        found = F.array(*[F.lit(b) for b in bounds[name] or []]).cast(f"array<{kind}>")
        return F.when(value.isNull(), 0).otherwise(F.size(F.filter(found, lambda b: b < value)))

    return [cell(d) for d in dimensions]


def assign(docs: DataFrame, shards: int = 16, dimensions: Sequence[str] = DIMENSIONS, bits: int = 4) -> DataFrame:
    """``docs``, measured, with ``shard`` and ``slot``: runs along the curve whose lengths differ by one at most.

    A column of these names is replaced. The given columns are stored first, so leave the text out where
    only places are asked for.
    """
    curve, rank, first, copies = (free_name(docs, n) for n in ("__curve", "__rank", "__first", "__copies"))
    kept = stored(docs.drop("shard", "slot"), "measured")
    total = kept.count()
    on_curve = stored(kept.withColumn(curve, hilbert_index(cells(kept, dimensions, bits), bits)), "curve")
    groups = on_curve.groupBy("text_hash", "text_crc32", "size").agg(F.min(curve).alias(first), F.count(F.lit(1)).alias(copies))
    groups = groups.where(F.col(copies) > 1).drop(copies)
    together = on_curve.join(groups, ["text_hash", "text_crc32", "size"], "left")
    together = together.withColumn(curve, F.coalesce(first, curve)).select(*kept.columns, curve)
    ranked = global_rank(together, curve, "text_crc32", "text_hash", "size", "doc_id", rank=rank)
    rows, at = max(total, 1), f"(`{rank}` - 1)"
    shard = f"CAST({at} * {shards}L DIV {rows}L AS INT)"
    slot = f"{at} - ({shard} * {rows}L + {shards - 1}L) DIV {shards}L"
    return ranked.selectExpr(*[f"`{c}`" for c in kept.columns], f"{shard} AS shard", f"{slot} AS slot")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and one), ``text_crc32`` and ``text_hash`` of the text, null as empty."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    size = (F.octet_length(raw) + 1).cast("bigint")
    return docs.withColumn("size", size).withColumn("text_crc32", F.crc32(raw)).withColumn("text_hash", F.xxhash64(raw))


def write(docs: DataFrame, path: str, shards: int = 16, dimensions: Sequence[str] = DIMENSIONS) -> None:
    """Write the documents in curve order, a folder per shard; big shards get several files, each a run."""
    placed = assign(measured(docs), shards, dimensions)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.drop("size", "text_crc32", "text_hash").write.partitionBy("shard").parquet(path)
