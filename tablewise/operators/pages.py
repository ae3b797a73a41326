"""Listings whose deep pages cost no more than the first.

An offset sorts all rows before a page. Here the listing is ranked once, by a distributed sort, and
written in blocks of many pages; a page reads the folder of its block, or two, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators.ranking import global_rank
from tablewise.operators.serving import DESCENDING, LISTING_FIELDS, PER_PAGE

# rows of a block: a folder with one file of a size worth opening
BLOCK_ROWS = 300_000
RANK, BLOCK = "rank", "block"


def write_listing(items: DataFrame, path: str, order_by: str = "Rating", block_rows: int = BLOCK_ROWS) -> None:
    """The items in listing order, ties by id, with their ``rank`` from 1."""
    if order_by not in LISTING_FIELDS:
        raise ValueError(f"cannot sort by {order_by!r}")
    order = F.desc(order_by) if order_by in DESCENDING else F.asc(order_by)
    ranked = global_rank(items.drop(RANK, BLOCK), order, "gmap_id", rank=RANK)
    blocked = ranked.withColumn(BLOCK, F.floor((F.col(RANK) - 1) / block_rows).cast("bigint"))
    # the rank is sorted by range, so a block comes from one task or two neighbours
    blocked.write.mode("errorifexists").partitionBy(BLOCK).parquet(path)


def listing_page(
    spark: SparkSession, path: str, schema: str, page: int = 1, per_page: int = PER_PAGE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One page of a written listing; ``schema`` is that of the items, ``block_rows`` as it was written."""
    if page < 1:
        raise ValueError("pages are counted from 1")
    first, last = (page - 1) * per_page + 1, page * per_page
    table = spark.read.schema(f"{schema}, {RANK} bigint, {BLOCK} bigint").parquet(path)
    blocks = F.col(BLOCK).between((first - 1) // block_rows, (last - 1) // block_rows)
    return table.where(blocks & F.col(RANK).between(first, last)).orderBy(RANK).drop(BLOCK)


def listing_size(spark: SparkSession, path: str, per_page: int = PER_PAGE) -> DataFrame:
    """One row: number of rows and of pages."""
    table = spark.read.schema(f"{RANK} bigint, {BLOCK} bigint").parquet(path)
    newest = table.agg(F.max(BLOCK)).first()[0]
    total = F.coalesce(F.max(RANK), F.lit(0))
    last = table.where(F.col(BLOCK) == (newest if newest is not None else -1))
    return last.agg(total.alias("total"), F.ceil(total / per_page).alias("total_pages"))
