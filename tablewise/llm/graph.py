"""Connected components of a link table, in rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and the smallest id it is linked to, over any number of steps, as ``component``.

    ``links`` has two id columns ``a`` and ``b``; ids without a link are left out, as are links with
    a null end. Every round hangs the larger neighbours of each node, then its smaller ones, under
    the smallest of them; the rounds end when every node hangs under its component's smallest id.
    The smallest neighbours are stored before they are joined, so that a node with very many links
    is split like any skewed join. Nothing but a count and a checksum reaches the driver.
    """
    ends = links.where(F.col("a") != F.col("b"))
    edges = stored(
        ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = stored(
            both.join(least, "a").where(F.col("b") > F.col("a")).select("b", "m").distinct(), "larger"
        )
        lower = stored(large.groupBy("b").agg(F.min("m").alias("s")), "lower")
        # a larger neighbour hangs under the smallest, and so do the other small ones
        small = large.join(lower, "b")
        found = small.select(F.col("s").alias("a"), "b").unionByName(
            small.where(F.col("m") != F.col("s")).select(F.col("s").alias("a"), F.col("m").alias("b"))
        )
        edges = stored(found.distinct(), "links")
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
