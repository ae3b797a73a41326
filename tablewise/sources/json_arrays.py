"""Files that hold one JSON array of objects, read by many tasks.

A byte range of such a file says nothing by itself: a brace may stand in a string that began before. The
text is read in fragments that end at ``}``, so ranges of one file go to different tasks. Of a range the
first pass keeps how it changes the state (in a string or not, depth of brackets) from either start; one row
per range is summed up to the state that each range starts in. The second pass finds the records' ends
with it and puts whole records together where they are read. Only pieces of records that cross a border
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.shared import stored
from tablewise.sources.scans import parse_ndjson, split_rejects

_STATE = "file string, start bigint, flips bigint, from_outside bigint, from_inside bigint"
_PIECES = "file string, start bigint, kind string, value string"
_KEYS = ["file", "start"]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to the next ``}``, with their range and what they do to the state, the brace included.

    Taken from outside a string, the parts between quotes that count are the first, the third and so on;
    from inside, the others. An escaped sign is no quote, whatever it is.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    depth = F.transform(
        parts,
        lambda p: (2 * F.length(p) - F.length(F.translate(p, "{[", "")) - F.length(F.regexp_replace(p, r"[^\]]", "")) - F.length(p)),
    )

    def counted(first: int):
        own = F.aggregate(
            F.transform(depth, lambda d, i: F.when(i % 2 == first, d).otherwise(0)), F.lit(0), lambda a, d: a + d
        )
        outside_at_end = (F.size(parts) - 1) % 2 == first
        return (own - F.when(outside_at_end, 1).otherwise(0)).cast("bigint")

    return text.select(
        "file",
        "start",
        ((F.size(parts) - 1) % 2).cast("bigint").alias("flips"),
        counted(0).alias("from_outside"),
        counted(1).alias("from_inside"),
        "value",
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[pa.RecordBatch]]]:
    """Rows of one range after the other, as they are read."""
    key, held = None, []
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
        at = 0
        while at < batch.num_rows:
            own = files[at], int(starts[at])
            end = at
            while end < batch.num_rows and (files[end], int(starts[end])) == own:
                end += 1
            if own != key and held:
                yield *key, held
                held = []
            key = own
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield *key, held


def _column(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy() for b in held])


def _inside(flips: np.ndarray, first: int) -> np.ndarray:
    """Whether each fragment starts in a string."""
    return (first + np.cumsum(flips) - flips) % 2 == 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for file, start, held in _ranges(batches):
        flips, out, into = (_column(held, n) for n in ("flips", "from_outside", "from_inside"))
        deltas = [int(np.where(_inside(flips, first), into, out).sum()) for first in (0, 1)]
        rows.append((file, start, int(flips.sum()) % 2, *deltas))
    if rows:
        names = [f.split()[0] for f in _STATE.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with the state they start in to records, and to pieces at their borders: ``head`` up to the
    first end, ``tail`` behind the last one, ``through`` if no record ends in the range."""
    for file, start, held in _ranges(batches):
        flips, out, into = (_column(held, n) for n in ("flips", "from_outside", "from_inside"))
        inside = _inside(flips, int(held[0].column("inside")[0].as_py()))
        depth = int(held[0].column("depth")[0].as_py()) + np.cumsum(np.where(inside, into, out))
        outside_after = (inside + flips) % 2 == 0
        ends = np.flatnonzero(outside_after & (depth == 1)) + 1
        values = [v for b in held for v in b.column("value").to_pylist()]
        text = lambda a, b: "}".join([*values[a:b], ""])  # noqa: E731  every fragment with its brace
        if not len(ends):
            rows = [("through", text(0, len(values)))]
        else:
            borders = [0, *ends.tolist()]
            rows = [("head" if not k else "whole", text(a, b)) for k, (a, b) in enumerate(zip(borders, borders[1:]))]
            rows.append(("tail", text(borders[-1], len(values))))
        kinds, texts = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(rows)), pa.array([start] * len(rows), pa.int64()), pa.array(kinds), pa.array(texts)],
            names=["file", "start", "kind", "value"],
        )


def range_states(fragments: DataFrame) -> DataFrame:
    """``(file, start, inside, depth)``: the state in which each range starts; one row per range."""
    summed = stored(fragments.drop("value").mapInArrow(_summed, _STATE), "ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    placed = summed.select(*_KEYS, inside.alias("inside"), F.when(inside == 1, F.col("from_inside")).otherwise(F.col("from_outside")).alias("delta"))
    return placed.select(*_KEYS, "inside", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"))


def read_split_array(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of files that each hold one JSON array of objects.

    A reject is the text of an element that is no object of this schema, or of what is left open at a
    file's end. Empty files and empty arrays give nothing.
    """
    fragments = _fragments(spark, path)
    states = range_states(fragments)
    # one row per range of a file, some tens of megabytes of text each
    pieces = fragments.join(F.broadcast(states), _KEYS).mapInArrow(_cut, _PIECES)
    pieces = stored(pieces, "pieces")
    # a tail or a range without an end goes on to the next range that has one
    later = Window.partitionBy("file").orderBy(F.desc("start"), F.desc("place"))
    place = F.when(F.col("kind") == "head", 0).otherwise(1)
    border = pieces.where("kind <> 'whole'").withColumn("place", place)
    target = F.last(F.when(F.col("kind") == "head", F.col("start")), ignorenulls=True).over(later)
    joined = border.withColumn("target", target).groupBy("file", "target").agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "value"))).alias("parts")
    )
    joined = joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    records = pieces.where("kind = 'whole'").select("value").unionByName(joined)
    # what stands between records: commas, the opening bracket, and behind the last one the closing one
    bare = F.regexp_replace(F.regexp_replace("value", r"^[\s,\[\x{FEFF}]+", ""), r"^\]\s*\}*\s*$", "")
    records = records.select(F.when(F.col("value").rlike(r"^\s*\}*\s*$"), F.lit("")).otherwise(bare).alias("value"))
    return split_rejects(parse_ndjson(records, schema))
