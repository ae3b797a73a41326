"""Arrow batches in and out of Python tasks, and the small tables that go with them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators.ranking import free_name

TEXT = "__text"

# a task's function: whole texts as UTF-8 (null stays None) to one array or list per new column
Columns = Callable[[list], Sequence]


# for UTF-8 whose signs beyond ASCII are blanks already
_BLANKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of Unicode letters, marks and numbers."""
    whole = (text or b"").decode("utf-8", "replace").lower()
    if not whole.isascii():
        signs = {ord(c): " " for c in set(whole) if c > "\x7f" and unicodedata.category(c)[0] not in "LMN"}
        whole = whole.translate(signs) if signs else whole
    return whole.encode().translate(_BLANKS).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """Remainder of the CRC of the id's decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    more = {"boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return (plain | more)[kind.simpleString()]


def _pieces(batch: pa.RecordBatch, budget: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``budget`` bytes of text, the last column; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, end - start)
        start = end


def with_text_columns(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    added: str,
    make: Callable[[], Columns],
    budget: int = 4 << 20,
    only: str | None = None,
) -> DataFrame:
    """``keep`` columns and the ``added`` ones (a DDL list), worked out from whole texts in tasks.

    ``make`` runs once per task and gives the function for a run of texts; what it loads lives as
    long as the task. A kept column named like an added one is replaced. With ``only``, rows stay
    where that added boolean column is true, and the column itself is left out.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in keep if c not in new.names]
    shown = [f for f in new.fields if f.name != only]
    source = df.select(*kept, F.col(text).cast("binary").alias(free_name(df, TEXT)))
    schema = T.StructType([*df.select(*kept).schema.fields, *shown])
    kinds = [_arrow(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for whole in batches:
            for batch in _pieces(whole, budget):
                values = columns(batch.column(len(kept)).to_pylist())
                arrays = [pa.array(v, type=k) for v, k in zip(values, kinds)]
                out = [batch.column(i) for i in range(len(kept))]
                out += [a for a, f in zip(arrays, new.fields) if f.name != only]
                made = pa.RecordBatch.from_arrays(out, names=[*kept, *(f.name for f in shown)])
                yield made.filter(arrays[new.names.index(only)]) if only else made

    return source.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by ``keys``."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if left:
            last = left[-1]
            change[0] = any(
                last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys
            )
        starts = np.flatnonzero(change)
        if not len(starts):
            left.append(batch)
            continue
        cut = int(starts[-1])
        done = [*left, batch.slice(0, cut)] if cut else left
        if done:
            yield pa.Table.from_batches(done)
        left = [batch.slice(cut)]
    if left:
        yield pa.Table.from_batches(left)


def bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the groups of a sorted table, and its length."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
