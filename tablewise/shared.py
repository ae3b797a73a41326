"""Storage shared by all executors: cut points that outlive any one of them.

The folder is the cluster's ``spark.checkpoint.dir``. Only a local session that names none gets a
folder of its own.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_TABLE = "tablewise_"
_made: set[str] = set()  # names of the tables this process has made


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a session that is not local has to name it."""
    sc = spark.sparkContext
    folder = spark.conf.get(_DIR, None) or sc.getConf().get(_DIR) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {_DIR} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablewise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tablewise/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in getattr(_open, "scopes", []):
        paths.append(path)
    return path


_open = threading.local()


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Paths that this thread gets within the block are deleted at its end: for work that is done by
    then, as that of one batch of a stream."""
    _open.scopes = [*getattr(_open, "scopes", []), paths := []]
    try:
        yield
    finally:
        _open.scopes.pop()
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can reach it; nothing happens if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has stored here, when no result that reads it is needed any more."""
    while _made:
        spark.sql(f"DROP TABLE IF EXISTS {_made.pop()}")
    remove(spark, _own_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint now: lineage ends here, and partition numbers and row order are fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later steps prune columns and the planner sees the true size."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Write once, bucketed on ``key``: later joins and groups on it need no shuffle of this side."""
    spark = df.sparkSession
    path = new_path(spark, label)
    table = _TABLE + path.rsplit("-", 1)[1]
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .option("path", path)
        .saveAsTable(table)
    )
    _made.add(f"{spark.catalog.currentCatalog()}.{spark.catalog.currentDatabase()}.{table}")
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
