"""Batch scans; every one has a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise import schemas
from tablewise.functions.scalars import not_blank

_BAD = "_corrupt_record"


def parse_ndjson(lines: DataFrame, schema: str) -> DataFrame:
    """Decode a ``value`` column of JSON lines; blank lines vanish, other columns stay.

    Adds ``_corrupt_record``: the text of a line that is not exactly one JSON object of this schema,
    else null.
    """
    # a line is read up to the end of its first object, so text behind it shows only in an array
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1, F.lit(False))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    decoded = F.from_json("value", f"{schema}, {_BAD} string", options)
    others = [c for c in lines.columns if c != "value"]
    return (
        lines.where(not_blank("value"))
        .select(*others, "value", decoded.alias("j"), whole.alias("whole"))
        .select(*others, "j.*", "value", "whole")
        .withColumn(_BAD, F.when(F.col(_BAD).isNotNull() | ~F.col("whole"), F.col("value")))
        .drop("value", "whole")
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = parsed.where(F.col(_BAD).isNull()).drop(_BAD)
    return rows, parsed.where(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("value"))


def read_ndjson(
    spark: SparkSession, path: str, schema: str, staged: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of newline-delimited JSON.

    With ``staged`` the text is read and decoded once, into Parquet parted by reject or not, and
    both results come from there. Without it each result scans the text when it is used.
    """
    parsed = parse_ndjson(spark.read.text(path), schema)
    if staged is not None:
        tagged = parsed.withColumn("rejected", F.col(_BAD).isNotNull())
        tagged.write.mode("overwrite").partitionBy("rejected").parquet(staged)
        kept = spark.read.schema(tagged.schema).parquet(staged)
        rows = kept.where(~F.col("rejected")).drop(_BAD, "rejected")
        return rows, kept.where(F.col("rejected")).select(F.col(_BAD).alias("value"))
    return split_rejects(parsed)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects; a file is read by one task."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_id_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of id strings, as one column of distinct ids."""
    text = spark.read.text(path, wholetext=True)
    ids = text.select(F.explode(F.from_json("value", "array<string>")).alias("gmap_id"))
    return ids.where(F.col("gmap_id").isNotNull()).distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed; duplicates collapse."""
    return distinct_ids(spark.read.text(path))


def distinct_ids(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("gmap_id")).distinct()


def read_table(
    spark: SparkSession,
    path: str,
    schema: str,
    columns: Sequence[str] | None = None,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """A collection under its fixed schema; ``columns`` reach the scan as its read schema.

    ``format`` may name any connector on the class path, with its options.
    """
    df = spark.read.format(format).options(**options).schema(schema).load(path)
    return df.select(*columns) if columns else df


def newest_run(spark: SparkSession, path: str, before: int | None = None) -> int:
    """The newest whole run of a snapshot, from its marks; no data is opened."""
    runs = spark.read.schema("run_id bigint, id bigint").parquet(f"{path.rstrip('/')}/_runs")
    if before is not None:
        runs = runs.where(F.col("id") < before)
    return runs.agg(F.max("run_id")).first()[0]


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, centroids and assignments of the newest whole run of a clustering model."""
    run = f"{path.rstrip('/')}/run_id={newest_run(spark, path)}"
    kinds = {"features": schemas.FEATURES, "centroids": schemas.CENTROIDS, "assignments": schemas.ASSIGNMENTS}
    features, centroids, assignments = [read_table(spark, f"{run}/{n}", s) for n, s in kinds.items()]
    return features, centroids, assignments


def read_newest(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of the newest run of a snapshot; older runs are not opened."""
    run_id = newest_run(spark, path, before)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/run_id={run_id}")
