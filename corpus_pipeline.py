"""A corpus from raw documents to token ids, in stages that each read what the one before has written.

Toxic documents, all but one of each group of near duplicates and documents with benchmark items go;
secrets are replaced in the text; what is left is encoded. Every stage but the last returns the
columns it was given. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewise.llm import bpe, decontaminate, near_dup, secrets, toxicity
from tablewise.shared import stored

STAGES = [
    ("toxicity", toxicity.stage),
    ("near duplicates", near_dup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("tokens", bpe.stage),
]

# no SQL says what a trained classifier, a forest or a vocabulary decides
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
