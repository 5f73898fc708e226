"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.common import written
from corpuscle.llm.stages import decontaminated, mixed, one_of_each, sanitised, without_poor

STAGES = [
    ("quality", without_poor),
    ("simhash", one_of_each),
    ("decontaminate", decontaminated),
    ("pii", sanitised),
    ("mix", mixed),
]

#: Models, hashes and patterns that SQL has not: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written and read again, as between jobs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
