"""The additive part under Structured Streaming: cleaning is stateless, token counts add up. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lexical import tokens_of


def stream_texts(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Texts that arrive as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(texts: DataFrame) -> DataFrame:
    """Counts per corpus and token; complete or update mode."""
    return tokens_of(texts).groupBy("model_dir", "token").agg(F.count(F.lit(1)).alias("c"))
