"""Helpers that the operators share: the shared folder, written tables, words."""

from __future__ import annotations

import re
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/corpuscle"
#: What is broadcast at once, in bytes (as estimated): a larger side is joined by a shuffle, or in blocks.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/corpuscle/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return a reader of it.

    The lineage ends there: a lost executor costs a re-read, never a re-run.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by `written` that nothing reads any more."""
    path = getattr(df, "_written_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """`df` in as many partitions as a shuffle has, for a step that makes far more of a row than the row's size tells.

    It is dealt by a hash of the columns: by the columns themselves, an exchange that is there already would do, and that
    one may be coalesced by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def in_one_column(df: DataFrame, **more: Column) -> DataFrame:
    """`df` with all its columns in one, `row`, and the columns `more`: nothing of `df` can clash with them."""
    return df.select(F.struct(*(F.col(_quoted(c)) for c in df.columns)).alias("row"), *(v.alias(k) for k, v in more.items()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fits(df: DataFrame, row_bytes: Column | int) -> bool:
    """Whether the rows of a written table, `row_bytes` each, come to at most BROADCAST_BYTES."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).alias("b")).first().b or 0
    return size <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """A written table, marked for broadcast if it fits. The join's result is the same either way: beyond the bound both
    sides are shuffled."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are.

    A text without multi-byte characters takes the built-in `lower`, which then does the same and is faster.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
