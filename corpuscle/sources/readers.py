"""Sources and sinks: corpora as CSV, posts as JSON lines, folders of texts, result tables."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("topic", "model", "text", "language", "author_id", "source_id")])
POST = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "author", "title", "selftext", "subreddit", "link_flair_text")] + [T.StructField("delta", T.BooleanType())])
#: Parts of a path that are not corpora.
EXCLUDED = r"/(?:smoke_[^/]*|archives|[^/]*buggy-prompt[^/]*|[^/]*\(ITA\)[^/]*|LLaMAntino[^/]*)(?:/|$)"
HUMAN = ("webis_cmv_20", "reuters_50")


def corpus_of(path: Column) -> Column:
    """S3: the folder above the topic's; the first phase's name, lower case with dashes for spaces, for files of that phase."""
    file = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.cleaned)?\.csv$", 1), "(?:%20| )", "-"))
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)
    return F.when(folder.startswith("phase0"), F.concat(F.lit("phase0_"), file)).otherwise(folder)


def topic_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_corpora(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW, human: bool = False) -> DataFrame:
    """CSV corpora (texts may hold line ends) with model_dir and topic from their paths; rows without a text are dropped."""
    rows = spark.read.csv(paths, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    rows = rows.withColumn("__path", F.input_file_name()).where(~F.col("__path").rlike(EXCLUDED))
    rows = _by_path(rows, F.col("__path")).drop("__path")
    return (rows if human else rows.where(~F.coalesce(F.col("model_dir").isin(*HUMAN), F.lit(False)))).where(F.col("text").isNotNull())


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, bz2 or not; malformed lines are dropped."""
    return spark.read.schema(POST).option("mode", "DROPMALFORMED").json(path)


def read_texts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A folder of authors' folders of texts: author_id, file, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("author_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", encoding).alias("text"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there, on any file system."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return next((p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))), None)


#: Used only where a local session names no folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, for a table that several branches of a plan read: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/corpuscle/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing reads any more."""
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """`written` for a short result that much was moved for: Spark lets a plan's shuffle files go once the plan is collected as garbage."""
    out = written(df, name)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def write_corpora(texts: DataFrame, path: str, order: str = "text_ord") -> None:
    """K4: texts as CSV, a folder for each corpus and in it one for each topic, each file sorted by a column; the topic stays a
    column too, the corpus is told by the path. White space at either end of a text is part of it."""
    rows = texts.select(*(c for c in texts.columns if c not in ("model_dir", "topic")), "topic", F.col("model_dir").alias("c"), F.col("topic").alias("t"))
    rows = rows.select("topic", *(c for c in rows.columns if c != "topic"))
    rows.sortWithinPartitions("c", "t", order).write.partitionBy("c", "t").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _by_path(rows: DataFrame, path: Column) -> DataFrame:
    """S3: corpus and topic from a file's folders, named plainly or "column=value"."""
    bare = lambda c: F.call_function("url_decode", F.regexp_replace(F.regexp_replace(c, "^[a-z]+=", ""), r"\+", "%2B"))
    named = lambda c: F.nullif(bare(c), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return rows.withColumn("model_dir", named(corpus_of(path))).withColumn("topic", named(topic_of(path)))


def read_cleaned(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cleaned corpora without flagged rows: those of the four flags that the files have, a null one counting as set; `text` is
    the cleaned text if there is one, "" for a null."""
    rows = spark.read.csv(paths, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    rows = _by_path(rows, F.input_file_name())
    for flag in (f for f in ("flag_repetition_loop", "flag_code_contam", "flag_non_english", "flag_truncation") if f in rows.columns):
        rows = rows.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(True)))
    return rows.withColumn("text", F.coalesce(F.col("text_clean" if "text_clean" in rows.columns else "text"), F.lit("")))


def read_by_author(spark: SparkSession, folders: list[str]) -> DataFrame:
    """author_id and text of the first of these corpora that is there, cleaned ones before raw; blank texts left out."""
    path = first_existing(spark, folders)
    if path is None:
        raise FileNotFoundError(f"none of {folders}")
    return read_cleaned(spark, f"{path}/*/*/*").where(~X.blank(F.col("text"))).select("author_id", "text")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table as written by `write_table`."""
    return spark.read.csv(path, header=True, schema=schema)


def write_parsed(parsed: DataFrame, path: str) -> None:
    """K3: parsed tokens as Parquet, a folder for each corpus. Each task keeps a file open per corpus (64 at most, with small row
    groups), so that tokens are not sorted by corpus first, which spills several times what is written."""
    conf, name = parsed.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, "64")
    try:
        parsed.write.partitionBy("model_dir").option("parquet.block.size", str(16 << 20)).parquet(path)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed tokens; for the guard by number of texts see operators.syntax.checked."""
    return spark.read.option("basePath", path).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is scanned by fewer tasks than there are cores (one small file) dealt to all of them; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver documents as texts: source is the corpus, lang the topic."""
    return spread(_documents(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("model_dir"), F.col("lang").alias("topic"), F.col("doc_id").alias("text_ord"), "text")


def write_table(df: DataFrame, path: str, places: int = 6) -> None:
    """K1: CSV with doubles rounded to a fixed number of places."""
    df.select(*(F.format_string(f"%.{places}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).write.csv(path, header=True)
