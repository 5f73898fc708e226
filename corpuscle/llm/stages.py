"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.

Documents are told by doc_id and the hash of their text together, so that a null or repeated doc_id never mixes up two
texts. Decisions, not texts, are shuffled; what is decided comes back to the texts by a broadcast of checked size, or by
a shuffle beyond it. An empty table gives an empty one, whatever columns there are besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_one_column, small, written
from .decontaminate import decontaminate
from .mixing import mix
from .pii import sanitise
from .quality import keep_good
from .queries import MIX, table
from .simhash import class_decisions

#: Bytes of a broadcast row of doc_id, hash and a mark, as estimated.
_MARK_BYTES = 64


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled documents among `docs`.

    Repeated rows and rows with one doc_id are each judged by their own text. A null or empty text is judged by all-zero
    statistics, a null doc_id has no label; without any label every score is 0.5, and all rows stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: that with the smallest doc_id, null after all others, ties to the least hash of
    the text. Repeated rows of it, by doc_id and text, count as one; null and empty texts are one class."""
    decided = class_decisions(docs).where(~F.col("kept") | (F.col("n") > 1))
    marks = written(decided.select(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash"), F.col("kept").alias("again")), "marks")
    rows = in_one_column(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash"))
    rest = rows.join(small(marks, _MARK_BYTES), same, "left_anti").select("row.*")
    again = written(marks.where("again"), "repeated")
    if again.isEmpty():
        return rest
    once = rows.join(small(again, _MARK_BYTES), same, "left_semi").dropDuplicates(["id", "text_hash"])
    return rest.unionByName(once.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. A document goes if a whole window of an item occurs in it, however long it is, or
    if at least a twentieth of its words are an item's (which then is shorter than a window: such a match proves little).

    A null or empty text has no words and stays; repeated rows share their fate; another text under the same doc_id
    doesn't.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.where(F.col("whole_window") | F.col("contaminated")).select(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash")).distinct(), "contaminated")
    rows = in_one_column(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    return rows.join(small(gone, _MARK_BYTES), F.col("id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash")), "left_anti").select("row.*")


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced; n_chars follows the text (null for a null text)."""
    return sanitise(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: which documents are used, and how often. Null languages and sources are nodes of the tree like
    any other (as empty names); see `mix` for ties and repeats."""
    return mix(docs, MIX)
