"""Discourse features: counts and rates per thousand words, by topic and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def rates(texts: DataFrame) -> DataFrame:
    """24 features for each corpus and scope: category, count, words, rate per 1000 words. Corpora without words have none."""
    features = X.discourse_features()
    names = list(features)
    counted = texts.select("model_dir", "topic", X.word_count(F.col("text")).alias("words"), *(F.regexp_count(X.text_of(F.col("text")), F.lit(p)).cast("long").alias(f"f{k}") for k, (_, p) in enumerate(features.values())))
    sets = counted.groupingSets([["model_dir", "topic"], ["model_dir"]], "model_dir", "topic").agg(F.grouping("topic").alias("g"), F.sum("words").alias("words"), *(F.sum(f"f{k}").alias(f"f{k}") for k in range(len(names))))
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(features[n][0]).alias("category"), F.col(f"f{k}").alias("n")) for k, n in enumerate(names))))
    out = sets.where("words > 0").select("model_dir", F.when(F.col("g") == 1, "pooled").otherwise(F.col("topic")).alias("scope"), "words", listed.alias("x"))
    return out.select("model_dir", "scope", "x.category", "x.feature", F.col("x.n").cast("long").alias("count"), F.col("words").cast("long").alias("words"), F.round(1000.0 * F.col("x.n") / F.col("words"), 4).alias("rate"))


def category_matrix(table: DataFrame, category: str) -> DataFrame:
    """Pooled rates of one category, corpora by features."""
    names = [n for n, (c, _) in X.discourse_features().items() if c == category]
    wide = table.where((F.col("scope") == "pooled") & (F.col("category") == category)).groupBy("model_dir").pivot("feature", names).agg(F.first("rate"))
    return wide.select("model_dir", *(F.col(f"`{n}`").alias(n.replace(" ", "_")) for n in names))
