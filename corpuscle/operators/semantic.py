"""Embedding summaries and a language model of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import tokens_of


def redundancy(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """A43 for unit vectors: spread = 1 - |mean|, mean pairwise cosine = (|sum|^2 - n) / (n (n - 1)); no pair is made."""
    rows = vectors.where(F.col(vector).isNotNull()).select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"), F.lit(1).alias("one"))
    sums = rows.groupBy(by, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n, square = F.max("n"), F.sum(F.col("s") * F.col("s"))
    return sums.groupBy(by).agg(
        n.cast("long").alias("n"), F.round(1 - F.sqrt(square) / n, 6).alias("spread"),
        F.round(F.when(n > 1, (square - n) / (n * (n - 1))), 6).alias("mean_cosine"),
    )


def pca(vectors: DataFrame, key: str, vector: str = "embedding", k: int = 2) -> DataFrame:
    """First k principal components, in place of a neighbour embedding, which Spark has not (distances differ)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    out = PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows)
    return out.select(key, *(vector_to_array("p")[i].alias(f"pc{i + 1}") for i in range(k)))


def perplexity(texts: DataFrame) -> DataFrame:
    """U3 offline, F24, A42: perplexity of each corpus under an add-one unigram model of all corpora together."""
    words = tokens_of(texts).groupBy("model_dir", "text_ord", "token").agg(F.count(F.lit(1)).alias("c"))
    model = words.groupBy("token").agg(F.sum("c").alias("k"))
    totals = model.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("v"))
    nll = -F.log((F.col("k") + 1.0) / (F.col("n") + F.col("v")))
    scored = words.join(model, "token").crossJoin(F.broadcast(totals))  # one row of totals
    per_text = scored.groupBy("model_dir", "text_ord").agg(F.sum("c").alias("n_tokens"), (F.sum(F.col("c") * nll) / F.sum("c")).alias("nll"))
    ppl = F.exp(F.least(F.col("nll"), F.lit(50.0)))
    return per_text.groupBy("model_dir").agg(
        F.count(F.lit(1)).cast("long").alias("n_texts"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.round(F.avg("nll"), 6).alias("mean_nll"),
        F.round(F.percentile(ppl, F.lit(0.5)), 4).alias("median_ppl"), F.round(F.avg(ppl), 4).alias("mean_ppl"), F.round(F.stddev_samp(ppl), 4).alias("std_ppl"),
    )


def rank_by(table: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Corpora ranked by a column; a table of corpora is short."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, table.columns[0])))


def ranked(table: DataFrame, name: str, k: int, *order: Column) -> DataFrame:
    """O1: the first k rows in an order, with their place. Only each task's first k reach the window."""
    rows = table.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return rows.where(F.col(name) <= k).orderBy(name)
