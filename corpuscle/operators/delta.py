"""Burrows' delta, in two estimators that must not be compared with each other, and cosine delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.readers import written
from .lexical import counts, place_of, ranked, tokens_of
from .order import stream, streams


def per_text(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Relative frequency of each of the words (a short list) in each text that has it: model_dir, topic, text_ord, token, x."""
    rows = texts.select("model_dir", "topic", "text_ord", X.tokens(F.col("text")).alias("w")).select("model_dir", "topic", "text_ord", F.size("w").alias("len"), F.inline(X.counted(F.col("w"))))
    counted = rows.join(F.broadcast(words), "token")  # counts are made where the texts are
    return counted.select("model_dir", "topic", "text_ord", "token", (F.col("c") / F.col("len")).alias("x"))


def features_of(texts: DataFrame, features: int = 100, words: DataFrame | None = None) -> DataFrame:
    """The most frequent words of all corpora, ties to the first seen. words: their `counts` by corpus, if there are any."""
    if words is None:
        words = counts(tokens_of(texts), "model_dir", place=place_of(texts)[0])
    every = words.groupBy("token").agg(F.sum("c").alias("c"), F.min(F.struct("model_dir", "first")).alias("first"))
    return every.orderBy(F.desc("c"), "first").limit(features).select("token")


def reference(x: DataFrame, total: DataFrame) -> DataFrame:
    """Mean and sample deviation of each word over all texts (1e-12 for 0): token, mu, sigma. total: one row with n, their number."""
    over = x.groupBy("token").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).crossJoin(F.broadcast(total))  # one row of totals
    mean = F.col("s") / F.col("n")
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)))
    return over.select("token", mean.alias("mu"), F.when(sigma > 0, sigma).otherwise(1e-12).alias("sigma"))


def centroids(texts: DataFrame, features: int = 100, words: DataFrame | None = None) -> DataFrame:
    """A10: mean z-score of each corpus for the most frequent words of all corpora: model_dir, token, z.

    Per text the feature is its relative frequency (0 in an empty text); mean and deviation (sample) are over all texts.
    The mean of z-scores is linear in the texts, so sums by corpus and word suffice, and zeros need no row.
    """
    sizes = texts.groupBy("model_dir").agg(F.count(F.lit(1)).alias("n_m"))
    x = per_text(texts, features_of(texts, features, words))
    sums = x.groupBy("model_dir", "token").agg(F.sum("x").alias("s"))
    over = reference(x, sizes.agg(F.sum("n_m").cast("double").alias("n")))
    grid = F.broadcast(sizes).join(F.broadcast(over))  # corpora by features: both lists are short
    return grid.join(sums, ["model_dir", "token"], "left").select("model_dir", "token", ((F.coalesce("s", F.lit(0.0)) / F.col("n_m") - F.col("mu")) / F.col("sigma")).alias("z"))


def between(z: DataFrame, places: int = 6) -> DataFrame:
    """Burrows (mean absolute difference) and cosine (A11: 1 - cosine, 0 for a zero vector) distances of centroids."""
    a, b = z.select(F.col("model_dir").alias("model_a"), "token", F.col("z").alias("za")), z.select(F.col("model_dir").alias("model_b"), "token", F.col("z").alias("zb"))
    both = a.join(b, "token").where("model_a < model_b").groupBy("model_a", "model_b").agg(
        F.avg(F.abs(F.col("za") - F.col("zb"))).alias("d"), F.sum(F.col("za") * F.col("zb")).alias("ab"), F.sum(F.col("za") ** 2).alias("aa"), F.sum(F.col("zb") ** 2).alias("bb")
    )
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), 1 - F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
    return both.select("model_a", "model_b", F.round("d", places).alias("burrows"), F.round(cosine, places).alias("cosine"))


def chunked(texts: DataFrame, features: int = 100, chunks: int = 20, pairs: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Delta of each pair over consecutive chunks of both token streams, with the pair's own most frequent words.

    A stream of N tokens has `chunks` chunks of N / chunks tokens (rounded down, one at least); what remains is dropped.
    z-scores are over both sides' chunks (sample deviation). Words are those with the largest count in both streams
    together, ties to the first seen in model_a, then in model_b. pairs: (model_a, model_b), all by default.
    places: where texts stand in other streams than their corpora's (see `streams`); those are compared then.

    A pair's words have a count of at least the larger of both sides' k-th largest, so at least half of that on one side:
    only such words are looked at, never a pair's whole vocabulary.

    Streams by places take a text many times, so only the corpora's frequent words are counted in them, if that can be seen to
    suffice: any other word comes at most as often in a pair as `_heads` says. If some pair's words don't come more often than
    that, all words are counted.
    """
    if places is not None:
        among, rest = _heads(texts, places, features * HEAD)
        chosen, words = _chosen(texts, features, chunks, pairs, places, among)
        if _suffices(chosen, words, places, rest, features):
            return _gaps(chosen)
    return _gaps(_chosen(texts, features, chunks, pairs, places)[0])


#: Times as many words of each corpus are counted in streams by places as a pair has.
HEAD = 10


def _heads(texts: DataFrame, places: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k most frequent words of each corpus (token), and how often any other word comes in a stream at most (stream, rest)."""
    words = written(counts(tokens_of(texts), "model_dir"), "corpus-words")
    among = written(ranked(words, k, "model_dir").select("token").distinct(), "heads")
    rest = words.join(F.broadcast(among), "token", "left_anti").groupBy("model_dir").agg(F.max("c").alias("rest"))  # a row per corpus
    parts = places.where("n > 0").select("stream", "model_dir").distinct()
    same = F.col("a.model_dir").eqNullSafe(F.col("b.model_dir"))
    return among, parts.alias("a").join(F.broadcast(rest.alias("b")), same, "left").groupBy("stream").agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("rest"))


def _suffices(chosen: DataFrame, words: DataFrame, places: DataFrame, rest: DataFrame, features: int) -> bool:
    """Whether no word left out can be among a pair's own, and no stream is without a word."""
    side = lambda k: rest.select(F.col("stream").alias(f"model_{k}"), F.col("rest").alias(f"rest_{k}"))
    least = chosen.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c")).join(side("a"), "model_a").join(side("b"), "model_b")
    other = F.col("rest_a") + F.col("rest_b")
    short = least.where((other > 0) & ((F.col("k") < features) | (F.col("c") <= other)))
    missing = places.where("n > 0").select(F.col("stream").alias("model_dir")).distinct().join(words.select("model_dir").distinct(), "model_dir", "left_anti")
    return short.isEmpty() and missing.isEmpty()


def _chosen(texts: DataFrame, features: int, chunks: int, pairs: DataFrame | None, places: DataFrame | None, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each pair's own words with both sides' sums over chunks, and the words of each stream."""
    size = F.greatest(F.floor(F.col("n") / chunks), F.lit(1))
    rows = (stream(texts) if places is None else streams(texts, places, among)).select("model_dir", "token", "i", "n", size.alias("size"), F.floor(F.col("i") / size).alias("chunk"))
    per_chunk = rows.groupBy("model_dir", "token", "n", "size", "chunk").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("i"))
    x = F.when(F.col("chunk") < chunks, F.col("c") / F.col("size")).otherwise(0.0)
    held = F.least(F.ceil(F.col("n") / F.col("size")), F.lit(chunks)).alias("n_chunks")
    words = per_chunk.groupBy("model_dir", "token", held).agg(F.sum("c").alias("c"), F.min("i").alias("i"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    words = written(words, "words")  # a row per corpus and word, read by each side of the pairs
    held = words.groupBy("model_dir").agg(F.first("n_chunks").alias("n_chunks"))
    kth = Window.partitionBy("model_dir").orderBy(F.desc("c"))
    least = words.withColumn("r", F.row_number().over(kth)).where(F.col("r") <= features).groupBy("model_dir").agg(F.when(F.count(F.lit(1)) == features, F.min("c")).otherwise(0).alias("least"))
    roster = held.join(least, "model_dir")
    side = lambda k: roster.select(F.col("model_dir").alias(f"model_{k}"), F.col("least").alias(f"l_{k}"), F.col("n_chunks").alias(f"n_{k}"))
    if pairs is None:
        both = side("a").join(side("b"), F.col("model_a") < F.col("model_b"))
    else:
        both = pairs.select("model_a", "model_b").join(side("a"), "model_a").join(side("b"), "model_b")
    both = both.select("model_a", "model_b", "n_a", "n_b", (F.greatest("l_a", "l_b") / 2).alias("bound"))
    likely = lambda k: words.join(F.broadcast(both), F.col("model_dir") == F.col(f"model_{k}")).where(F.col("c") >= F.col("bound")).select("model_a", "model_b", "n_a", "n_b", "token")
    wanted = likely("a").unionByName(likely("b")).distinct()
    own = lambda k: words.select(F.col("model_dir").alias(f"model_{k}"), "token", *(F.col(c).alias(f"{c}_{k}") for c in ("c", "i", "s", "q")))
    joined = wanted.join(own("a"), ["model_a", "token"], "left").join(own("b"), ["model_b", "token"], "left").na.fill(0, ["c_a", "c_b", "s_a", "s_b", "q_a", "q_b"])
    joined = joined.withColumn("c", F.col("c_a") + F.col("c_b")).withColumn("first", F.when(F.col("i_a").isNotNull(), F.struct(F.lit(0).alias("side"), F.col("i_a").alias("i"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("i_b").alias("i"))))
    return written(ranked(joined, features, "model_a", "model_b"), "chosen"), words


def _gaps(chosen: DataFrame) -> DataFrame:
    n = F.col("n_a") + F.col("n_b")
    mean = (F.col("s_a") + F.col("s_b")) / n
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("q_a") + F.col("q_b") - n * mean * mean) / (n - 1)))
    gap = F.abs(F.col("s_a") / F.col("n_a") - F.col("s_b") / F.col("n_b")) / F.when(sigma > 0, sigma).otherwise(1e-12)
    return chosen.groupBy("model_a", "model_b").agg(F.round(F.avg(gap), 6).alias("burrows_chunked"))
