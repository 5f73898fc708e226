"""Pairwise comparison of corpora. A pair is unordered: model_a precedes model_b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.readers import written
from .lexical import counts, heads, place_of, ranked, tokens_of

EPS = 1e-12


def pairs_of(table: DataFrame) -> DataFrame:
    """Pairs of corpora. A roster of corpora is short, so the triangle of pairs is too."""
    names = table.select("model_dir").distinct()
    a, b = names.withColumnRenamed("model_dir", "model_a"), names.withColumnRenamed("model_dir", "model_b")
    return a.join(b, F.col("model_a") < F.col("model_b"))


def aligned(table: DataFrame, value: str, pairs: DataFrame | None = None) -> DataFrame:
    """For each pair the union of both sides' tokens with both values, 0 where one side has none. pairs: those of the
    table's corpora by default; a roster is a short list."""
    pairs = F.broadcast(pairs_of(table) if pairs is None else pairs)
    left = table.join(pairs, F.col("model_dir") == F.col("model_a")).select("model_a", "model_b", "token", F.col(value).alias("x"), F.lit(0).cast("long").alias("y"))
    right = table.join(pairs, F.col("model_dir") == F.col("model_b")).select("model_a", "model_b", "token", F.lit(0).cast("long").alias("x"), F.col(value).alias("y"))
    return left.unionByName(right).groupBy("model_a", "model_b", "token").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def jaccard(texts: DataFrame, k: int = 100) -> DataFrame:
    """Overlap of the k most frequent words; 1 if neither side has any, 0 if one has none."""
    return jaccard_of(counts(tokens_of(texts), "model_dir", place=place_of(texts)[0]), pairs_of(texts), k)


def jaccard_of(words: DataFrame, pairs: DataFrame, k: int = 100) -> DataFrame:
    words = ranked(words, k, "model_dir").select("model_dir", "token", F.lit(1).cast("long").alias("one"))
    both = aligned(words, "one", pairs).groupBy("model_a", "model_b").agg(F.sum(F.col("x") * F.col("y")).alias("i"), F.count(F.lit(1)).alias("u"))
    every = pairs.join(both, ["model_a", "model_b"], "left")
    return every.select("model_a", "model_b", F.round(F.coalesce(F.col("i") / F.col("u"), F.lit(1.0)), 6).alias("jaccard"))


def jsd_of(table: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of counts (model_dir, token, c); each side plus EPS, normalised; 1 if a side of
    one of `pairs` (those of the table's corpora by default) has no counts. The counts are made once, however often a pair reads them."""
    table = written(table, "counts")
    pairs = pairs_of(table) if pairs is None else pairs
    both = aligned(table, "c", pairs)
    sums = both.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("k"), F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    both = both.join(F.broadcast(sums), ["model_a", "model_b"])  # one row per pair
    p = (F.col("x") / F.nullif("tx", F.lit(0)) + EPS) / (1 + F.col("k") * EPS)
    q = (F.col("y") / F.nullif("ty", F.lit(0)) + EPS) / (1 + F.col("k") * EPS)
    m = (p + q) / 2
    found = both.groupBy("model_a", "model_b").agg(F.sum(0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)).alias("jsd"))
    return pairs.join(found, ["model_a", "model_b"], "left").select("model_a", "model_b", F.round(F.coalesce("jsd", F.lit(1.0)), 6).alias("jsd"))


def jsd(texts: DataFrame, n: int, k: int = 500) -> DataFrame:
    """JSD of the k most frequent n-grams."""
    return jsd_of(heads(texts, n, k).select("model_dir", "token", "c"), pairs_of(texts))


def cohens_d(stats: DataFrame) -> DataFrame:
    """A13 from (model_dir, mean, var): difference of means over the pooled standard deviation; 0 if that is 0."""
    a = stats.select(F.col("model_dir").alias("model_a"), F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = stats.select(F.col("model_dir").alias("model_b"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    both = a.join(b, F.col("model_a") < F.col("model_b"))
    return both.select("model_a", "model_b", F.round(F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled).otherwise(0.0), 6).alias("d"))


def lengths(texts: DataFrame) -> DataFrame:
    """tokens per text."""
    return texts.select("model_dir", "text_ord", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


def sentence_lengths(texts: DataFrame) -> DataFrame:
    """tokens per sentence."""
    rows = texts.select("model_dir", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.select("model_dir", F.size(X.tokens(F.col("s"))).cast("long").alias("n"))


def moments(values: DataFrame) -> DataFrame:
    return values.groupBy("model_dir").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"))


def length_stats(values: DataFrame) -> DataFrame:
    """Count, mean and population standard deviation."""
    return values.groupBy("model_dir").agg(F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


def _ks(values: DataFrame) -> DataFrame:
    table = values.groupBy("model_dir", F.col("n").alias("token")).agg(F.count(F.lit(1)).alias("c"))
    both = aligned(table, "c")
    upto = Window.partitionBy("model_a", "model_b").orderBy("token")
    whole = Window.partitionBy("model_a", "model_b")
    gap = F.abs(F.sum("x").over(upto) / F.sum("x").over(whole) - F.sum("y").over(upto) / F.sum("y").over(whole))
    both = both.withColumn("gap", gap)
    return both.groupBy("model_a", "model_b").agg(F.max("gap").alias("d"), F.sum("x").cast("long").alias("n_a"), F.sum("y").cast("long").alias("n_b"))


def ks(values: DataFrame) -> DataFrame:
    """Largest distance of the empirical distributions; sizes of both samples."""
    return _ks(values).select("model_a", "model_b", F.round("d", 6).alias("ks"), "n_a", "n_b")


def ks_test(values: DataFrame) -> DataFrame:
    """`ks` and `ks_p`, its two-sided p-value."""
    found = _ks(values).repartition("model_a", "model_b")
    return found.select("model_a", "model_b", F.round("d", 6).alias("ks"), "n_a", "n_b", F.round(ks_p("d", F.col("n_a").cast("double"), F.col("n_b").cast("double")), 6).alias("ks_p"))


#: Samples of at most so many values have an exact p-value.
EXACT = 10_000


def exact_p(d: float, n: int, m: int) -> float:
    """The share of all orders of n and m values whose distributions are somewhere at least d apart.

    An order is a lattice path from (0, 0) to (n, m). The chance that a random one has stayed within d is carried along
    from one number of steps to the next, for all points that far from the start at once.
    """
    import math

    import numpy as np

    g = math.gcd(n, m)
    h = round(d * (n // g) * m)  # the distance, as a whole number of 1 / lcm(n, m)
    if h <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for step in range(1, n + m + 1):
        lo, hi = max(0, step - m), min(n, step)
        at = i[lo : hi + 1]
        moved = inside[lo : hi + 1] * ((step - at) / step)
        moved[1 if lo == 0 else 0 :] += inside[max(lo, 1) - 1 : hi] * (at[1 if lo == 0 else 0 :] / step)
        moved[np.abs(at * (m // g) - (step - at) * (n // g)) >= h] = 0.0
        inside[:] = 0.0
        inside[lo : hi + 1] = moved
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(T.DoubleType())
def ks_p(d, n, m):
    """Two-sided p-value of a two-sample KS statistic (not rounded): exact up to EXACT values a side, beyond it
    Kolmogorov's series with a correction for size."""
    import numpy as np

    def series(x, a, b):
        en = np.sqrt(a * b / (a + b))
        lam = (en + 0.12 + 0.11 / en) * x
        k = np.arange(1, 101)
        return 1.0 if lam < 1e-3 else float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * lam**2)), 0, 1))

    return d.combine(n, lambda x, a: (x, a)).combine(m, lambda xa, b: None if b != b or xa[0] is None or xa[0] != xa[0] else exact_p(xa[0], int(xa[1]), int(b)) if max(xa[1], b) <= EXACT else series(xa[0], xa[1], b)).astype(float)


def matrix(distances: DataFrame, names: list[str]) -> DataFrame:
    """K2: the symmetric matrix of a long table (model_a, model_b, distance), 0 on its diagonal; one column per name."""
    both = distances.select("model_a", "model_b", "distance").unionByName(distances.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "distance"))
    wide = both.groupBy("model_a").pivot("model_b", names).agg(F.first("distance"))
    return wide.select(F.col("model_a").alias("model"), *(F.when(F.col("model_a") == n, 0.0).otherwise(F.col(n)).alias(n) for n in names))


def verdict(bigram: Column, jaccard_: Column, d: Column, delta: Column, text_p: Column, sentence_p: Column) -> Column:
    """Warnings of a comparison; delta is the pair's own (A9), text_p and sentence_p are KS p-values of lengths."""
    named = [("text_lengths", text_p < 0.05), ("sentence_lengths", sentence_p < 0.05), ("effect_size", F.abs(d) > 0.2), ("vocabulary", jaccard_ < 0.7), ("bigrams", bigram > 0.15), ("delta", delta > 1)]
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named))), ",")


def quantile_vectors(values: DataFrame, points: int = 200) -> DataFrame:
    """Linear quantiles of each corpus' values at evenly spaced shares from 0 to 1: model_dir, k, q.

    From counts per value, so a corpus' values are never sorted one by one: a quantile lies between the values at two ranks.
    """
    rows = values.groupBy("model_dir", F.col("n").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("model_dir").orderBy("v")
    rows = rows.withColumn("hi", F.sum("c").over(upto)).withColumn("size", F.sum("c").over(Window.partitionBy("model_dir"))).withColumn("next", F.lead("v").over(upto))
    rows = rows.withColumn("lo", F.col("hi") - F.col("c"))
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    rows = rows.select("*", k.alias("k")).withColumn("at", F.col("k") / F.lit(float(points - 1)) * (F.col("size") - 1))
    rows = rows.where((F.floor("at") >= F.col("lo")) & (F.floor("at") < F.col("hi")))
    above = F.when(F.floor("at") + 1 < F.col("hi"), F.col("v")).otherwise(F.coalesce("next", "v"))
    return rows.select("model_dir", F.col("k").cast("long").alias("k"), F.round(F.col("v") + (F.col("at") - F.floor("at")) * (above - F.col("v")), 6).alias("q"))


def histogram(values: DataFrame, a: str, b: str) -> DataFrame:
    """Densities of two corpora's values over shared bins: bin, lo, n_a, n_b, density_a, density_b.

    Bins are as wide as the narrower of Sturges' and Freedman and Diaconis' rule says for both together (Sturges' where
    the quartiles coincide).
    """
    both = values.where(F.col("model_dir").isin(a, b)).select("model_dir", F.col("n").cast("double").alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    stats = both.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), q.alias("q"))
    span, iqr = F.col("hi") - F.col("lo"), F.col("q")[1] - F.col("q")[0]
    sturges, fd = span / (F.log2("n") + 1), 2 * iqr / F.pow("n", F.lit(1 / 3))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(F.round(span / width, 9))).otherwise(1).cast("int")
    stats = stats.select("lo", span.alias("span"), bins.alias("bins"))
    each = both.crossJoin(F.broadcast(stats))  # one row
    at = F.when(F.col("span") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("span") * F.col("bins")), F.col("bins") - 1)).otherwise(0)
    counts = each.groupBy(at.cast("int").alias("bin")).agg(F.count_if(F.col("model_dir") == a).alias("n_a"), F.count_if(F.col("model_dir") == b).alias("n_b"))
    sums = both.agg(F.count_if(F.col("model_dir") == a).alias("all_a"), F.count_if(F.col("model_dir") == b).alias("all_b"))
    edges = stats.select("lo", (F.col("span") / F.col("bins")).alias("w"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).crossJoin(sums)  # a row per bin
    out = edges.join(counts, "bin", "left").na.fill(0, ["n_a", "n_b"])
    share = lambda k: F.round(F.col(f"n_{k}") / F.nullif(f"all_{k}", F.lit(0)) / F.nullif("w", F.lit(0.0)), 9).alias(f"density_{k}")
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("lo"), "n_a", "n_b", share("a"), share("b"))
