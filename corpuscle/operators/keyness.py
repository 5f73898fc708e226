"""Keyness: words that a corpus uses more than all others together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..sources.readers import written
from .lexical import counts, tokens_of
from .order import BROADCAST_BYTES, OFFSET_BYTES, era


def g2(c1: Column, c2: Column, n1: Column, n2: Column) -> Column:
    """Log-likelihood; 0 log 0 is 0."""
    total = (c1 + c2) / (n1 + n2)
    part = lambda c, n: F.when(c > 0, c * F.log(c / (n * total))).otherwise(0.0)
    return 2 * (part(c1, n1) + part(c2, n2))


def log_ratio(c1: Column, c2: Column, n1: Column, n2: Column) -> Column:
    """Base 2, half a count added on both sides."""
    return F.log2(((c1 + 0.5) / n1) / ((c2 + 0.5) / n2))


def keywords(word_counts: DataFrame, k: int, least: int = 5, extra: tuple[str, ...] = ()) -> DataFrame:
    """Top words by log ratio against the rest (W7: total less own count), among those with enough counts and G2.

    word_counts: *extra, model_dir, token, c, first; written once, for the sums over it and its frequent words.
    """
    word_counts = written(word_counts, "word-counts")
    own, whole = [*extra, "model_dir"], word_counts.groupBy(*extra).agg(F.sum("c").alias("all"))
    sizes = word_counts.groupBy(*own).agg(F.sum("c").alias("n1"))
    frequent = word_counts.where(F.col("c") >= least).select(*extra, "token").distinct()
    if frequent.count() * OFFSET_BYTES <= BROADCAST_BYTES:
        frequent = F.broadcast(frequent)  # rare words' totals are not asked for, and stay where they are
    totals = word_counts.join(frequent, [*extra, "token"], "left_semi").groupBy(*extra, "token").agg((F.sum("c")).alias("both"))
    table = word_counts.where(F.col("c") >= least).join(totals, [*extra, "token"]).withColumn("c2", F.col("both") - F.col("c")).join(F.broadcast(sizes), own)  # a row per corpus
    table = table.join(F.broadcast(whole), list(extra)) if extra else table.crossJoin(F.broadcast(whole))  # one row
    table = table.where(F.col("c") >= least).withColumn("n2", F.col("all") - F.col("n1"))
    d = lambda n: F.col(n).cast("double")
    table = table.withColumn("g2", g2(d("c"), d("c2"), d("n1"), d("n2"))).withColumn("log_ratio", F.round(log_ratio(d("c"), d("c2"), d("n1"), d("n2")), 6))
    order = Window.partitionBy(*extra, "model_dir").orderBy(F.desc("log_ratio"), "first")
    found = table.where(F.col("g2") >= fixed.G2_LEAST).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(*extra, "model_dir", "rank", "token", F.col("c").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2"), F.round("g2", 4).alias("g2"), "log_ratio")


def topn(texts: DataFrame, k: int = 20, least: int = 5) -> DataFrame:
    return keywords(counts(tokens_of(texts), "model_dir"), k, least)


def half_samples(texts: DataFrame, reps: int, seed: str) -> DataFrame:
    """For each text the numbers of the half samples that it is in, as bits of `mask` (up to 63): the half of each corpus'
    texts, two at least, that come first by an md5 draw. Corpora of fewer than 4 texts have none (P8)."""
    rep = texts.select("model_dir", "text_ord", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    own = Window.partitionBy("rep", "model_dir")
    rep = rep.withColumn("r", F.row_number().over(own.orderBy(X.draw(seed, F.col("rep"), F.col("model_dir"), F.col("text_ord")), "text_ord"))).withColumn("n", F.count(F.lit(1)).over(own))
    bit = F.when(F.col("r") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rep"))).otherwise(F.lit(0).cast("long"))
    return rep.where("n >= 4").groupBy("model_dir", "text_ord").agg(F.bit_or(bit).alias("mask"))


def _marked(texts: DataFrame, masks: DataFrame) -> DataFrame:
    """The texts with their `mask`; they stay where they are while the masks fit a broadcast."""
    masks = written(masks, "masks")
    if masks.count() * OFFSET_BYTES <= BROADCAST_BYTES:
        masks = F.broadcast(masks)
    return texts.join(masks, ["model_dir", "text_ord"], "left")


def consensus(texts: DataFrame, reps: int = 50, k: int = 20, least: int = 20, seed: str = "keyness") -> DataFrame:
    """In how many of `reps` half samples of a corpus' texts a word is among its top k against the whole of the
    other corpora, by corpora of 4 texts and more; stable: at the point estimate too, and in 0.8 of the samples.

    Tokens are counted once: a text's bits tell which samples they go to, so nothing is copied per sample but words that a
    sample has often enough. Tokens meet the bits in their text, and are summed by corpus and word before they are moved.
    """
    masks = half_samples(texts, reps, seed)
    drawn = tokens_of(_marked(texts, masks), "mask")
    word = drawn.groupBy("model_dir", "token").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("text_ord", "pos")).alias("first"), F.max("mask").isNotNull().alias("ample"),
        *(F.sum(F.when(F.getbit("mask", F.lit(r)) == 1, 1).otherwise(0)).alias(f"s{r}") for r in range(reps)),
    )
    word = written(word, "half-samples")  # a row per corpus and word, for the sums over it and its frequent words
    totals = word.groupBy("token").agg(F.sum("c").alias("both"))
    sizes = word.groupBy("model_dir").agg(F.sum("c").alias("n"), *(F.sum(f"s{r}").alias(f"n{r}") for r in range(reps)))
    every = sizes.agg(F.sum("n").alias("all"))
    listed = F.array(F.struct(F.lit(-1).alias("rep"), F.col("c").alias("c1"), F.col("n").alias("n1")), *(F.struct(F.lit(r).alias("rep"), F.col(f"s{r}").alias("c1"), F.col(f"n{r}").alias("n1")) for r in range(reps)))
    rows = word.where(F.col("ample") & (F.col("c") >= least)).join(totals, "token").join(F.broadcast(sizes), "model_dir").crossJoin(F.broadcast(every))  # one row
    rows = rows.select("model_dir", "token", "first", (F.col("both") - F.col("c")).cast("double").alias("c2"), (F.col("all") - F.col("n")).cast("double").alias("n2"), F.explode(F.filter(listed, lambda x: x["c1"] >= least)).alias("x"))
    rows = rows.select("model_dir", "token", "first", "c2", "n2", "x.rep", F.col("x.c1").cast("double").alias("c1"), F.col("x.n1").cast("double").alias("n1")).where("n2 > 0")
    rows = rows.withColumn("g2", g2(F.col("c1"), F.col("c2"), F.col("n1"), F.col("n2"))).withColumn("log_ratio", F.round(log_ratio(F.col("c1"), F.col("c2"), F.col("n1"), F.col("n2")), 6))
    order = Window.partitionBy("rep", "model_dir").orderBy(F.desc("log_ratio"), "first")
    top = rows.where(F.col("g2") >= fixed.G2_LEAST).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rate = F.round(F.count_if(F.col("rep") >= 0) / reps, 4)
    out = top.groupBy("model_dir", "token").agg(rate.alias("selection_rate"), (F.min("rep") == -1).alias("point"))
    return out.withColumn("consensus", F.col("point") & (F.col("selection_rate") >= 0.8))


def shared(signatures: DataFrame, eras: dict[str, list[str]] = fixed.ERAS) -> DataFrame:
    """Words that are signatures of two corpora and more: token, n, first_era, place (most corpora first, then the
    earliest era, then the word). signatures: model_dir, token."""
    early = F.array_position(F.array(*map(F.lit, fixed.ERA_ORDER)), era(F.col("model_dir"), eras))
    words = signatures.groupBy("token").agg(F.count_distinct("model_dir").alias("n"), F.min(early).alias("e")).where("n > 1")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "e", "token")  # a list of signatures is short: at most k a corpus
    return words.select("token", "n", F.element_at(F.array(*map(F.lit, fixed.ERA_ORDER)), F.col("e").cast("int")).alias("first_era"), F.row_number().over(order).alias("place"))


def view_counts(parsed: DataFrame) -> DataFrame:
    """A41, U-1: counts of words by view (all, content, function), scope (each topic and pooled) and corpus: view, scope,
    model_dir, token, c, first. parsed: model_dir, topic, text_ord, i, lower, pos; spaces and punctuation left out (T4)."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("pos").isin(fixed.CONTENT_POS), "content").when(F.col("pos").isin(fixed.FUNCTION_POS), "function")))
    words = parsed.where(~F.col("is_space") & ~F.col("is_punct")).groupBy("model_dir", "topic", "pos", F.col("lower").alias("token")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("text_ord", "i")).alias("first"))
    words = words.withColumn("view", F.explode(kinds)).withColumn("scope", F.explode(F.array("topic", F.lit("pooled"))))
    return words.groupBy("view", "scope", "model_dir", "token").agg(F.sum("c").alias("c"), F.min("first").alias("first"))


def by_view(parsed: DataFrame, k: int = 20, least: int = 20, only: tuple[str, str] | None = None) -> DataFrame:
    """Top words of each view, scope and corpus; only: those of one view and scope."""
    held = view_counts(parsed)
    if only:
        held = held.where((F.col("view") == only[0]) & (F.col("scope") == only[1]))
    return keywords(held, k, least, ("view", "scope"))
