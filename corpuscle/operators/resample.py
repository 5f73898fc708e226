"""Resampling with md5 draws: bootstrap of the type-token ratio, split halves of corpora and authors. Draws belong to texts, as bits
or sides; tokens are never copied per repetition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.readers import written
from . import delta
from .lexical import scoped
from .order import BROADCAST_BYTES, OFFSET_BYTES, offsets


def bootstrap_weights(texts: DataFrame, reps: int, seed: str) -> DataFrame:
    """How often each text is drawn, with replacement, as many draws as the corpus has texts: rep, model_dir, text_ord, w."""
    own = Window.partitionBy("model_dir")
    rows = texts.select("model_dir", "text_ord", (F.row_number().over(own.orderBy("text_ord")) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    draws = rows.select("model_dir", "n", F.col("i").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    picked = draws.select("model_dir", "rep", F.pmod(X.draw(seed, F.col("rep"), F.col("model_dir"), F.col("d")), F.col("n")).alias("i"))
    weights = picked.groupBy("model_dir", "rep", "i").agg(F.count(F.lit(1)).alias("w"))
    return weights.join(rows.select("model_dir", "i", "text_ord"), ["model_dir", "i"]).select("rep", "model_dir", "text_ord", "w")


def sample_share(texts: DataFrame, reps: int, seed: str, share: float = 0.8) -> DataFrame:
    """R1's other form: `share` of each corpus' texts, one at least, without replacement: rep, model_dir, text_ord, w (1)."""
    rep = texts.select("model_dir", "text_ord", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    own = Window.partitionBy("rep", "model_dir")
    rep = rep.withColumn("r", F.row_number().over(own.orderBy(X.draw(seed, F.col("rep"), F.col("model_dir"), F.col("text_ord")), "text_ord"))).withColumn("n", F.count(F.lit(1)).over(own))
    return rep.where(F.col("r") <= F.greatest(F.lit(1), F.rint(F.col("n") * share))).select("rep", "model_dir", "text_ord", F.lit(1).cast("long").alias("w"))


#: Repetitions whose draws a task makes at once: it holds a 64-bit word for each text of the corpus.
WORD = 64


def drawn_words(places: DataFrame, reps: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """R1's draws, made a corpus and WORD repetitions at a time where their texts' sizes are, so that no draw is moved: the texts'
    bits (model_dir, text_ord, word, bits; texts never drawn left out) and the tokens of each sample (model_dir, rep, n).

    places: model_dir, text_ord, size, a row per text.
    """
    listed = places.where(F.col("model_dir").isNotNull()).groupBy("model_dir").agg(F.array_sort(F.collect_list(F.struct("text_ord", "size"))).alias("texts"))  # numbers only
    blocks = listed.select("model_dir", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // WORD))).alias("word"), F.col("texts.text_ord").alias("texts"), F.col("texts.size").alias("sizes"))
    blocks = blocks.repartition(max(1, (reps - 1) // WORD + 1) * 8, "model_dir", "word")

    def draws(rows: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import numpy as np

        for batch in rows:
            for row in range(batch.num_rows):
                model, word = batch["model_dir"][row].as_py(), batch["word"][row].as_py()
                texts, sizes = (batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("texts", "sizes"))
                size = len(texts)
                digits = [b"%d" % d for d in range(size)]
                bits, tokens = np.zeros(size, np.uint64), []
                for k in range(min(WORD, reps - word * WORD)):
                    start = hashlib.md5(f"{seed}|{word * WORD + k}|{model}|".encode(), usedforsecurity=False)
                    heads = bytearray()
                    for d in digits:
                        h = start.copy()
                        h.update(d)
                        heads += h.digest()[:4]
                    at = np.frombuffer(heads, ">u4").astype(np.int64) % size
                    bits[at] |= np.uint64(1 << k)
                    tokens.append(int(sizes[at].sum()))
                have = np.flatnonzero(bits)
                for lo in range(0, len(have), 1 << 16):
                    part = have[lo : lo + (1 << 16)]
                    yield _arrow(pa, model, texts[part], word, bits[part].view(np.int64))
                yield _arrow(pa, model, np.full(len(tokens), -1), np.arange(len(tokens)) + word * WORD, np.array(tokens, np.int64), True)

    made = written(blocks.mapInArrow(draws, "model_dir string, sample boolean, text_ord long, word int, bits long"), "draws")
    return made.where("NOT sample").select("model_dir", "text_ord", "word", "bits"), made.where("sample").select("model_dir", F.col("word").alias("rep"), F.col("bits").alias("n"))


def _arrow(pa, model: str, texts, word, bits, sample: bool = False):
    import numpy as np

    n = len(bits)
    return pa.RecordBatch.from_arrays(
        [pa.array([model] * n, pa.string()), pa.array([sample] * n), pa.array(texts, pa.int64()), pa.array(np.broadcast_to(word, n).astype(np.int32)), pa.array(bits, pa.int64())],
        ["model_dir", "sample", "text_ord", "word", "bits"],
    )


def bootstrap_ttr(texts: DataFrame, reps: int = 1000, seed: str = "boot", weights: DataFrame | None = None) -> DataFrame:
    """Mean, deviation and percentiles of the type-token ratio over bootstrap samples, and the point estimate.

    A text carries one bit per sample, whether it is drawn. A type is in a sample if a text with it is: its bits are those
    of its texts, or-ed before the shuffle. Tokens of a sample are sums of text lengths. weights: other samples than
    `bootstrap_weights`, whose draws are made without moving them.
    """
    words = -(-reps // WORD)
    sizes = written(texts.select("model_dir", F.col("text_ord").cast("long").alias("text_ord"), F.size(X.tokens(F.col("text"))).cast("long").alias("size")), "sizes")
    if weights is None:
        bits, drawn = drawn_words(sizes, reps, seed)
    else:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rep") % WORD)
        bits = weights.groupBy("model_dir", "text_ord", F.floor(F.col("rep") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
        drawn = weights.join(sizes, ["model_dir", "text_ord"]).groupBy("model_dir", "rep").agg(F.sum(F.col("w") * F.col("size")).alias("n"))
    masks = bits.groupBy("model_dir", "text_ord").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"m{k}") for k in range(words)))
    masks = written(masks, "masks")
    if masks.count() * (8 * words + OFFSET_BYTES) <= BROADCAST_BYTES:
        masks = F.broadcast(masks)  # texts stay where they are; beyond this size both sides are shuffled
    else:
        masks = masks.hint("merge")
    each = texts.select("model_dir", "text_ord", "text").join(masks, ["model_dir", "text_ord"], "left").select("model_dir", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"), *(f"m{k}" for k in range(words)))
    types = each.groupBy("model_dir", "token").agg(*(F.coalesce(F.bit_or(f"m{k}"), F.lit(0).cast("long")).alias(f"m{k}") for k in range(words)))

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for model, part in batch.groupby("model_dir"):
                held = part[[f"m{k}" for k in range(words)]].to_numpy(np.int64)
                held = np.ascontiguousarray(held, "<i8").view(np.uint8)
                for at in range(0, len(held), 4096):
                    bits = np.unpackbits(held[at : at + 4096], axis=1, bitorder="little")[:, :reps]
                    own = sums.setdefault(model, np.zeros(reps + 1, np.int64))
                    own[:reps] += bits.sum(0, dtype=np.int64)
                    own[reps] += len(bits)
        for model, v in sums.items():
            yield pd.DataFrame({"model_dir": model, "rep": np.arange(reps + 1), "v": v})

    found = types.where(F.col("model_dir").isNotNull()).mapInPandas(counted, "model_dir string, rep int, v long").groupBy("model_dir", "rep").agg(F.sum("v").alias("v"))
    found = written(found, "types")  # of each sample, and as sample `reps` of the whole corpus
    values = found.join(drawn, ["model_dir", "rep"]).select("rep", "model_dir", (F.col("v") / F.nullif("n", F.lit(0))).alias("v"))
    whole = sizes.groupBy("model_dir").agg(F.sum("size").alias("n"))
    point = found.where(F.col("rep") == reps).join(whole, "model_dir").select("model_dir", F.round(F.col("v") / F.col("n"), 6).alias("point"))
    return summarise(values, "model_dir").join(point, "model_dir")


def summarise(values: DataFrame, *by: str) -> DataFrame:
    """Mean, sample deviation and linear percentiles 2.5, 50 and 97.5 of `v`."""
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    table = values.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), q.alias("q"))
    return table.select(*by, "n", "mean", "std", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p2_5", "p50", "p97_5"))))


def halves(texts: DataFrame, reps: int, seed: str, by: tuple[str, ...] = ("model_dir",), most: int = 1000, least: int = 4) -> DataFrame:
    """The texts of each group in two halves (side 0 and 1) of up to `most` / 2 texts each, for each repetition by an md5
    draw: rep, *by, model_dir, text_ord, r (place in the draw), half, side. Groups of fewer than `least` texts have none.

    Only the first `most` of a group by draw are ranked further: a group's other texts don't reach its task.
    """
    keep = list(dict.fromkeys([*by, "model_dir", "topic", "text_ord"]))
    sizes = texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    drawn = X.draw(seed, F.col("rep"), *(F.col(b) for b in by), F.col("text_ord"))
    rep = texts.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("draw", drawn)
    if most < 1 << 20:
        rep = rep.withColumn("r", F.row_number().over(Window.partitionBy("rep", *by).orderBy("draw", "text_ord", "model_dir", "topic"))).where(F.col("r") <= most)
    else:  # places by ranges of the draw, so that no task ranks a whole group
        rep = rep.withColumn("part", F.shiftright("draw", 20))
        held = rep.groupBy("rep", *by, "part").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("rep", *by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).drop("c")
        inside = F.row_number().over(Window.partitionBy("rep", *by, "part").orderBy("draw", "text_ord", "model_dir", "topic"))
        rep = rep.withColumn("r", inside).join(held, ["rep", *by, "part"]).withColumn("r", F.col("r") + F.col("before")).drop("part", "before")
    rep = rep.join(F.broadcast(sizes), list(by))  # a row per group
    rep = rep.withColumn("half", F.floor(F.least(F.col("n"), F.lit(most)) / 2))
    return rep.where(F.col("r") <= 2 * F.col("half")).select("rep", *keep, "r", "half", F.when(F.col("r") <= F.col("half"), 0).otherwise(1).alias("side"))


def vectors(texts: DataFrame, features: int = 100) -> DataFrame:
    """Each text's z-scores for the most frequent words of all corpora, on one reference over all texts: v (array)."""
    x = delta.per_text(texts, delta.features_of(texts, features))
    over = delta.reference(x, texts.agg(F.count(F.lit(1)).cast("double").alias("n"))).orderBy("token").limit(features)
    listed = over.agg(F.array_sort(F.collect_list(F.struct("token", "mu", "sigma"))).alias("words"))  # a row of `features` words
    held = x.groupBy("model_dir", "topic", "text_ord").agg(F.map_from_entries(F.collect_list(F.struct("token", "x"))).alias("x"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("model_dir", "topic", "text_ord")]
    rows = texts.select("model_dir", "topic", "text_ord").alias("a").join(held.alias("b"), same, "left").select("a.*", "b.x").crossJoin(F.broadcast(listed))
    z = F.transform("words", lambda w: (F.coalesce(F.element_at("x", w["token"]), F.lit(0.0)) - w["mu"]) / w["sigma"])
    return rows.select("model_dir", "topic", "text_ord", z.alias("v"))


#: Repetitions whose halves meet the texts' vectors at once: a group holds at most so many times `most` vectors.
BLOCK = 25


def _halved(split: DataFrame, v: DataFrame, *by: str) -> DataFrame:
    """Burrows' and cosine delta of the two halves of each group and repetition: *by, rep, burrows, cosine.

    A text's vector goes to a block of repetitions once, with its side in each. A group is bounded by `halves`' cap.
    """
    key = ["model_dir", "topic", "text_ord"]
    marks = split.groupBy(*dict.fromkeys([*by, *key]), F.floor(F.col("rep") / BLOCK).alias("block")).agg(F.collect_list(F.struct("rep", "side")).alias("sides"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    rows = marks.alias("a").join(v.alias("b"), same).select(*(F.col(f"a.{c}") for c in by), "a.block", "a.sides", "b.v")
    out = ", ".join(f"{c} string" for c in by) + ", rep int, burrows double, cosine double"

    def measured(part):
        import numpy as np
        import pandas as pd

        x = np.stack(part.v.to_numpy())
        side = np.full((len(part), BLOCK), -1, np.int8)
        start = int(part.block.iloc[0]) * BLOCK
        for k, sides in enumerate(part.sides):
            for s in sides:
                side[k, s["rep"] - start] = s["side"]
        have = np.flatnonzero((side >= 0).any(0))
        a, b = (((side[:, have] == k).T.astype(float) @ x) / (side[:, have] == k).sum(0)[:, None] for k in (0, 1))
        norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        cosine = np.where(norm > 0, 1 - (a * b).sum(1) / np.where(norm > 0, norm, 1), 0.0)
        return pd.DataFrame({**{c: part[c].iloc[0] for c in by}, "rep": have + start, "burrows": np.abs(a - b).mean(1), "cosine": cosine})

    return rows.groupBy(*by, "block").applyInPandas(measured, out)


def within_corpus(texts: DataFrame, reps: int = 100, most: int = 1000, seed: str = "half", bridge: tuple[str, str] = ("", ""), author: str | None = None) -> DataFrame:
    """model_dir, scope, kind, rep, burrows, cosine. within_split: both halves of `reps` splits of each corpus (by topic
    and pooled) of 4 texts and more, of up to `most` texts; within_author: one split of each author of two texts and more
    (of up to 100,000); between_pair and between_bridge: whole corpora, pooled (model_dir "a|b"). Word frequencies are on
    one reference over all corpora and topics."""
    v = vectors(texts)
    key = ["model_dir", "topic", "text_ord"]
    columns = ["model_dir", "scope", "kind", "rep", "burrows", "cosine"]
    corpora = scoped(texts.select(*key)).where(F.col("scope").isNotNull())
    out = _halved(halves(corpora, reps, seed, ("model_dir", "scope"), most), v, "model_dir", "scope").withColumn("kind", F.lit("within_split")).select(*columns)
    if author:
        own = scoped(texts.select(*key, F.col(author).cast("string").alias("author"))).where(F.col("scope").isNotNull())
        each = _halved(halves(own, 1, seed, ("model_dir", "scope", "author"), 100_000, 2), v, "model_dir", "scope", "author")
        out = out.unionByName(each.select("model_dir", "scope", F.lit("within_author").alias("kind"), F.lit(-1).alias("rep"), "burrows", "cosine"))
    pairs = delta.between(delta.centroids(texts), 12)
    kind = F.when((F.least("model_a", "model_b") == min(bridge)) & (F.greatest("model_a", "model_b") == max(bridge)), "between_bridge").otherwise("between_pair")
    return out.unionByName(pairs.select(F.concat("model_a", F.lit("|"), "model_b").alias("model_dir"), F.lit("pooled").alias("scope"), kind.alias("kind"), F.lit(-1).alias("rep"), "burrows", "cosine"))


def variation(distances: DataFrame) -> DataFrame:
    """By corpus, scope, kind and metric: n, least, quartiles (linear), most, mean and sample deviation (0 for one)."""
    rows = distances.select("model_dir", "scope", "kind", F.expr("stack(2, 'burrows', burrows, 'cosine', cosine) AS (metric, v)"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    table = rows.groupBy("model_dir", "scope", "kind", "metric").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    r = lambda c, n: F.round(c, 5).alias(n)
    return table.select("model_dir", "scope", "kind", "metric", "n", r("min", "min"), *(r(F.col("q")[k], n) for k, n in enumerate(("p25", "median", "p75"))), r("max", "max"), r("mean", "mean"), r("std", "std"))


def author_deltas(texts: DataFrame, author: str, splits: int = 3, most_pairs: int = 300, pool_splits: int = 5, seed: str = "author") -> DataFrame:
    """Chunked deltas (A9) of both halves of each author of 4 texts and more (`splits` times), of pairs of authors
    (`most_pairs` of them by an md5 draw; 0: all) and of both halves of the whole pool: kind, group_a, group_b, split, burrows,
    n_docs_a, n_docs_b. In a half, texts stand in the order of the draw."""
    rows = texts.where(~X.blank(F.col("text"))).select(F.col(author).cast("string").alias("who"), "topic", "model_dir", "text_ord", F.size(X.tokens(F.col("text"))).alias("size"))
    rows = written(rows, "author-sizes")
    name = lambda kind, who, rep, side: F.concat_ws("\u0001", F.lit(kind), who, rep.cast("string"), side.cast("string"))
    key = ["model_dir", "topic", "text_ord"]
    drawn = lambda split, kind, who: split.select(name(kind, who, F.col("rep"), F.col("side")).alias("stream"), F.lit("").alias("part"), F.col("r").cast("long").alias("r"), *key)
    own = drawn(halves(rows, splits, seed, ("who",), 1 << 30), "within_author", F.col("who"))
    pool = drawn(halves(rows.withColumn("all", F.lit("ALL")), pool_splits, f"{seed}-pool", ("all",), 1 << 30), "within_pool", F.col("all"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    drawn_ = own.unionByName(pool).alias("a").join(rows.alias("b"), same).select("a.*", "b.size")
    part_ = F.concat_ws("\u0001", F.coalesce("topic", F.lit("")), "model_dir")  # an author's corpora follow each other within a topic
    whole = rows.select(name("cross_author", F.col("who"), F.lit(-1), F.lit(0)).alias("stream"), part_.alias("part"), F.col("text_ord").alias("r"), *key, "size")
    each = written(drawn_.unionByName(whole), "streams")
    at = offsets(each.select(F.col("stream").alias("model_dir"), F.col("part").alias("topic"), F.col("r").alias("text_ord"), "size"))
    at = at.select(F.col("model_dir").alias("stream"), F.col("topic").alias("part"), F.col("text_ord").alias("r"), "offset", "n")
    places = written(each.join(at, ["stream", "part", "r"]).select("stream", *key, "offset", "n"), "places")
    names = places.groupBy(F.col("stream").alias("model_dir")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda c, k: F.split(c, "\u0001")[k]
    first = names.where(part(F.col("model_dir"), 3) == "0")
    splits_ = first.where(~F.col("model_dir").startswith("cross_author")).select(F.col("model_dir").alias("model_a"), F.regexp_replace("model_dir", "0$", "1").alias("model_b"))
    who = first.where(F.col("model_dir").startswith("cross_author")).select("model_dir")
    cross = who.select(F.col("model_dir").alias("model_a")).join(who.select(F.col("model_dir").alias("model_b")), F.col("model_a") < F.col("model_b"))  # authors are a roster
    if most_pairs:
        cross = cross.orderBy(X.draw(seed, part(F.col("model_a"), 1), part(F.col("model_b"), 1)), "model_a", "model_b").limit(most_pairs)
    found = delta.chunked(texts, pairs=splits_.unionByName(cross), places=places)
    sized = found.join(names.select(F.col("model_dir").alias("model_a"), F.col("n").alias("n_docs_a")), "model_a").join(names.select(F.col("model_dir").alias("model_b"), F.col("n").alias("n_docs_b")), "model_b")
    a, b = F.col("model_a"), F.col("model_b")
    return sized.select(part(a, 0).alias("kind"), part(a, 1).alias("group_a"), part(b, 1).alias("group_b"), part(a, 2).cast("int").alias("split"), F.col("burrows_chunked").alias("burrows"), "n_docs_a", "n_docs_b")


def exclusive_quartiles(values: DataFrame, *by: str) -> DataFrame:
    """Count, least, quartiles at (n + 1) p by rank interpolation (below 4 values: least, median, most), most, mean, population
    deviation. A group is a list of distances, not of texts."""
    listed = values.groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("a"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))

    def at(p: float):
        h = (F.size("a") + 1) * p
        lo = F.greatest(F.lit(1), F.least(F.floor(h), F.size("a") - 1)).cast("int")
        return F.element_at("a", lo) + (h - lo) * (F.element_at("a", lo + 1) - F.element_at("a", lo))

    few = F.size("a") < 4
    middle = (F.element_at("a", F.floor((F.size("a") + 1) / 2).cast("int")) + F.element_at("a", F.ceil((F.size("a") + 1) / 2).cast("int"))) / 2
    quartile = lambda p, low: F.round(F.when(few, low).otherwise(at(p)), 5)
    return listed.select(
        *by, F.size("a").cast("long").alias("n"), F.round(F.array_min("a"), 5).alias("min"), quartile(0.25, F.array_min("a")).alias("p25"), F.round(middle, 5).alias("median"),
        quartile(0.75, F.array_max("a")).alias("p75"), F.round(F.array_max("a"), 5).alias("max"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"),
    )
