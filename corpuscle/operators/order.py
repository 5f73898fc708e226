"""Places in the stream of a corpus' tokens, and which texts take part: rosters, eras, first N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..sources.readers import written

#: Texts whose sizes are added up before corpora are ordered: only one row for so many is ordered in one place.
BUCKET = 4096
#: Estimated bytes of a row of offsets, and of what is broadcast at most.
OFFSET_BYTES, BROADCAST_BYTES = 96, 48 << 20


def offsets(sizes: DataFrame, size: str = "size") -> DataFrame:
    """(model_dir, topic, text_ord, offset, n): tokens of the corpus before each text, in order of topic and text, and all.

    Sums by range of text_ord are ordered first, then the texts of each range, so no task orders a whole corpus' texts.
    """
    bucket = F.floor(F.col("text_ord") / BUCKET)
    rows = sizes.withColumn("bucket", bucket)
    sums = rows.groupBy("model_dir", "topic", "bucket").agg(F.sum(size).alias("held"))
    own = Window.partitionBy("model_dir")
    before = F.sum("held").over(own.orderBy("topic", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("model_dir", "topic", "bucket", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(own).alias("n"))
    inner = Window.partitionBy("model_dir", "topic", "bucket").orderBy("text_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    same = rows.model_dir.eqNullSafe(sums.model_dir) & rows.topic.eqNullSafe(sums.topic) & rows.bucket.eqNullSafe(sums.bucket)
    return rows.join(sums, same).select(rows.model_dir, rows.topic, "text_ord", (F.col("before") + F.col("inside")).alias("offset"), "n")


def _placed(texts: DataFrame) -> DataFrame:
    """Texts with the place of their first token in the corpus' stream and its tokens: model_dir, topic, text, offset, n."""
    sizes = written(texts.select("model_dir", "topic", "text_ord", F.size(X.tokens(F.col("text"))).alias("size")), "sizes")
    at = written(offsets(sizes).select(F.col("model_dir").alias("m"), F.col("topic").alias("t"), F.col("text_ord").alias("o"), "offset", "n"), "offsets")
    if at.count() * OFFSET_BYTES <= BROADCAST_BYTES:
        at = F.broadcast(at)  # texts stay where they are; beyond this size both sides are shuffled
    same = F.col("model_dir").eqNullSafe(F.col("m")) & F.col("topic").eqNullSafe(F.col("t")) & F.col("text_ord").eqNullSafe(F.col("o"))
    return texts.select("model_dir", "topic", "text_ord", "text").join(at, same).select("model_dir", "topic", "text", "offset", "n")


def stream(texts: DataFrame) -> DataFrame:
    """One row per token with its place in the corpus' stream: model_dir, topic, token, i (from 0), n (tokens of the corpus)."""
    rows = _placed(texts).select("model_dir", "topic", "n", "offset", F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"))
    return rows.select("model_dir", "topic", "token", (F.col("offset") + F.col("pos")).alias("i"), "n")


def sliced(texts: DataFrame, stretch: int, before: int) -> DataFrame:
    """The corpus' stream in stretches of so many tokens, each with the `before` tokens that precede it: model_dir, stretch, n
    (tokens of the corpus), and a row for each text in it: lo (place of the first of its tokens there, from 0), words (joined by spaces)."""
    rows = _placed(texts).select("model_dir", "n", "offset", X.tokens(F.col("text")).alias("w"))
    rows = rows.select("*", (F.col("offset") + F.size("w")).alias("end")).where(F.col("end") > F.col("offset"))
    last = F.floor(F.least(F.col("end") - 1 + before, F.col("n") - 1) / stretch)
    rows = rows.select("*", F.explode_outer(F.sequence(F.floor(F.col("offset") / stretch), last)).alias("stretch"))
    lo, hi = F.greatest("offset", F.col("stretch") * stretch - before), F.least("end", (F.col("stretch") + 1) * stretch)
    rows = rows.select("model_dir", "n", "stretch", lo.alias("lo"), hi.alias("hi"), "offset", "w")
    return rows.select("model_dir", "stretch", "n", "lo", F.concat_ws(" ", F.slice("w", (F.col("lo") - F.col("offset") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))).alias("words"))


def streams(texts: DataFrame, places: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """One row per token and stream that its text takes part in: model_dir (the stream), token, i, n.

    places: a written table (stream, model_dir, topic, text_ord, offset, n), a few rows per text. A text is tokenised once for
    all its streams, and is neither copied nor moved while the places fit a broadcast. among: a short list of the tokens to keep;
    their places and n are those of the whole streams.
    """
    at = places.groupBy("model_dir", "topic", "text_ord").agg(F.collect_list(F.struct("stream", "offset", "n")).alias("places"))
    at = at.select(F.col("model_dir").alias("m"), F.col("topic").alias("t"), F.col("text_ord").alias("o"), "places")
    if places.count() * OFFSET_BYTES <= BROADCAST_BYTES:
        at = F.broadcast(at)
    same = F.col("model_dir").eqNullSafe(F.col("m")) & F.col("topic").eqNullSafe(F.col("t")) & F.col("text_ord").eqNullSafe(F.col("o"))
    rows = texts.select("model_dir", "topic", "text_ord", X.tokens(F.col("text")).alias("w")).join(at, same)
    if among is None:
        rows = rows.select("w", F.explode("places").alias("p")).select("p", F.posexplode("w").alias("pos", "token"))
    else:
        rows = rows.select("places", F.posexplode("w").alias("pos", "token")).join(F.broadcast(among), "token").select("pos", "token", F.explode("places").alias("p"))
    rows = rows.select(F.col("p.stream").alias("model_dir"), F.col("p.offset").alias("offset"), F.col("p.n").alias("n"), "pos", "token")
    return rows.select("model_dir", "token", (F.col("offset") + F.col("pos")).alias("i"), "n")


def era(model: Column, eras: dict[str, list[str]] = fixed.ERAS) -> Column:
    """the era of a corpus, "other" if it is in none."""
    out = F.lit("other")
    for name, members in eras.items():
        out = F.when(model.isin(members), name).otherwise(out)
    return out


def pair_class(era_a: Column, era_b: Column) -> Column:
    """a bridge on either side first, then both 2023, both 2026, else cross."""
    return (
        F.when((era_a == "bridge") | (era_b == "bridge"), "bridge").when((era_a == "2023") & (era_b == "2023"), "both_2023")
        .when((era_a == "2026") & (era_b == "2026"), "both_2026").otherwise("cross")
    )


def in_roster(table: DataFrame, roster: list[str], exclude: tuple[str, ...] = (), column: str = "model_dir") -> DataFrame:
    """Rows whose corpus is in the roster and not excluded, with `ord`, its place there. A roster is a short list."""
    names = table.sparkSession.createDataFrame([(n, k) for k, n in enumerate(roster) if n not in exclude] or [], "__name string, ord int")
    return table.join(F.broadcast(names), F.col(column) == F.col("__name")).drop("__name")


def first_n(texts: DataFrame, n: int) -> DataFrame:
    """The first `n` texts of each corpus and topic that aren't blank."""
    order = Window.partitionBy("model_dir", "topic").orderBy("text_ord")
    return texts.where(~X.blank(F.col("text"))).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def looked_up(wanted: DataFrame, distances: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """`distance` of each wanted pair, given in either order; null where there is none."""
    key = lambda d: d.withColumn("__lo", F.least("model_a", "model_b")).withColumn("__hi", F.greatest("model_a", "model_b"))
    d = key(distances).select(*on, "__lo", "__hi", "distance")
    return key(wanted).join(d, [*on, "__lo", "__hi"], "left").drop("__lo", "__hi")


def strided(n: Column, context: int, stride: int) -> Column:
    """Windows (begin, end, scored) over n tokens: at most `context` long, `stride` apart, each token scored once; none
    for fewer than two tokens. n is read for each window: a column, not a computation."""
    count = F.when(n <= context, 1).otherwise(F.ceil((n - context) / stride) + 1)
    starts = F.when(n >= 2, F.sequence(F.lit(0), (count - 1).cast("int")))
    end = lambda k: F.least(k * stride + context, n)
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda k: F.struct((k * stride).cast("long").alias("begin"), end(k).cast("long").alias("end"), (end(k) - F.when(k > 0, end(k - 1)).otherwise(0)).cast("long").alias("scored")))
