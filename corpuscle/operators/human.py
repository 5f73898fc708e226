"""Human reference sets: usable posts, keyword topics, thresholds, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def usable(author: Column, body: Column, ident: Column, forum: Column) -> Column:
    """A post of the forum (or of none), not deleted, not a bot's, with an id."""
    gone = lambda c: c.isNull() | c.isin(fixed.DELETED)
    return F.coalesce(F.lower(forum), F.lit("")).isin("changemyview", "") & ~gone(author) & ~gone(body) & ~author.isin(fixed.BOTS) & ~F.coalesce(ident, F.lit("")).isin("")


def word_window(text: Column, least: int = fixed.MIN_WORDS, most: int = fixed.MAX_WORDS) -> Column:
    """P4."""
    return X.word_count(text).between(least, most)


def keyword_hits(docs: DataFrame, keywords: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, topic, keyword) for each keyword that the lower-cased text contains. Keywords are a fixed, short list."""
    listed = F.array(*(F.struct(F.lit(t).alias("topic"), F.lit(k).alias("keyword")) for t, ks in keywords.items() for k in ks))
    # One lower-cased text per row, however many keywords: a lambda's variable is computed once.
    found = F.transform(F.array(F.lower(X.text_of(F.col(text)))), lambda low: F.filter(listed, lambda k: F.contains(low, k["keyword"])))
    hits = docs.select(key, F.explode(F.flatten(found)).alias("k"))
    return hits.select(key, "k.topic", "k.keyword")


def topic_counts(hits: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Documents per keyword, those without any included."""
    spark = hits.sparkSession
    listed = F.array(*(F.struct(F.lit(t).alias("topic"), F.lit(k).alias("keyword")) for t, ks in keywords.items() for k in ks))
    every = spark.range(1).select(F.explode(listed).alias("k")).select("k.topic", "k.keyword")
    n = hits.groupBy("topic", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["topic", "keyword"], "left").select("topic", "keyword", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def topic_overlap(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that two topics share. A document is in few topics, so pairs are made within its set of topics."""
    sets = hits.groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("t"))
    pairs = sets.select(F.posexplode("t").alias("i", "topic_a"), "t").select("topic_a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("topic_b"))
    return pairs.groupBy("topic_a", "topic_b").agg(F.count(F.lit(1)).cast("long").alias("n"))


def thresholds(docs: DataFrame, by: str, text: str = "text", steps: tuple[int, ...] = (50, 100, 200, 400)) -> DataFrame:
    """Documents of at least so many words."""
    rows = docs.select(by, X.word_count(F.col(text)).alias("n"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("n"), *(F.count_if(F.col("n") >= s).cast("long").alias(f"n_{s}") for s in steps))


def quantiles(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Least, linear percentiles and most of words."""
    rows = docs.select(by, X.word_count(F.col(text)).cast("double").alias("n"))
    ps = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    table = rows.groupBy(by).agg(F.percentile("n", F.array(*map(F.lit, ps))).alias("q"))
    return table.select(by, *(F.round(F.col("q")[k], 6).alias(f"q{int(p * 100)}") for k, p in enumerate(ps)))


def dedup_posts(posts: DataFrame, ident: str, author: str, text: str) -> DataFrame:
    """U-4: the first post of each id, then of each author and first 300 characters."""
    first = posts.withColumn("__r", F.row_number().over(Window.partitionBy(ident).orderBy("text_ord"))).where("__r = 1")
    again = Window.partitionBy(author, X.content_hash(F.col(text), 300)).orderBy("text_ord")
    return first.withColumn("__r", F.row_number().over(again)).where("__r = 1").drop("__r")


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K5: content and prefix hashes of each row."""
    return docs.select(key, X.content_hash(X.text_of(F.col(text))).alias("sha256"), X.content_hash(X.text_of(F.col(text)), 300).alias("prefix_sha256"), X.word_count(F.col(text)).alias("n_words"))


def survey(posts: DataFrame, hits: DataFrame, key: str, steps: tuple[int, ...] = (50, 100, 200, 400)) -> DataFrame:
    """By topic: matched posts, those of at least so many words, and among those of 100 words and more: authors, authors
    of two posts and more, and the share with a delta. posts: key, author, delta, text; hits: key, topic."""
    rows = posts.select(key, "author", "delta", X.word_count(F.col("text")).alias("n")).join(hits.select(key, "topic").distinct(), key)
    enough = F.col("n") >= fixed.MIN_WORDS
    counts = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n_any"), *(F.count_if(F.col("n") >= s).alias(f"n_{s}") for s in steps), F.round(F.coalesce(F.avg(F.when(enough, F.col("delta").cast("double"))), F.lit(0.0)), 6).alias("delta_rate"))
    authors = rows.where(enough).groupBy("topic", "author").agg(F.count(F.lit(1)).alias("c")).groupBy("topic").agg(F.count(F.lit(1)).alias("authors"), F.count_if(F.col("c") > 1).alias("repeat_authors"))
    return counts.join(authors, "topic", "left").na.fill(0, ["authors", "repeat_authors"])


def most_common(rows: DataFrame, value: str, k: int, *by: str) -> DataFrame:
    """The k most frequent values (of each group), ties by value; a null counts as "None"."""
    counted = rows.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("None")).alias(value)).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), value)  # only each task's first k reach the window
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def twentieths(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Least, the 5, 25, 50, 75 and 95 % quantiles (exclusive method: at (n + 1) p) and most of words. From a table of
    counts per number of words, so that a group's texts are never listed in one place."""
    rows = docs.select(F.col(by).alias("g"), X.word_count(F.col(text)).alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("g").orderBy("v")
    rows = rows.withColumn("upto", F.sum("c").over(over)).withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))

    def quantile(p: float):
        lo = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * p), F.col("n") - 1))
        return at(lo), at(lo + 1), F.max((F.col("n") + 1) * p - lo)

    ps = {5: 0.05, 25: 0.25, 50: 0.5, 75: 0.75, 95: 0.95}
    parts = {q: quantile(p) for q, p in ps.items()}
    out = rows.groupBy("g").agg(F.max("n").alias("n"), F.min("v").alias("least"), *(c.alias(f"{a}{q}") for q, t in parts.items() for a, c in zip("abt", t, strict=True)), F.max("v").alias("most"))
    return out.select(F.col("g").alias(by), "n", "least", *(F.round(F.when(F.col("n") >= 2, F.col(f"a{q}") + F.col(f"t{q}") * (F.col(f"b{q}") - F.col(f"a{q}"))), 6).alias(f"p{q}") for q in ps), "most")


def snapshot(selected: DataFrame) -> DataFrame:
    """One row, `snapshot`: JSON with rows, posts, and by topic texts, authors and the posts shared with each other topic.
    selected: topic, post, author."""
    per = selected.groupBy("topic").agg(F.count_distinct("post").alias("n_texts"), F.count_distinct("author").alias("n_authors"))
    both = topic_overlap(selected, "post").select(F.concat("topic_a", F.lit("&"), "topic_b").alias("pair"), "n")
    topics = per.agg(F.array_sort(F.collect_list(F.struct("topic", "n_texts", "n_authors"))).alias("per_topic"))  # a row per topic
    shared = both.agg(F.array_sort(F.collect_list(F.struct("pair", "n"))).alias("overlap"))
    whole = selected.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("post").alias("n_posts"))
    return whole.crossJoin(topics).crossJoin(shared).select(F.to_json(F.struct("n_rows", "n_posts", "per_topic", "overlap")).alias("snapshot"))  # one row each


def sampled(rows: DataFrame, n: int, by: str, key: str, seed: str = "sample") -> DataFrame:
    """N rows of each group, those that come first by an md5 draw of the key."""
    order = Window.partitionBy(by).orderBy(X.draw(seed, F.col(key)), key)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
