"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: What stands between words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A block of windows above this many bytes (as estimated) is split, and each part is broadcast in a pass of its own.
BROADCAST_BYTES = 48 << 20
#: Estimated bytes of a broadcast window besides its words.
_WINDOW_BYTES = 160


def words_of(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows: `win` (array of words) and `items` (sorted distinct item ids as strings that hold it).

    An item with fewer words than `window`, but not none, is one window.
    """
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(window), F.lit(0))
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(1), last + 1)).alias("start"))
    return starts.groupBy(F.expr(f"slice(words, start, {window})").alias("win")).agg(F.collect_set("item").alias("items"))


def _key(words: str, at: Column, size: int) -> Column:
    """64-bit key of the shingle of `size` words that begins at 0-based `at`."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(size)))


def _positions(words: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word of each text, with the keys of the shingles that begin there, and one more (pos = n).

    The generator stays in the same generated loop as what follows, so `words` is never copied for a position.
    """
    rows = words.select("*", F.posexplode_outer(F.array_append("words", F.lit(""))).alias("pos", "word")).drop("word")
    if len(sizes) == 1:
        return rows.withColumn("key", _key("words", F.col("pos"), sizes[0]))
    keys = F.array(*(_key("words", F.col("pos"), k) for k in sizes))
    return rows.withColumn("key", F.explode_outer(keys))


def _prefixes(words: DataFrame, windows: DataFrame, shingle: int, sizes: list[int], blocks: int) -> DataFrame:
    """Each window with its rarest shingle: `key`, `off` (its place in the window), `win`, `items`.

    A window occurs only where all its shingles do, so with exact containment a prefix of one shingle is enough.
    Rarity is the shingle's number of occurrences in all documents (ties: the earlier place).
    """
    count = F.size("win")
    size = F.least(count, F.lit(shingle))
    spots = windows.select("win", "items", F.explode(F.sequence(F.lit(0), count - size)).alias("off"))
    by_size = F.lit(None).cast("long")
    for k in sizes:
        by_size = F.when(F.least(F.size("win"), F.lit(shingle)) == k, _key("win", F.col("off"), k)).otherwise(by_size)
    spots = spots.withColumn("key", by_size)
    wanted = written(spots.select("key").distinct(), "shingle-keys")
    texts = _positions(words.select("words"), sizes).select("key")
    counted = [
        texts.join(F.broadcast(wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        for k in range(blocks)
    ]
    spots = spots.join(reduce(DataFrame.unionByName, counted), "key", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "key")).alias("best")
    return spots.groupBy("win").agg(best, F.first("items").alias("items")).select(F.col("best.key").alias("key"), F.col("best.off").alias("off"), "win", "items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 3,
    share: float = 0.05,
) -> DataFrame:
    """Where documents hold benchmark windows. One row per input row: `key`, `n_words`, `n_hit` (words inside any
    occurrence of a window), `items` (sorted ids, as strings, of items with occurring windows), `contaminated`
    (n_hit > 0 and n_hit >= share * n_words), `whole_window` (a window of full length occurs: `window` words in a row are
    an item's) and `text_hash` (XXH64 of the text).

    The documents are read twice. The first pass counts the benchmark's shingles over all of them; the second looks up
    only each window's rarest shingle (the prefix), drops places where the window cannot fit (length and positional
    bounds) and compares the words. Windows are broadcast in blocks of checked size, so a larger benchmark costs more
    passes, not more memory. Only verified occurrences and one row per document are shuffled.

    Nulls: a null text has no words; a null item or item text holds no window (a null item id counts for n_hit, not for
    items); a null key is a key like any other. Repeated rows each come back; rows with one key and different texts
    are kept apart by their text's 64-bit hash. Columns of other names are ignored, whatever they are called. An empty
    benchmark hits nothing, an empty table gives no rows.
    """
    windows = written(benchmark_windows(benchmark, item, item_text, window), "windows")
    stats = windows.agg(
        F.collect_set(F.least(F.size("win"), F.lit(shingle))).alias("sizes"),
        F.sum(F.octet_length(F.array_join("win", " ")) + 8 * F.size("win") + 16 * F.size("items") + _WINDOW_BYTES).alias("bytes"),
    ).first()
    sizes = sorted(stats.sizes) or [shingle]
    blocks = max(1, -(-(stats.bytes or 0) // BROADCAST_BYTES))
    source = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), words_of(F.col(text)).alias("words"))
    prefixes = written(_prefixes(source, windows, shingle, sizes, blocks), "prefixes")

    n = F.size("words")
    places = _positions(source, sizes)
    start = F.col("pos") - F.col("off")
    found = []
    for k in range(blocks):
        part = prefixes.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k).withColumnRenamed("key", "wkey")
        if k == 0:  # the row after the last word meets this one: each document is there at least once
            part = part.unionByName(prefixes.sparkSession.range(1).select(F.lit(-1).alias("off"), F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("wkey")))
        at = F.when(F.col("pos") == n, F.lit(0).cast("long")).otherwise(F.col("key"))
        joined = places.withColumn("key", at).join(F.broadcast(part), F.col("key") == F.col("wkey"))
        ends = (F.col("pos") == n) & F.col("win").isNull()
        fits = (F.col("pos") < n) & (start >= 0) & (start + F.size("win") <= n)
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("win"), F.lit(0))) == F.col("win")
        found.append(joined.where(ends | (fits & same)).select("__key", "__hash", n.cast("long").alias("n_words"), F.when(~ends, F.struct(start.alias("s"), (start + F.size("win")).alias("e"))).alias("run"), "items", F.when(ends, F.lit(1)).alias("copy")))
    per_text = (
        reduce(DataFrame.unionByName, found)
        .groupBy("__key", "__hash", "n_words")
        .agg(F.sort_array(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("copy").alias("copies"))
    )
    # Runs come in order of their start: a word counts once, from the end of what is covered already.
    covered = F.expr(
        "aggregate(runs, named_struct('upto', 0, 'hit', 0L), (acc, r) -> named_struct("
        "'upto', greatest(acc.upto, r.e), 'hit', acc.hit + greatest(0, r.e - greatest(acc.upto, r.s))), acc -> acc.hit)"
    )
    # An extra marker per shingle size would count a text more than once.
    copies = F.expr(f"explode(sequence(1L, copies div {len(sizes)}))")
    whole = F.exists("runs", lambda r: r["e"] - r["s"] >= window)
    out = per_text.select("__key", "__hash", "n_words", covered.alias("n_hit"), "items", whole.alias("whole_window"), copies.alias("__copy"))
    # A share that binary fractions only come near must not cost a document that is exactly at it.
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") + 1e-9 * F.col("n_words") >= F.lit(share) * F.col("n_words"))
    return out.select(F.col("__key").alias(key), "n_words", "n_hit", "items", hit.alias("contaminated"), "whole_window", F.col("__hash").alias("text_hash"))
