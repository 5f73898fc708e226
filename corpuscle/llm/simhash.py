"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, written
from .components import components

BITS = 64
#: Hashes whose bits are counted at once: bounds memory for a very long text.
_CHUNK = 8192


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: bit b is 1 if over half of its shingles' XXH64 have it set.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than `shingle` is one shingle;
    a text without words (null and empty too) has fingerprint 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    hash64 = partial(xxhash.xxh64_intdigest, seed=seed)
    runs = zip(*(words[k:] for k in range(size)), strict=False)
    hashes = np.fromiter(map(hash64, map(b" ".join, runs)), np.uint64, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row and `fp`, its fingerprint as a signed long. No shuffle."""
    source = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], [*keep, "fp"])

    return source.mapInArrow(run, schema)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _array(values: list[int]) -> str:
    return "array(" + ",".join(f"{_signed(v)}L" if _signed(v) > -(1 << 63) else "shiftleft(1L, 63)" for v in values) + ")"


def _views(radius: int, half: int) -> list[int]:
    """Masks whose blocks cover all bits; ignoring some one block leaves at most 2 * half of `radius` differing bits.

    With an even radius the whole word is the only view. With an odd one, one differing bit is too many for two
    half-radius balls: the block that holds it is ignored in one of three views.
    """
    if radius == 2 * half:
        return [(1 << BITS) - 1]
    edges = [0, 21, 42, 64]
    return [((1 << BITS) - 1) ^ ((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]


def _ball(column: str, view: int, half: int) -> str:
    """SQL for all variants of the column's bits in `view` that differ in at most `half` of them."""
    flips = [0]
    for _ in range(half):
        flips = list(dict.fromkeys(f ^ (1 << b) if b is not None else f for f in flips for b in [None, *(b for b in range(BITS) if view >> b & 1 and not f >> b & 1)]))
    masked = column if view == (1 << BITS) - 1 else f"({column} & {_signed(view)}L)"
    return f"transform({_array(flips)}, m -> {masked} ^ m)"


def near_duplicate_classes(signatures: DataFrame, radius: int = 3) -> DataFrame:
    """The class of each distinct fingerprint: `fp`, `root_fp` (the least fingerprint reachable).

    signatures: a column `fp`. Fingerprints link at `radius` (0 to 3) or fewer differing bits; classes are the connected
    components. Equal fingerprints are one entry from the start, so copies never meet each other.

    1. Every fingerprint emits all variants within half the radius (rounded down). Two that share a variant differ in at
       most twice that, so a variant's group, which holds at most 65 fingerprints, is linked as a star: no pairs.
    2. For an odd radius, pairs at exactly the radius share such a variant only if one differing bit is ignored. So the
       same is done on three views that each ignore a third of the bits. There a shared variant is only a candidate:
       groups whose members are already in one class are dropped, the others' pairs are verified bit by bit.
    """
    fps = signatures.where(F.col("fp").isNotNull()).select("fp").distinct()
    half = radius // 2
    star = dealt(fps, "fp").select("fp", F.explode(F.expr(_ball("fp", (1 << BITS) - 1, half))).alias("variant"))
    star = star.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where("fp != low")
    first = written(components(star.select(F.col("fp").alias("u"), F.col("low").alias("v"))), "classes")
    classes = fps.join(first, fps.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("root_fp"))
    views = [v for v in _views(radius, half) if v != (1 << BITS) - 1]
    if not views:
        return classes
    tagged = "flatten(array(" + ",".join(f"transform({_ball('fp', v, half)}, x -> struct({k} AS view, x AS variant))" for k, v in enumerate(views)) + "))"
    seen = dealt(classes, "fp").select("fp", "root_fp", F.explode(F.expr(tagged)).alias("at")).select("fp", "root_fp", "at.view", "at.variant")
    over = Window.partitionBy("view", "variant")
    mixed = seen.withColumn("lo", F.min("root_fp").over(over)).withColumn("hi", F.max("root_fp").over(over)).where("lo != hi").drop("lo", "hi")
    mixed = written(mixed, "candidates")
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = (
        a.join(b, (F.col("a.view") == F.col("b.view")) & (F.col("a.variant") == F.col("b.variant")) & (F.col("a.root_fp") < F.col("b.root_fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
        .select(F.col("a.root_fp").alias("u"), F.col("b.root_fp").alias("v"))
    )
    second = components(pairs)
    return classes.join(second, classes.root_fp == second.node, "left").select("fp", F.coalesce("root", "root_fp").alias("root_fp"))


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: `key`, `fp` (signed long), `fingerprint` (16 hex digits), `component_id`.

    component_id is the smallest key reachable over links of at most `radius` differing bits, the document's own
    included. Null, empty and blank texts have fingerprint 0 and link like any other. A repeated row comes back as
    often as it came; a null key is never a component_id unless its class has no other. Extra columns are ignored. An
    empty table gives no rows.
    """
    signed = written(fingerprints(docs, text, shingle, seed, (key,)), "fingerprints")
    classes = near_duplicate_classes(signed, radius)
    least = signed.groupBy("fp").agg(F.min(key).alias("low"))
    by_class = written(classes.join(least, "fp").select("fp", "root_fp", "low"), "class-members")
    lowest = by_class.groupBy("root_fp").agg(F.min("low").alias("component_id"))
    return (
        signed.join(by_class.join(lowest, "root_fp").select("fp", "component_id"), "fp")
        .select(key, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def class_decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """What becomes of each document, told by `key` and `text_hash` (XXH64 of its text): `n` rows, `kept`.

    One document of each class of near duplicates is kept: that with the smallest key, among equal keys that with the
    least hash; a null key comes after all others. A class is told by its fingerprints, not by a key: several may have the
    same key or none. Repeated rows of a document are one entry with n > 1. Extra columns are ignored; an empty table
    gives no rows.
    """
    named = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = fingerprints(named, "text", shingle, seed, ("key", "text_hash")).groupBy("key", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    signed = written(signed, "fingerprints")
    least = signed.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("low"))
    by_class = written(near_duplicate_classes(signed, radius).join(least, "fp"), "class-members")
    lowest = by_class.groupBy("root_fp").agg(F.min("low").alias("best"))
    best = by_class.join(lowest, "root_fp").select("fp", "best")
    kept = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("text_hash") == F.col("best.text_hash"))
    return signed.join(best, "fp").select(F.col("key").alias(key), "text_hash", "n", kept.alias("kept"))
