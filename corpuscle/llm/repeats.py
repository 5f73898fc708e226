"""Suffix-array dedup: remove every byte of a long string that also starts elsewhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of context in one suffix array: bounds a task's memory (about 40 times as much).
SHARD_BYTES = 2 << 20
#: Texts whose anchors are sought at once, in bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Bytes of an anchor's gram.
GRAM = 64
_POSITION = 28
#: Starts of one text that are looked at at once: positions stay below 2 ** _POSITION, and memory is bounded.
CHUNK_BYTES = 64 << 20
#: Windows of a run that an anchor opens again and again, at most: bounds a context.
RUN_WINDOWS = 1 << 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- suffix arrays


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes, and each position's rank (the first slot of its group).

    Larsson-Sadakane refinement: sorted by h bytes, a group is sorted by 2h through the ranks h further on; groups
    of one are done and take no part any more. Beyond the end ranks are lowest.
    """
    n = len(text)
    words = words_at(text) if words is None else words
    sa = np.argsort(words, kind="stable").astype(np.int64)
    rank = np.zeros(n + depth + 1, np.int64)

    def number(slots: np.ndarray, positions: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank groups of equal keys by their first slot; the slots of groups of two and more."""
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(slots)))
        rank[positions] = np.repeat(slots[first], sizes) + 1
        return slots[np.repeat(sizes > 1, sizes)]

    active = number(np.arange(n), sa, words[sa])
    h = 8
    while h < depth and len(active):
        step = min(h, depth - h)
        positions = sa[active]
        keys = (rank[positions] << 32) | rank[positions + step]
        order = np.argsort(keys, kind="stable")
        sa[active] = positions = positions[order]
        active = number(active, positions, keys[order])
        h += step
    return sa, rank[:n] - 1


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix in `sa` with the one before it, at most `depth` (0 for the first).

    Kasai's rule (from one position of the text to the next, the prefix shortens by at most one) along lanes of 256
    consecutive positions that advance together; 8 bytes are compared at a time. Suffixes of one rank agree in `depth`
    bytes but stand in no order, so the rule is not applied after one of them.
    """
    n = len(text)
    words = words_at(text) if words is None else words
    words = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    starts = np.arange(0, n, 256)
    have = np.zeros(len(starts), np.int64)
    for step in range(min(256, n)):
        here = starts + step
        if here[-1] >= n:
            starts, have = starts[:-1], have[:-1]
            here = here[:-1]
            if not len(here):
                break
        there = before[here]
        have = np.where((there < 0) | (have >= depth), 0, np.maximum(have - 1, 0))
        have[(there >= 0) & (rank[here] == rank[there])] = depth
        room = np.minimum(depth, n - np.maximum(here, there))
        lanes = np.flatnonzero((there >= 0) & (have < room))
        while len(lanes):
            h = have[lanes]
            differ = words[here[lanes] + h] ^ words[there[lanes] + h]
            same = differ == 0
            last = lanes[~same]
            if len(last):
                whole = _leading_bytes(differ[~same])
                have[last] = np.minimum(have[last] + whole, room[last])
            lanes = lanes[same]
            have[lanes] = np.minimum(have[lanes] + 8, room[lanes])
            lanes = lanes[have[lanes] < room[lanes]]
        lcp[slot[here]] = have
    return lcp


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of each (nonzero) number are zero."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += x < (np.uint64(1) << np.uint64(64 - 8 * k))
    return out


class Shard:
    """Distinct contexts, their suffix array, and which of their windows occur twice or more.

    A context is a string and its number of windows (starts 0 to n - 1); it occurs `weight` times.
    """

    def __init__(self, contexts: list[bytes], counts: list[int], weights: list[int], length: int):
        self.length = length
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.words = words_at(self.text)
        sa, rank = suffix_array(self.text, length, self.words)
        lcp = common_prefixes(self.text, sa, rank, length, self.words)
        weight = np.zeros(len(self.text), np.int64)
        for b, n, w in zip(self.base, counts, weights, strict=False):
            weight[b : b + n] = w
        # A run of suffixes with long common prefixes is one string; only windows inside a context count.
        run = np.cumsum(lcp < length) - 1
        total = np.bincount(run, weights=weight[sa]).astype(np.int64)
        self.repeated = np.zeros(len(self.text), bool)
        self.repeated[sa] = (total[run] >= 2) & (weight[sa] > 0)
        # One suffix for each string that is a window here: what another shard is searched for.
        real = np.flatnonzero(weight[sa] > 0)
        self.heads = sa[real[np.unique(run[real], return_index=True)[1]]]
        self.sa_run, self.sa, self.weighted = run, sa, weight > 0
        self.words = np.concatenate([self.words, np.zeros(length + 8, np.uint64)])

    def _order(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how windows at `mine` compare to the other's at `theirs`."""
        out, open_ = np.zeros(len(mine), np.int64), np.arange(len(mine))
        for h in [*range(0, self.length - 7, 8), self.length - 8]:
            a, b = self.words[mine[open_] + h], other.words[theirs[open_] + h]
            out[open_] = (a > b).astype(np.int64) - (a < b)
            open_ = open_[a == b]
            if not len(open_):
                break
        return out

    def merge(self, other: Shard) -> None:
        """Mark the windows that both shards hold, by binary search of each string of this one in the other's order."""
        if not len(self.heads) or not len(other.heads):
            return
        lo, hi = np.zeros(len(self.heads), np.int64), np.full(len(self.heads), len(other.heads))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            above = self._order(self.heads[open_], other, other.heads[mid]) > 0
            lo[open_[above]] = mid[above] + 1
            hi[open_[~above]] = mid[~above]
        inside = np.flatnonzero(lo < len(other.heads))
        met = inside[self._order(self.heads[inside], other, other.heads[lo[inside]]) == 0]
        for shard, heads in ((self, self.heads[met]), (other, other.heads[lo[met]])):
            run_of = np.empty(len(shard.text), np.int64)
            run_of[shard.sa] = shard.sa_run
            hit = np.zeros(shard.sa_run[-1] + 1, bool)
            hit[run_of[heads]] = True
            shard.repeated |= hit[run_of] & shard.weighted

    def runs(self, context: int, count: int) -> list[tuple[int, int]]:
        """Runs (first, last + 1) of repeated windows of one context."""
        return _runs(self.repeated[self.base[context] : self.base[context] + count])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


# ---------------------------------------------------------------- anchors


def anchors(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: its first start, number of starts, the anchor's hash, and at how many places
    the run has it.

    text: texts one after the other; ends: where each ends. A window is `length` bytes of one text; its anchor is the
    leftmost of its grams with the smallest hash. Equal windows have equal anchors at equal distance, so whatever
    repeats meets by the anchor's hash; each window lies in exactly one run.
    """
    n = len(text) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    h = (text.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    size = 1
    while size < GRAM:
        h = h[: len(h) - size] * (_M2 + np.uint64(2 * size)) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    keys = (h & np.uint64((1 << 64) - (1 << _POSITION))) | np.arange(len(h), dtype=np.uint64)
    width, grams = 1, length - GRAM + 1
    while width * 2 <= grams:
        keys = np.minimum(keys[: len(keys) - width], keys[width:])
        width *= 2
    if width < grams:
        keys = np.minimum(keys[: len(keys) - (grams - width)], keys[grams - width :])
    spot = (keys & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    own = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + length <= ends[np.minimum(own, len(ends) - 1)]
    new = np.ones(n, bool)
    new[1:] = (spot[1:] != spot[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    told = h[spot[first]].view(np.int64)
    if not len(first):
        return none, none, none, none
    # Where a gram comes again and again, as in a ruler or padding, neighbouring runs have one anchor: they are one run.
    apart = np.ones(len(first), bool)
    apart[1:] = (first[1:] != stop[:-1] + 1) | (told[1:] != told[:-1]) | (own[first[1:]] != own[first[:-1]]) | (first[1:] // RUN_WINDOWS != first[:-1] // RUN_WINDOWS)
    at = np.flatnonzero(apart)
    size = np.diff(np.append(at, len(first)))
    return first[at], stop[at + size - 1] - first[at] + 1, told[at], size


# ---------------------------------------------------------------- the operator

_CUT = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h", T.LongType())]))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(ks: list, parts: list[bytes], shift: int = 0) -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            first, count, h, places = anchors(np.frombuffer(b"".join(parts), np.uint8), ends, length)
            own = np.searchsorted(ends, first, side="right")
            lo = first - np.concatenate([[0], ends])[own] + shift
            k = np.array(ks, np.int64).reshape(-1, 3)[own]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[:, 0], k[:, 1], lo, count, h, k[:, 2], places)], ["k1", "k2", "lo", "n", "h", "m", "places"])

        for batch in batches:
            ks, parts, held = [], [], 0
            for k1, k2, text, m in zip(*batch.columns, strict=True):
                text, k = text.as_py(), (k1.as_py(), k2.as_py(), m.as_py())
                if len(text) < length:
                    continue
                if held and held + len(text) > BATCH_BYTES:
                    yield found(ks, parts)
                    ks, parts, held = [], [], 0
                if len(text) > CHUNK_BYTES:  # each window lies in one chunk; a run that a chunk's end cuts is two
                    for at in range(0, len(text) - length + 1, CHUNK_BYTES):
                        yield found([k], [text[at : at + CHUNK_BYTES + length - 1]], at)
                    continue
                ks.append(k)
                parts.append(text)
                held += len(text)
            if parts:
                yield found(ks, parts)

    return texts.mapInArrow(run, "k1 long, k2 long, lo long, n long, h long, m long, places long")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Each candidate run of windows as a row with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k1, k2, text, m, cuts in zip(*batch.columns, strict=True):
                text, k = text.as_py(), (k1.as_py(), k2.as_py(), m.as_py())
                for cut in cuts.as_py() or []:
                    lo, n = cut["lo"], cut["n"]
                    rows.append((cut["h"], *k, lo, n, text[lo : lo + n + length - 1]))
                    held += n + length
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], ["h", "k1", "k2", "m", "lo", "n", "context"])

    return texts.mapInArrow(run, "h long, k1 long, k2 long, m long, lo long, n long, context binary")


def _repeated(contexts: DataFrame, length: int) -> DataFrame:
    """Byte ranges (k1, k2, s, e) that repeated windows cover, from contexts that come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        block: dict[bytes, list] = {}
        held, anchor, earlier = 0, None, []

        def whole(k: tuple, lo: int, n: int) -> None:
            out.append((*k, lo, lo + n + length - 1))

        def close() -> tuple[Shard, list]:
            entries = [(c, v) for c, v in block.items()]
            shard = Shard([c for c, _ in entries], [v[0] for _, v in entries], [v[1] for _, v in entries], length)
            return shard, [(k, v) for k, (_, v) in enumerate(entries)]

        def tell(shard: Shard, entries: list) -> None:
            for k, (n, weight, place) in entries:
                if weight < 2 and place:
                    for a, b in shard.runs(k, n):
                        out.append((*place[0], place[1] + a, place[1] + b - 1 + length))

        def flush() -> None:
            """All shards since the last anchor that was complete: merged with each other where an anchor fills several."""
            nonlocal earlier, held
            if block:
                earlier.append(close())
                block.clear()
            for i, (shard, _) in enumerate(earlier):
                for other, _ in earlier[:i]:
                    shard.merge(other)
            for shard, entries in earlier:
                tell(shard, entries)
            earlier, held = [], 0

        for batch in batches:
            for h, k1, k2, m, lo, n, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != anchor:
                    if held >= SHARD_BYTES or earlier:
                        flush()
                    anchor = h
                elif held >= SHARD_BYTES:  # one anchor fills more than a shard
                    earlier.append(close())
                    block.clear()
                    held = 0
                k = (k1, k2)
                entry = block.get(context)
                if entry is None:
                    block[context] = [n, m, (k, lo) if m < 2 else None]
                    held += len(context)
                    continue
                entry[1] += m
                if entry[2]:  # the first of several: all its windows are repeated
                    whole(entry[2][0], entry[2][1], n)
                    entry[2] = None
                if m < 2:
                    whole(k, lo, n)
            if len(out) > 50_000:
                yield _ranges(out)
                out = []
        flush()
        if out:
            yield _ranges(out)

    def _ranges(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["k1", "k2", "s", "e"])

    return contexts.mapInArrow(run, "k1 long, k2 long, s long, e long")


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """What is left of each text: `k1`, `k2`, `n_bytes`, `n_removed`, `spans`, `kept_sha256`."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, hashes = [], [], [], []
            for text, m, ranges in zip(*batch.columns[2:], strict=True):
                text, m = text.as_py(), m.as_py()
                if m > 1:
                    merged = [[0, len(text)]] if len(text) >= length else []
                else:
                    merged = []
                    for r in sorted((r["s"], r["e"]) for r in ranges.as_py() or []):
                        if merged and r[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r[1])
                        else:
                            merged.append([*r])
                kept, at = hashlib.sha256(), 0
                for s, e in merged:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                sizes.append(len(text))
                removed.append(sum(e - s for s, e in merged))
                spans.append([{"start": s, "end": e} for s, e in merged])
                hashes.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array(hashes, pa.string())], ["k1", "k2", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return texts.mapInArrow(run, "k1 long, k2 long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """One row per input row: `key`, `n_bytes` (UTF-8), `n_removed`, `spans` (maximal removed ranges of bytes), `kept_sha256`.

    Removed is each byte covered by a string of `length` bytes (GRAM or more) that starts at another place too, in any
    document, the same one included.

    1. Equal texts become one with a count (before the shuffle as well), by 128 bits of hash.
    2. Runs of windows with one anchor (a content-defined gram, the same wherever the window occurs) are told by the
       anchor's hash. Anchors that occur once cannot repeat and go no further.
    3. The other runs' bytes are shuffled by anchor. A task packs them into shards of bounded size: suffix array by
       Larsson-Sadakane refinement, common prefixes by Kasai's rule. An anchor with more than a shard's worth of
       different contexts fills several shards, which are merged by binary search.
    4. Ranges return to their texts. The texts' exchange is one and the same in steps 2 to 4.

    A null or empty text, or one shorter than `length`, loses nothing. Repeated rows are copies of each other. Null
    keys and extra columns don't matter. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), body.alias("text")).select("key", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(0x5EED), "text").alias("k2"))
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m")).select("k1", "k2", "text", "m")
    spots = _anchors(texts, length)
    often = spots.groupBy("h").agg((F.sum(F.col("m") * F.col("places")) > 1).alias("often")).where("often").select("h")
    often = often.repartition("h")  # an exchange of its own: then a hot anchor's rows are split among tasks in the join
    cuts = spots.join(often, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "h")).alias("cuts"))
    contexts = _contexts(texts.join(cuts, ["k1", "k2"]).select("k1", "k2", "text", "m", "cuts"), length)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _repeated(contexts.repartition(parts, "h").sortWithinPartitions("h"), length)
    listed = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    left = _kept(texts.join(listed, ["k1", "k2"], "left").select("k1", "k2", "text", "m", "ranges"), length)
    return rows.select("key", "k1", "k2").join(left, ["k1", "k2"]).select(F.col("key").alias(key), "n_bytes", "n_removed", "spans", "kept_sha256")
