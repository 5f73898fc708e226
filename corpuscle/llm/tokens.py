"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only where an edit reaches."""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-token pattern that public byte-level BPE vocabularies of 50k entries use.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf of the tree, about; a leaf of twice as many is split.
LEAF = 64
#: Distinct pre-tokens whose counts a worker remembers.
CACHE = 200_000

EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())])


class Counter:
    """Pre-tokens of a text and the number of tokens of each, for one vocabulary of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """(code points, tokens) of each pre-token in order."""
        known = self.known.get
        return [(len(p), known(p) or self.count(p)) for p in self.split.findall(text)]

    def whole(self, text: str) -> int:
        return sum(n for _, n in self.pieces(text))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per worker: the vocabulary is read once. Where the path isn't there, the file of that name which was added to the
    session (SparkContext.addFile) is taken."""
    try:
        return Counter(path)
    except FileNotFoundError:
        return Counter(SparkFiles.get(os.path.basename(path)))


class Tree:
    """A document's pre-tokens in leaves, with the sums of code points and tokens of every subtree."""

    def __init__(self, pieces: list[tuple[int, int]]):
        self._plant([pieces[a : a + LEAF] for a in range(0, len(pieces), LEAF)] or [[]])

    def _plant(self, leaves: list[list[tuple[int, int]]]) -> None:
        size = 1
        while size < len(leaves):
            size *= 2
        self.size, self.leaves = size, leaves
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for k, leaf in enumerate(leaves):
            self.chars[size + k], self.tokens[size + k] = sum(c for c, _ in leaf), sum(t for _, t in leaf)
        for k in range(size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def stored(cls, sizes: list[int], chars: list[int], tokens: list[int]) -> Tree:
        """The tree that `flat` tells of; its sums are added up again."""
        tree, ends = cls([]), list(accumulate(sizes, initial=0))
        pieces = list(zip(chars, tokens, strict=True))
        tree._plant([pieces[a:b] for a, b in zip(ends, ends[1:])] or [[]])
        return tree

    def flat(self) -> tuple[list[int], list[int], list[int]]:
        """Pre-tokens of each leaf; code points and tokens of each pre-token."""
        return [len(x) for x in self.leaves], [c for x in self.leaves for c, _ in x], [t for x in self.leaves for _, t in x]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last one for the end), and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and node + 1 < 2 * self.size and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), begin

    def replace(self, first: int, last: int, pieces: list[tuple[int, int]]) -> None:
        """Put `pieces` in the place of the leaves first to last."""
        count = last - first + 1
        new = [pieces[a : a + LEAF] for a in range(0, len(pieces), LEAF)]
        if len(pieces) <= 2 * LEAF and count == 1:
            new = [pieces]
        if len(new) <= count:  # the shape stays; only sums on the paths from changed leaves to the root change
            new += [[]] * (count - len(new))
            for k, leaf in enumerate(new):
                self._set(first + k, leaf)
        else:
            self._plant([x for x in [*self.leaves[:first], *new, *self.leaves[last + 1 :]] if x] or [[]])

    def _set(self, k: int, leaf: list[tuple[int, int]]) -> None:
        self.leaves[k] = leaf
        node = self.size + k
        self.chars[node], self.tokens[node] = sum(c for c, _ in leaf), sum(t for _, t in leaf)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, counter: Counter, text: str, start: int, length: int, put: str) -> tuple[str, int]:
        """Apply one edit: the new text, and how many code points were encoded again.

        Scanning is memoryless: from a pre-token boundary on, the pre-tokens depend only on what follows, and a
        pre-token depends on itself and one code point more. So scanning starts a pre-token before the one that the edit or
        the code point before it lies in, and stops at the first boundary after the edit that was one before.
        """
        start = min(max(start, 0), len(text))
        end = min(start + max(length, 0), len(text))
        shift = len(put) - (end - start)
        after = text[:start] + put + text[end:]
        lead, begin = self.leaf_at(max(start - 1, 0))
        bounds = list(accumulate((c for c, _ in self.leaves[lead]), initial=begin))
        keep = max(0, bisect_right(bounds, max(start - 1, 0)) - 2)
        while keep == 0 and lead > 0:  # the boundary context reaches into the leaf before
            lead -= 1
            if self.leaves[lead]:
                begin -= sum(c for c, _ in self.leaves[lead])
                bounds = list(accumulate((c for c, _ in self.leaves[lead]), initial=begin))
                keep = len(self.leaves[lead]) - 1
        at = bounds[keep]
        last, origin = self.leaf_at(end)
        old = list(accumulate((c for c, _ in self.leaves[last]), initial=origin))
        pieces, scanned = self.leaves[lead][:keep], 0
        rest: list[tuple[int, int]] = []
        while True:
            if at - shift >= end and at >= start + len(put):
                while at - shift > old[-1] or (at - shift == old[-1] and last + 1 < len(self.leaves)):
                    if last + 1 >= len(self.leaves):
                        break
                    last += 1
                    old = list(accumulate((c for c, _ in self.leaves[last]), initial=old[-1]))
                spot = bisect_right(old, at - shift) - 1
                if old[spot] == at - shift:
                    rest = self.leaves[last][spot:]
                    break
            found = counter.split.match(after, at)
            if not found:
                break
            pieces.append((found.end() - at, counter.count(found[0])))
            scanned += found.end() - at
            at = found.end()
        self.replace(lead, last, pieces + rest)
        return after, scanned


def attach_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """`docs` with the column `edits`: each document's rows (start, length, text) of the table `edits`, in their order."""
    listed = edits.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(order, "start", "length", "text"))).alias("__e"))
    each = F.transform("__e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["text"].alias("text")))
    return docs.join(listed.select("__key", each.alias("edits")), F.col(key) == F.col("__key"), "left").drop("__key")


COUNTS = ["n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]
STORED = ["leaf_sizes", "piece_chars", "piece_tokens"]


def _follow(encoder: Counter, tree: Tree, now: str, edits: list | None) -> tuple[str, tuple[int, ...]]:
    """The text after `edits`, which the tree follows, and COUNTS."""
    before, encoded, made = tree.total, 0, 0
    for e in edits or []:
        if e:
            now, scanned = tree.edit(encoder, now, e["start"] or 0, e["length"] or 0, e["text"] or "")
            encoded, made = encoded + scanned, made + 1
    return now, (before, made, tree.total, len(now), encoded)


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]


def _tree_fields() -> list[T.StructField]:
    return [T.StructField("text", T.StringType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in STORED)]


_TREE_TYPES = [pa.string(), *[pa.list_(pa.int32())] * len(STORED)]


def plant_trees(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The trees of documents, to be kept as a table: `key`, text, leaf_sizes, piece_chars, piece_tokens, n_tokens.

    A null text is empty, and so is its tree; null keys and repeated rows each have a tree; other columns are ignored.
    """
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([source.schema.fields[0], *_tree_fields(), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(vocabulary)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                now = value.as_py() or ""
                tree = Tree(encoder.pieces(now))
                rows.append((now, *tree.flat(), tree.total))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, [*_TREE_TYPES, pa.int64()])], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("__key", key)


def edit_trees(trees: DataFrame, vocabulary: str, edits: Column, key: str = "doc_id") -> DataFrame:
    """Trees of `plant_trees`, or of an earlier call, after a batch of edits: the same columns, n_tokens being the new count,
    and n_edits, n_tokens_before and n_chars_encoded. Written, it is the next batch's table. Edits are as `count_tokens`
    takes them (`attach_edits` brings a table of them). Nothing but the edits' surroundings is encoded; a tree without
    edits comes back as it is.
    """
    source = trees.select(F.col(key).alias("__key"), "text", *STORED, edits.cast(T.ArrayType(EDIT)).alias("__edits"))
    more = ["n_tokens", "n_edits", "n_tokens_before", "n_chars_encoded"]
    schema = T.StructType([source.schema.fields[0], *_tree_fields(), *(T.StructField(n, T.LongType()) for n in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(vocabulary)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                now, *held, todo = (batch.column(c)[k].as_py() for c in range(1, batch.num_columns))
                tree = Tree.stored(*held)
                now, (before, made, after, _, encoded) = _follow(encoder, tree, now, todo)
                rows.append((now, *tree.flat(), after, made, before, encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, [*_TREE_TYPES, *[pa.int64()] * len(more)])], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("__key", key)


def count_tokens(docs: DataFrame, vocabulary: str, edits: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts before and after edits: one row per input row, `key`, `n_tokens`, `n_edits`, `n_tokens_edited`,
    `n_chars_edited` and `n_chars_encoded` (code points that the edits made the operator encode again).

    edits: an array of (start, length, text): `length` code points from `start` (clipped to the text) give way to
    `text`; each sees the result of the ones before. Null edits and null members change nothing, a null `text` inserts
    nothing, negative numbers count as 0. A null text is empty. Repeated rows each come back; other columns are ignored.
    No shuffle: `plant_trees` and `edit_trees` in one pass, the trees living in their rows' turns.
    """
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), edits.cast(T.ArrayType(EDIT)).alias("__edits"))
    schema = T.StructType([source.schema.fields[0], *(T.StructField(n, T.LongType()) for n in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(vocabulary)
        for batch in batches:
            rows = []
            for value, todo in zip(batch.column(1), batch.column(2), strict=True):
                now = value.as_py() or ""
                rows.append(_follow(encoder, Tree(encoder.pieces(now)), now, todo.as_py())[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, [pa.int64()] * len(COUNTS))], ["__key", *COUNTS])

    return source.mapInArrow(run, schema).withColumnRenamed("__key", key)
