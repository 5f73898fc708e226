"""Approximate nearest neighbours by cosine: an inverted multi-index over two halves of the vector."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, written

#: Vectors that the quantisers are fitted on, at most: those with the smallest hash of their values.
SAMPLE = 20_000
#: Vectors of the sample whose true neighbours tell how much of the index a query must visit.
PROBES = 500
#: Entries and queries that one group ranks at once: cells are packed into blocks of about so many entries, and a larger
#: cell is spread over several blocks.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 20_000
#: Centroids of a half, at most; the counts of all cells (its square) are held by every task.
MOST_CENTROIDS = 1024


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    value = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return value & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return centroids


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[a : a + 8192], centroids).argmin(1) for a in range(0, len(x), 8192)])


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.sqrt((x**2).sum(1, keepdims=True))


@dataclass
class MultiIndex:
    """Centroids of both halves and the number of entries of each cell (pair of centroids)."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def traverse(self, query: np.ndarray, wanted: int) -> list[int]:
        """Cells by the sum of both halves' distances, nearest first, until they hold `wanted` entries; empty ones are left out.

        A heap holds the frontier of pairs in the two sorted lists of centroids.
        """
        a, b = (_squared(q[None], c)[0] for q, c in ((query[: self.half], self.first), (query[self.half :], self.second)))
        ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
        da, db, k = a[ia], b[ib], len(self.second)
        heap, found, have = [(da[0] + db[0], 0, 0)], [], 0
        while heap and have < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(ia[i] * k + ib[j])
            if self.counts[cell]:
                found.append(cell)
                have += int(self.counts[cell])
            if j + 1 < k:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return found


def needed_share(index: MultiIndex, x: np.ndarray, k: int, target: float) -> float:
    """The share of the entries that a query must visit to meet `target` of its k true neighbours, measured on the sample x.

    For PROBES of the sample's vectors, each true neighbour within the sample needs all entries of cells nearer than its own
    to be visited. Among all entries neighbours are nearer still, so the share errs on the safe side.
    """
    if len(x) < 2:
        return 1.0
    one, two = _nearest(x[:, : index.half], index.first), _nearest(x[:, index.half :], index.second)
    needed = []
    for at in range(0, min(PROBES, len(x)), 32):  # a few probes at once: the driver holds only their distances
        probes = x[at : min(at + 32, PROBES)]
        near = probes @ x.T
        near[np.arange(len(probes)), at + np.arange(len(probes))] = -np.inf
        true = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        far = _squared(probes[:, : index.half], index.first)[:, one] + _squared(probes[:, index.half :], index.second)[:, two]
        needed += [np.searchsorted(np.sort(row), row[t], side="right") / len(x) for row, t in zip(far, true, strict=True)]
    return float(np.quantile(np.concatenate(needed), target))


def build_index(entries: DataFrame, seed: int = 11, k: int = 5, target: float = 0.95) -> tuple[MultiIndex, DataFrame, float]:
    """Fit the quantisers on at most SAMPLE distinct vectors and index every entry.

    entries: `vector`, `ids`. Returns the index, the entries with their `cell`, written to the shared folder, and the share
    of them to visit for a recall of `target`. The number of centroids of a half is the number of entries to the power
    0.45, so that a cell holds ever more, if slowly.
    """
    n = entries.count()
    sample = entries.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    size = int(np.clip(round(n**0.45), 1, min(MOST_CENTROIDS, len(sample))))
    x = _unit(sample.vector)
    half, rng = x.shape[1] // 2, np.random.default_rng(seed)
    index = MultiIndex(_kmeans(x[:, :half], size, rng), _kmeans(x[:, half:], size, rng), np.zeros(size * size, np.int64))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=index.cells(_unit(batch.vector)))

    schema = T.StructType([*entries.schema.fields, T.StructField("cell", T.IntegerType())])
    placed = written(entries.mapInPandas(assign, schema), "index")
    for row in placed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared rows
        index.counts[row.cell] = row["count"]
    return index, placed, needed_share(index, x, k, target)


def nearest(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    target: float = 0.95,
    share: float | None = None,
    least: int = 300,
    seed: int = 11,
) -> DataFrame:
    """The `k` nearest rows found for each row that meets `queries`: `query_id`, `rank` (from 1), `key`, `score`.

    score is the cosine of the original vectors in double precision; ties go to the smaller key; a row is never its own
    neighbour. Equal vectors are one entry of the index with their k + 1 smallest keys (no more can be among k
    neighbours), so a vector that many rows share is searched, and searched for, once. A query visits cells, nearest first,
    until they hold the share of all entries that a recall of `target` takes, as measured when the index is fitted (or
    `share`, if given), `least` at least; every entry visited is ranked exactly. The share is large for vectors without
    structure and small for clustered ones. Entries and queries meet by blocks of cells of bounded size, however many
    share a cell or ask.

    Rows whose vector is null, empty, zero, or has null or non-finite components take no part. Vectors are compared with
    those of their own length; each length has an index of its own (lengths are few: the driver lists them). Repeated
    keys count once. Fewer rows than k: all of them. Extra columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    kind = vectors.schema[key].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    for r in rows.groupBy(F.size("vector").alias("d")).agg(F.max("asks").alias("asked")).orderBy("d").collect():
        if r.asked:
            out = out.unionByName(_nearest_alike(rows.where(F.size("vector") == r.d), key, kind, k, target, share, least, seed))
    return out


def _nearest_alike(rows: DataFrame, key: str, kind: str, k: int, target: float, share: float | None, least: int, seed: int) -> DataFrame:
    """`nearest` among usable rows (id, vector, asks) of one length."""
    rows = written(rows, "vectors")
    ranked = rows.select("id", "vector").distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    entries = ranked.where(F.col("r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index, placed, needed = build_index(written(entries, "entries"), seed, k, target)
    wanted = max(least, int(np.ceil((needed if share is None else share) * index.counts.sum())))
    # Cells in order of their number fill blocks; part of a cell's entries may go to each block that it reaches into.
    ends = np.cumsum(index.counts)
    first, last = (ends - index.counts) // BLOCK_ROWS, np.maximum(ends - 1, 0) // BLOCK_ROWS
    asked = written(rows.where("asks").select("vector", "id").distinct().withColumn("q", F.xxhash64("vector")), "queries")
    probes = asked.select("q", "vector").dropDuplicates(["q", "vector"])
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query to each block that holds cells it visits, with those cells."""
        for batch in batches:
            for q, v, unit in zip(batch.q, batch.vector, _unit(batch.vector) if len(batch) else [], strict=True):
                cells = np.sort(np.array(index.traverse(unit, wanted), np.int64))
                blocks: dict[int, list[int]] = {}
                for c in cells:
                    for b in range(first[c], last[c] + 1):
                        blocks.setdefault(b, []).append(c)
                yield pd.DataFrame({"block": list(blocks), "grp": q % groups, "q": q, "vector": [v] * len(blocks), "cells": list(blocks.values())})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell = batch.cell.to_numpy()
                yield batch.assign(block=first[cell] + batch.h.to_numpy() % (last[cell] - first[cell] + 1))

    spread = placed.withColumn("h", F.pmod(F.xxhash64("vector"), F.lit(1 << 20)).cast("int")).mapInPandas(place, f"vector array<double>, ids array<{kind}>, cell int, h int, block int")
    spread = spread.drop("h").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    routed = dealt(probes, "q").mapInPandas(route, "block int, grp int, q long, vector array<double>, cells array<int>")

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest entries of the visited cells, by each query; near ties are kept for the exact measure."""
        rows = []
        if len(asked) and len(held):
            e, unit = np.stack(held.vector.to_numpy()), _unit(held.vector)
            lengths, ids = np.sqrt((e**2).sum(1)), held.ids.to_numpy()
            own, local = np.unique(held.cell.to_numpy(), return_inverse=True)
            place = max(0, len(e) - k - 1)
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                visited = np.stack([np.isin(own, c) for c in part.cells])[:, local]
                near = np.where(visited, _unit(part.vector) @ unit.T, -np.inf)
                least = np.partition(near, place, axis=1)[:, place] - 1e-9
                for row, q, v, bound in zip(near, part.q, part.vector, least, strict=True):
                    pick = np.flatnonzero((row >= bound) & (row > -np.inf))
                    # The exact measure, computed alike for every pair, so that equal vectors tie.
                    exact = (e[pick] * v).sum(1) / (lengths[pick] * np.sqrt((np.asarray(v) ** 2).sum()))
                    rows += [(q, v, ids[p], s) for p, s in zip(pick, exact, strict=True)]
        return pd.DataFrame(rows, columns=["q", "vector", "ids", "score"])

    found = routed.groupBy("block", "grp").cogroup(spread.groupBy("block", "grp")).applyInPandas(rank, f"q long, vector array<double>, ids array<{kind}>, score double")
    each = found.select("q", "vector", F.explode("ids").alias("n"), "score")
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("q", "vector").orderBy(F.desc("score"), "n"))).where(F.col("r") <= k + 1)
    best = asked.join(top.drop("r"), ["q", "vector"]).where(F.col("id") != F.col("n"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "n"))).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("query_id"), "rank", F.col("n").alias(key), "score")
