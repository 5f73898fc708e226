"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _state(edges: DataFrame) -> tuple:
    """Row count and checksum: equal exactly when a step changed nothing (to 64 bits)."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node that has an edge.

    edges: columns `u`, `v` (long), in any order and number; loops are ignored. Returns `node`, `root`, one row per node
    with an edge to another node; the root itself is among them.

    Each step rewires neighbours to the smallest neighbour, so the number of steps grows with the logarithm of the
    longest path. Only minima per node are grouped (partial aggregation runs before the shuffle), and each step's
    edges are written to the shared folder. Nulls are ignored; an empty list gives an empty result.
    """
    tidy = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = written(tidy, "edges")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
            now.select(F.col("v").alias("a"), F.col("u").alias("b"))
        )
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = written(small, "edges")
        drop_written(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
