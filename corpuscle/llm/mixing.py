"""Mixing sources to target weights: hierarchical budgets and seeded epochs, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
#: Parts of an epoch's order: only the part where the budget ends has to be sorted.
PARTS = 1024
#: Leaves that are broadcast at most (some 200 bytes each); more are joined by a shuffle.
BROADCAST_LEAVES = 100_000


def token_count(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The default domain of a source: a stable share of sources each, by CRC-32 of the name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % domains).cast("string"))


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    given = F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.element_at(given, F.col(column)), F.lit(1.0))


def _fill(nodes: DataFrame, parent: list[str], name: str, weights: Mapping[str, float]) -> DataFrame:
    """Divide each parent's budget `given` among its nodes by weight, no node above its `capacity`.

    A node's shortage goes to its siblings by their weights. With siblings in order of capacity over weight, the
    water level is the largest of (budget - capacities before) / (weights from here on).
    """
    nodes = nodes.withColumn("w", F.greatest(_weight(name, weights), F.lit(1e-9)))
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("w"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy(*parent))
    return nodes.withColumn("level", (F.col("given") - before) / rest).withColumn("given", F.least(F.col("capacity"), F.greatest(F.lit(0.0), F.col("w") * level))).drop("w", "level")


def budgets(leaves: DataFrame, budget: float, epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The token budget `given` of each leaf (domain, lang, source, tokens).

    From the root down, each node's budget is divided among its children, none of which gets more than `epochs` times
    its tokens. Since a child's capacity is that of its whole subtree, a shortage is first made up by siblings, and
    only what they cannot take reaches the siblings of an ancestor.
    """
    leaf = leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domain = lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = _fill(domain.withColumn("given", F.lit(float(budget))).withColumn("root", F.lit(0)), ["root"], "domain", weights.get("domain", {}))
    mid = _fill(lang.join(top.select("domain", "given"), "domain"), ["domain"], "lang", weights.get("lang", {}))
    return _fill(leaf.join(mid.select("domain", "lang", "given"), ["domain", "lang"]), ["domain", "lang"], "source", weights.get("source", {})).drop("capacity")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    budget: float | None = None,
    epochs: int = 4,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    domain: Column | None = None,
) -> DataFrame:
    """How often each row is used: `key`, `domain`, `lang`, `source`, `n_tokens`, `copies` (1 or more; rows not used are left out).

    budget: tokens in all (default: as many as `docs` has). weights: for each level, name to weight (default 1). A
    leaf whose budget holds its tokens q times gives all its rows q times, and of epoch q as many rows of a seeded order
    as fit: the prefix whose running sum of tokens stays within the rest. The order is by md5 of seed, epoch and key,
    so every epoch has its own.

    Only narrow rows are shuffled. An epoch's order is cut into PARTS by hash; sums per part tell where the budget ends,
    and only that part is sorted: no leaf, however large, has its rows in one task.

    Null names count as "" and a null text has no tokens; a null key is ordered as "". Repeated rows are used as
    often as they come, each on its own; ties in the order go to the smaller key, then fewer tokens. An empty table gives no rows.
    """
    origin = F.coalesce(F.col(source).cast("string"), F.lit(""))
    named = docs.select(
        F.col(key).alias("key"), (domain_of(origin) if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), origin.alias("source"), token_count(F.col(text)).alias("n_tokens"),
    )
    rows = written(named, "mix-rows")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    plan = budgets(leaves, float(total.t or 0) if budget is None else budget, epochs, weights)
    full = F.floor(F.col("given") / F.greatest("tokens", F.lit(1)) + 1e-9)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, full).otherwise(F.lit(1)).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("given") - F.col("full") * F.col("tokens")) + 1e-6).cast("long"))
    plan = written(plan.select(*LEVELS, "full", "rest"), "mix-plan")
    small = F.broadcast if total.n <= BROADCAST_LEAVES else lambda x: x
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.join(small(plan), list(LEVELS)).withColumn("h", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"))
    placed = placed.withColumn("part", F.floor(F.col("h") / ((1 << 32) // PARTS)).cast("int"))
    sums = placed.groupBy(*LEVELS, "rest", "part").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("part"))
    # The first part that doesn't fit whole, and the tokens of those before it.
    ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("part", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    ends = written(ends.select(*LEVELS, F.col("end.part").alias("end_part"), F.col("end.before").alias("before")), "mix-ends")
    placed = placed.join(small(ends), list(LEVELS), "left")
    sure = placed.withColumn("extra", F.when(F.col("end_part").isNull() | (F.col("part") < F.col("end_part")), 1).otherwise(0))
    whole = sure.where(F.col("end_part").isNull() | (F.col("part") != F.col("end_part")))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("h", "key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    cut = sure.where(F.col("part") == F.col("end_part")).withColumn("extra", F.when(F.col("before") + run <= F.col("rest"), 1).otherwise(0))
    used = whole.unionByName(cut).withColumn("copies", F.col("full") + F.when(F.col("full") >= epochs, 0).otherwise(F.col("extra")))
    return used.where(F.col("copies") > 0).select(F.col("key").alias(key), *LEVELS, "n_tokens", "copies")
