"""Connected components by alternating large-star and small-star steps, and joins that a hot key doesn't skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Keys that a join treats as heavy, at most: as their rows add up to the total, no more can have over total / HEAVY_KEYS rows.
HEAVY_KEYS = 10_000
#: A key with fewer rows is never heavy.
LEAST_HEAVY = 1_000


def skew_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join with ``keyed``, which has a row per key and the column ``n``, the key's number of rows in ``rows``.

    The keys of the most rows, HEAVY_KEYS at most by counting, are broadcast, so that their rows stay where they are.
    """
    limit = max(LEAST_HEAVY, total // HEAVY_KEYS)
    heavy, light = keyed.filter(F.col("n") > limit).drop("n"), keyed.filter(F.col("n") <= limit).drop("n")
    if heavy.isEmpty():
        return rows.join(light, key, how)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))


def _star(directed: DataFrame, keep_centre: bool) -> DataFrame:
    """Each u's neighbours v (and u itself, for a small star) get an edge to the least of them and u."""
    directed = cut(directed, "cc-directed")
    total = directed.count()
    least = cut(directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
    joined = skew_join(directed, least, "u", total)
    if keep_centre:
        out = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = cut(out.filter("a <> b").distinct(), "cc-edges")
    out.loom_used = (directed, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the least node that it reaches. Nodes without edges aren't returned.

    An edge list of any shape converges in a number of steps that grows with the logarithm of its size; each step is a
    partial minimum per node and a join. Loops and repeated edges do no harm.
    """
    edges = cut(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b").distinct(), "cc-edges")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, False)
        downward = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _star(downward, True)
        mark = tuple(small.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        discard(edges, large, *large.loom_used, *small.loom_used)
        edges = small
        if mark == before:
            break
        before = mark
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
