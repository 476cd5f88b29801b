"""Connected components by alternating large-star and small-star passes over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import lookup, staged


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest of each ``u`` and its partners ``v``."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Join each node's larger partners to its smallest one. ``n`` edges have at most 2n nodes."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (lookup(both.filter("v > u"), _nearest(both), 2 * n, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Join each node and its smaller partners to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    joined = lookup(down, near, n, "u", "inner")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a checksum that does not depend on their order."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, component): the smallest node that each node with an edge can reach, other than itself.

    ``edges`` has the columns u and v. Nodes that are the smallest of their component are not listed. The passes end when
    they change nothing, after about the logarithm of the longest path; each is staged, so no lineage builds up.
    """
    now = staged(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        larger = staged(_large_star(now, seen[0]), "larger")
        now = staged(_small_star(larger, seen[0]), "edges")
        after = _print(now)
        if after == seen:
            break
        seen = after
    return now.select("u", F.col("v").alias("component"))
