"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import staged


def _mark(edges: DataFrame) -> tuple:
    """Count and exclusive-or of the hashes of a set of edges: all that the driver sees of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(rows: DataFrame, least: DataFrame) -> DataFrame:
    return rows.join(staged(least), "u")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (columns a, b); root is the smallest node reachable, the node itself included.

    Links may repeat, point either way or join a node to itself; null ends are left out. Each step moves links to
    the smallest neighbour: links with larger nodes first (large star), then those with smaller ones (small star),
    until nothing changes; the rounds grow with the logarithm of the longest path. Minima are taken in each task
    before the shuffle and written, so both sides of a join are plain tables whose hot partitions Spark may split.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = staged(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(u, v).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(_star(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _star(large, least)
        small = joined.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").where("u <> v").distinct())
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select("v").distinct()
    return staged(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))))
