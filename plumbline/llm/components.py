"""Connected components of an edge table, by alternating large and small stars.

Every round turns towards the smallest node around: neighbours above a node are linked
to the smallest node near it, then neighbours below. Both are a partial aggregation
and a join, so a node with very many neighbours is not gathered. Edges are written to
the shared folder after each round, which cuts the lineage; rounds end when the edges
stay as they are, and each node then hangs on the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.stored import release, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); component is the smallest node."""
    now = settle(_oriented(edges.select("a", "b")), "edges")
    mark = _fingerprint(now)
    while True:
        before, now = now, settle(_small_star(_large_star(now)), "edges")
        release(before)
        after = _fingerprint(now)
        if after == mark:
            break
        mark = after
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select("component", "component")).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return (
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", "m")))


def _fingerprint(edges: DataFrame) -> tuple:
    # 32-bit hashes: their sum over 2^31 edges still fits
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")).first()
    return tuple(row)
