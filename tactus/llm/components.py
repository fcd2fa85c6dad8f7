"""Connected components of an edge table by alternating stars, with every step written to the shared folder.

A large star links each node's larger neighbours to its least neighbour; a small star links its smaller ones. Both keep
components whole and shorten paths, so the edges become stars around each component's least node. The driver sees two
numbers a round. Counts go through partial aggregates, so that a hub with most edges is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import removed, scratch, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both(edges)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b always
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) with a the least node of b's component, for every other node b of it; ``edges`` has a < b."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "edges")
    edges = written(edges.distinct(), path)
    state = _state(edges)
    while state[0]:
        old, path = path, scratch(spark, "edges")
        edges = written(_small_star(_large_star(edges)), path)
        removed(spark, old)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
