"""Connected components by alternating star operations (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    rest = down.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` to ``(node, root)`` for every node with an edge but the roots themselves.

    Only edges are kept, never lists of a component's members. Each round writes its
    edges to the shared folder, and the last one is found by count and checksum.
    """
    edges = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before, k = None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, k = now, k + 1
        edges = scratch.cut(_small(_large(edges).distinct()).distinct(), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
