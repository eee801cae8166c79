"""Data-quality checks: one row each, ``check, passed, observed, expected``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .drift import close


def check(df: DataFrame, name: str, observed: Column, expected: Column | int | float | str) -> DataFrame:
    """One aggregate of df against what it should be."""
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    row = df.agg(observed.cast("string").alias("observed"), expected.cast("string").alias("expected"))
    return row.select(F.lit(name).alias("check"), F.col("observed").eqNullSafe(F.col("expected")).alias("passed"), "observed", "expected")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def window_checks(windowed: DataFrame, manifest: DataFrame, features: DataFrame, names: list[str]) -> list[DataFrame]:
    """Rows, ids, sizes and finiteness of the representations, and leakage between splits."""
    bad = reduce(lambda a, c: a + F.count_if(F.col(c).isNotNull() & finite(F.col(c)).isNull()), names, F.lit(0))
    ids = manifest.select("sample_id").join(features.select("sample_id", F.lit(1).alias("there")), "sample_id", "full")
    sizes = windowed.groupBy("sample_id").agg(F.count("*").alias("n"), F.first("window_tx_count").alias("size"), F.max("pos").alias("last"))
    splits = windowed.groupBy("split_group_id").agg(F.count_distinct("split").alias("n"))
    labels = windowed.groupBy("split_group_id").agg(F.count_distinct("traffic_label").alias("n"))
    return [
        check(manifest, "sample ids are unique", F.count_distinct("sample_id"), F.count("*")),
        check(ids, "features and manifest have the same samples", F.count_if(F.col("there").isNull()), 0),
        check(sizes, "windows have the size in the manifest", F.count_if(F.col("n") != F.col("size")), 0),
        check(sizes, "positions are dense", F.count_if(F.col("last") + 1 != F.col("n")), 0),
        check(features, "features are finite or missing", bad, 0),
        check(splits, "no recording is in two splits", F.count_if(F.col("n") > 1), 0),
        check(labels, "no recording has two labels", F.count_if(F.col("n") > 1), 0),
    ]


def sequence_checks(sequences: DataFrame, manifest: DataFrame) -> list[DataFrame]:
    both = sequences.join(manifest.select("sample_id", "window_tx_count"), "sample_id")
    return [check(both, "masks count the transactions", F.count_if(F.size(F.filter("mask", lambda x: x)) != F.col("window_tx_count")), 0)]


def graph_checks(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    bounds = edges.join(nodes.groupBy("sample_id").agg(F.max("node_id").alias("last")), "sample_id", "left")
    outside = (F.least("src", "dst") < 0) | (F.greatest("src", "dst") > F.col("last")) | F.col("last").isNull()
    dense = nodes.groupBy("sample_id").agg((F.max("node_id") + 1).alias("top"), F.count("*").alias("n"))
    return [check(bounds, "edges stay in their graph", F.count_if(outside), 0), check(dense, "node ids are dense", F.count_if(F.col("top") != F.col("n")), 0)]


def reconstruction(recomputed: DataFrame, stored: DataFrame, names: list[str], rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """``sample_id, matches, max_difference`` of features computed again and those stored; a sample in one only does not match."""
    a = recomputed.select("sample_id", F.struct(*names).alias("a"))
    b = stored.select("sample_id", F.struct(*names).alias("b"))
    both = a.join(b, "sample_id", "full")
    equal = reduce(lambda x, c: x & close(F.col(f"a.{c}"), F.col(f"b.{c}"), rtol, atol), names, F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.select("sample_id", equal.alias("matches"), F.array_max(F.array(*(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in names))).alias("max_difference"))
