"""Differences between groups: shifts of medians, Kolmogorov-Smirnov, Mann-Whitney, Cliff's delta, Holm."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..functions.tails import normal_tail
from .prefix import percentiles_by, running_sums

# Sizes of Cliff's delta, from below.
MAGNITUDES = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium"), (math.inf, "large")]


def unpivoted(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys, feature, value`` with finite values only."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("value")) for c in names)))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.feature", "p.value").where("value IS NOT NULL")


def group_medians(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys, feature, value``: medians by recording and the like, one row a feature."""
    return unpivoted(df.groupBy(*keys).agg(*(F.percentile(finite(F.col(c)), F.lit(0.5)).alias(c) for c in names)), keys, names)


def shift(reference: DataFrame, held_out: DataFrame, by: list[str]) -> DataFrame:
    """``label, feature, *by, shift``: (median of held-out - median of reference) / reference's inter-quartile range.

    Both sides are tables of :func:`group_medians` with ``label``; NULL where the range is
    next to nothing. Only equal labels are compared.
    """
    ref = percentiles_by(reference, ["label", "feature"], "value", [0.25, 0.5, 0.75]).select("label", "feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    out = percentiles_by(held_out, ["label", "feature", *by], "value", [0.5]).select("label", "feature", *by, "n", F.col("q")[0].alias("median"))
    return out.join(ref, ["label", "feature"]).withColumn("shift", F.when(F.col("iqr") > 1e-12, (F.col("median") - F.col("center")) / F.col("iqr")))


def ks_statistic(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n1, n2, ks``: the largest gap of two empirical distributions; ``second`` (boolean) tells the samples apart.

    Equal values are summed first, and the running counts are taken within ``keys``, range by range.
    """
    per = values.groupBy(*keys, "value").agg(F.count_if(~F.col("second")).alias("a"), F.count_if("second").alias("b"))
    gaps = running_sums(per, "value", ["a", "b"], keys=keys).select(*keys, F.col("a_upto").alias("a"), F.col("b_upto").alias("b"), F.col("a_all").alias("n1"), F.col("b_all").alias("n2"))
    return gaps.groupBy(*keys).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.abs(F.col("a") / F.col("n1") - F.col("b") / F.col("n2")))).alias("ks"))


def mann_whitney(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n1, n2, u, ties``: U of the rows with ``second`` from mid-ranks; ties is the sum of t^3 - t."""
    per = values.groupBy(*keys, "value").agg(F.count_if("second").alias("b"), F.count("*").alias("n"))
    rank = F.col("n_upto") - (F.col("n") - 1) / 2.0
    t = F.col("n").cast("double")
    sums = running_sums(per, "value", ["n"], keys=keys).withColumn("rank", rank).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("b")).alias("r"), F.sum("b").alias("n2"), (F.sum("n") - F.sum("b")).alias("n1"), F.sum(t * t * t - t).alias("ties"))
    return sums.select(*keys, "n1", "n2", (F.col("r") - F.col("n2") * (F.col("n2") + 1) / 2.0).alias("u"), "ties")


def cliffs_delta(mwu: DataFrame) -> DataFrame:
    """Adds ``delta`` = 2U/(n1 n2) - 1 and its ``magnitude``."""
    delta = F.when((F.col("n1") > 0) & (F.col("n2") > 0), 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1)
    size = None
    for limit, name in MAGNITUDES:
        fits = F.abs(F.col("delta")) < limit
        size = F.when(fits, name) if size is None else size.when(fits, name)
    return mwu.withColumn("delta", delta).withColumn("magnitude", size)


def p_values(mwu: DataFrame) -> DataFrame:
    """Adds ``p_value``: two-sided, by the normal approximation with ties and continuity correction."""
    tail = F.udf(lambda z: None if z is None else normal_tail(z), "double")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(spread > 0, F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / spread)
    return mwu.withColumn("p_value", F.coalesce(tail(z), F.lit(1.0)))


def holm(df: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """Adds ``holm_p``: step-down adjustment within a family of tests."""
    whole = Window.partitionBy(*(by or []))
    order = whole.orderBy(p, "feature")
    step = F.least(F.lit(1.0), F.col(p) * (F.count(F.lit(1)).over(whole) - F.row_number().over(order) + 1))
    return df.withColumn("_s", step).withColumn("holm_p", F.max("_s").over(order)).drop("_s")


def feature_core(tests: DataFrame, alpha: float = 0.05, delta: float = 0.147) -> DataFrame:
    """Features with a significant and non-negligible difference."""
    return tests.where((F.col("holm_p") < alpha) & (F.abs(F.col("delta")) >= delta)).select("feature").distinct()


def envelope(reference: DataFrame, errors: DataFrame, names: list[str]) -> DataFrame:
    """``feature, n, above, below``: shares of the errors' values outside the range of the reference's."""
    bounds = unpivoted(reference, [], names).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    out = unpivoted(errors, [], names).join(bounds, "feature")
    return out.groupBy("feature").agg(F.count("*").alias("n"), F.avg((F.col("value") > F.col("high")).cast("double")).alias("above"), F.avg((F.col("value") < F.col("low")).cast("double")).alias("below"))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    """Whether two numbers agree; two missing ones do."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
