"""Intervals and summaries over evaluated runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tails import exact_interval
from .metrics import binary_metrics, confusion, error_type

# Repetitions and seed of the published intervals.
REPEATS, SEED = 500, 20260905


def recording_counts(df: DataFrame) -> DataFrame:
    """``split_group_id, label, tn, fp, fn, tp``: all that resampling recordings needs."""
    return df.groupBy("split_group_id").agg(F.min_by("label", "sample_id").alias("label"), *confusion())


def _intervals(counts: np.ndarray, label: np.ndarray, repeats: int, seed: int) -> dict[str, tuple[float, float] | None]:
    rng, sums = np.random.default_rng(seed), np.zeros((repeats, 4))
    classes = [np.flatnonzero(label == c) for c in (0, 1) if (label == c).any()]
    for r in range(repeats):
        for members in classes:
            sums[r] += counts[rng.choice(members, len(members), replace=True)].sum(0)
    tn, fp, fn, tp = sums.T
    with np.errstate(divide="ignore", invalid="ignore"):
        values = {"recall": tp / (tp + fn), "fpr": fp / (fp + tn), "precision": np.where(tp + fp > 0, tp / (tp + fp), 0.0), "f1": np.where(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn), 0.0), "accuracy": (tp + tn) / sums.sum(1)}
    negatives, positives = (label == 0).any(), (label == 1).any()
    allowed = {"recall": positives, "fpr": negatives, **dict.fromkeys(("precision", "f1", "accuracy"), positives and negatives)}
    return {k: tuple(np.quantile(v, (0.025, 0.975))) if allowed[k] and np.isfinite(v).all() else None for k, v in values.items()}


def cluster_bootstrap(df: DataFrame, *, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``metric, low, high``: 95 % intervals from resampling recordings within their class.

    Windows are summed by recording before anything leaves the executors; one grouped task
    then draws with NumPy's generator over recordings in key order, so results are exact
    for a seed.
    """

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("split_group_id")
        found = _intervals(part[["tn", "fp", "fn", "tp"]].to_numpy(float), part["label"].to_numpy(), repeats, seed)
        return pd.DataFrame([(k, *(v or (None, None))) for k, v in found.items()], columns=["metric", "low", "high"]).astype({"low": float, "high": float})

    return recording_counts(df).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(draw, "metric string, low double, high double")


def poisson_bootstrap(df: DataFrame, *, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """As :func:`cluster_bootstrap` for any number of recordings: each draws a Poisson weight by hash in every repetition."""
    u = (F.shiftrightunsigned(F.xxhash64("split_group_id", "rep", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    limits = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1)) or 1) for k in range(12)])
    weight = sum((F.when(u > F.lit(float(x)), 1).otherwise(0) for x in limits), F.lit(0))
    rows = recording_counts(df).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("w", weight)
    sums = rows.groupBy("rep").agg(*(F.sum(F.col(c) * F.col("w")).cast("double").alias(c) for c in ("tn", "fp", "fn", "tp")))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    values = {"recall": F.try_divide(tp, tp + fn), "fpr": F.try_divide(fp, fp + tn), "precision": F.try_divide(tp, tp + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn)}
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in values.items()))).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def exact_intervals(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """``metric, success, denominator, lower_95, upper_95`` of (metric, successes, trials); no trials, no row."""
    return spark.createDataFrame([(m, k, n, *exact_interval(k, n)) for m, k, n in rows if n], "metric string, success long, denominator long, lower_95 double, upper_95 double")


def recording_intervals(df: DataFrame) -> DataFrame:
    """Exact intervals of recall and false-positive rate over recordings."""
    c = df.agg(*confusion()).first()
    return exact_intervals(df.sparkSession, [("recall", c.tp, c.tp + c.fn), ("fpr", c.fp, c.fp + c.tn)])


def seed_stability(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of each metric by model."""
    return runs.groupBy("model").agg(*(f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))


def representative_errors(df: DataFrame, by: list[str]) -> DataFrame:
    """For each kind of error: windows, recordings, and the sample of least id."""
    rows = df.withColumn("error_type", error_type()).where("error_type <> 'correct'")
    return rows.groupBy(*by, "error_type").agg(F.count("*").alias("windows"), F.count_distinct("split_group_id").alias("recordings"), F.min("sample_id").alias("sample_id"))


def compare_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n, max_score_difference, predictions_equal`` of two scorings of the same samples; a sample in one only counts as unequal."""
    x, y = a.select("sample_id", F.col("score").alias("s1"), F.col("prediction").alias("p1")), b.select("sample_id", F.col("score").alias("s2"), F.col("prediction").alias("p2"))
    both = x.join(y, "sample_id", "full")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("s1") - F.col("s2"))).alias("max_score_difference"), F.bool_and(F.coalesce(F.col("p1") == F.col("p2"), F.lit(False))).alias("predictions_equal"))


def split_summary(windowed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows, recordings, windows and windows of each class by split."""
    rows = windowed.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("split_group_id").alias("recordings"))
    wins = manifest.groupBy("split").agg(F.count("*").alias("windows"), F.count_if(F.col("traffic_label") == "benign").alias("benign"), F.count_if(F.col("traffic_label") == "malicious").alias("malicious"))
    return rows.join(wins, "split")


def train_fit(df: DataFrame, threshold: float) -> DataFrame:
    """Metrics of the train split at a frozen threshold."""
    return binary_metrics(df.where("split = 'train'").withColumn("prediction", (F.col("score") >= threshold).cast("int")))
