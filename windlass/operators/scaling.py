"""Robust scalers, fitted on the train split alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .prefix import exact_percentiles
from .windows import is_large, recording_order, time_ranges

# Channels of a transaction in their order; the inter-arrival time comes from neighbouring rows.
CHANNELS = [
    "query_name_len", "subdomain_len", "num_labels", "max_label_len", "query_entropy", "longest_subdomain_entropy", "long_consonant_string_count", "request_len", "request_payload_len", "response_len", "response_payload_len",
    "total_transaction_bytes", "req_resp_time_diff", "interarrival_time", "is_response_missing",
]
ENTROPIES = ("query_entropy", "longest_subdomain_entropy")
LEAST_IQR = 1e-12


def channel_rule(name: str) -> str:
    return "robust" if name in ENTROPIES else "identity_clip_0_1" if name == "is_response_missing" else "log1p_robust"


def feature_rule(name: str) -> str:
    """By suffix first: a ratio of entropies is clipped. A name that ends in ``jaro_winkler_mean`` has no such suffix."""
    if name.endswith(("_ratio", "_share", "jaro_winkler")):
        return "identity_clip_0_1"
    return "robust" if "entropy" in name else "log1p_robust"


def transformed(x: Column, rule: str) -> Column:
    x = finite(x)
    if rule == "identity_clip_0_1":
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))) if rule == "log1p_robust" else x


def recording_iat(rows: DataFrame, *, large: bool | None = None) -> DataFrame:
    """Adds ``interarrival_time``: the gap to the row before in the whole recording, NULL if negative or not finite.

    Where a recording is too ``large`` for a task (None: see windows.is_large), gaps are taken
    within ranges of time, and a range's first row follows the last time of the range before.
    """
    ts = finite(F.col("request_timestamp"))
    if is_large(rows, "split_group_id") if large is None else large:
        rows = time_ranges(rows, ts)
        per = rows.groupBy(F.col("split_group_id").alias("_g"), F.col("_p").alias("_q")).agg(F.max("_t").alias("_last"))
        per = per.withColumn("_before", F.lag("_last").over(Window.partitionBy("_g").orderBy("_q")))
        rows = rows.join(per, F.col("split_group_id").eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
        inside = F.lag("_t").over(Window.partitionBy("split_group_id", "_p").orderBy(F.col("_t").asc_nulls_last(), "ingest_seq"))
        gap = F.col("_t") - F.coalesce(inside, F.col("_before"))
        return rows.withColumn("interarrival_time", F.when(gap >= 0, gap)).drop("_t", "_p", "_g", "_q", "_last", "_before")
    gap = ts - F.lag(ts).over(Window.partitionBy("split_group_id").orderBy(*recording_order()))
    return rows.withColumn("interarrival_time", F.when(gap >= 0, gap))


def fit(df: DataFrame, rules: dict[str, str]) -> list[dict]:
    """Scaler rows ``feature, transformation, center, iqr``.

    Exact quartiles of the transformed finite values; without any, center 0 and iqr 1; an
    iqr of next to nothing is 1. Clipped features are not scaled.
    """
    scaled = {k: r for k, r in rules.items() if r != "identity_clip_0_1"}
    row = exact_percentiles(df, {k: transformed(F.col(k), r) for k, r in scaled.items()}, [0.25, 0.5, 0.75])
    out = []
    for name, rule in rules.items():
        q = (row[name] if name in scaled else None) or [0.0, 0.0, 1.0]
        iqr = q[2] - q[0] if name in scaled else 1.0
        out.append({"feature": name, "transformation": rule, "center": float(q[1]), "iqr": float(iqr) if iqr > LEAST_IQR else 1.0})
    return out


def fit_channels(canonical: DataFrame, split: str = "train") -> list[dict]:
    """From all transactions of the split, in windows or not; gaps cross window borders."""
    return fit(recording_iat(canonical.where(F.col("split") == split)), {c: channel_rule(c) for c in CHANNELS})


def fit_features(features: DataFrame, names: list[str], split: str = "train") -> list[dict]:
    return fit(features.where(F.col("split") == split), {f: feature_rule(f) for f in names})


def scaled(x: Column, row: dict) -> Column:
    """The scaled value as a float; what is missing becomes 0."""
    z = transformed(x, row["transformation"])
    if row["transformation"] != "identity_clip_0_1":
        z = (z - F.lit(row["center"])) / F.lit(row["iqr"])
    return F.coalesce(finite(z), F.lit(0.0)).cast("float")


def apply(df: DataFrame, scaler: list[dict]) -> DataFrame:
    """Every feature of the scaler replaced by its scaled value, in one projection."""
    return df.withColumns({r["feature"]: scaled(F.col(r["feature"]), r) for r in scaler})


def scaler_table(spark: SparkSession, scaler: list[dict], split: str = "train") -> DataFrame:
    return spark.createDataFrame([(r["feature"], r["transformation"], r["center"], r["iqr"], split) for r in scaler], "feature string, transformation string, center double, iqr double, fit_partition string")
