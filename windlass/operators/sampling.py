"""Weights, balanced samples and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .prefix import exact_percentiles


def recording_weights(df: DataFrame) -> DataFrame:
    """Adds ``weight``: every recording of a class, and every class, has equal mass; the mean is 1.

    A window's raw weight is 1 / (recordings of its class x windows of its recording), so each
    class sums to 1 and the mean is classes / windows. All that is needed beside the counts by
    recording is a row a class.
    """
    per = df.groupBy("label", "split_group_id").agg(F.count("*").alias("_n"))
    classes = per.groupBy("label").agg(F.count("*").alias("_g"), F.sum("_n").alias("_m"))
    whole = Window.partitionBy()
    classes = classes.select(F.col("label").alias("_l"), (F.sum("_m").over(whole) / F.count(F.lit(1)).over(whole) / F.col("_g")).alias("_s"))
    weights = per.join(F.broadcast(classes), F.col("label") == F.col("_l")).select("label", "split_group_id", (F.col("_s") / F.col("_n")).alias("weight"))
    return df.join(weights, ["label", "split_group_id"])


def hash_order(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def balanced_sample(df: DataFrame, *, group: str = "split_group_id", key: str = "sample_id", n: int = 64, seed: int = 42) -> DataFrame:
    """n draws of each group: without replacement where it has that many, else with it.

    A draw k of a short group takes the row whose rank is a hash of (seed, group, k), so
    results do not depend on order or partitions. Adds ``draw``.
    """
    by = Window.partitionBy(group)
    ranked = df.withColumn("_r", F.row_number().over(by.orderBy(hash_order(seed, key), key)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    enough = ranked.where(F.col("_n") >= n).where(F.col("_r") < n).withColumn("draw", F.col("_r").cast("int"))
    short = ranked.where(F.col("_n") < n)
    pick = lambda k: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), k.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.col("_n"))
    draws = short.withColumn("draw", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: pick(k) == F.col("_r"))))
    return enough.unionByName(draws).drop("_r", "_n")


def weighted_sample(df: DataFrame, *, n: int, weight: str = "weight", key: str = "sample_id", seed: int = 42) -> DataFrame:
    """n draws in expectation with replacement: each row as often as a Poisson variable of its share says, by hash."""
    total = df.agg(F.sum(weight)).first()[0] or 1.0
    u = (F.conv(F.substring(hash_order(seed, key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rate = F.col(weight) * (n / total)
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), (a["c"] + F.when(a["s"] < u, 1).otherwise(0)).cast("int").alias("c"), (a["s"] + a["p"] * rate / k).alias("s"))
    start = F.struct(F.exp(-rate).alias("p"), F.lit(0).alias("c"), F.exp(-rate).alias("s"))
    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.ceil(rate * 4 + 20).cast("int")), lambda k: k.cast("double")), start, step, lambda a: a["c"])
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(0))))).where(times > 0)


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Exact medians of the finite values; 0 for a column without any."""
    return {c: q[0] if q else 0.0 for c, q in exact_percentiles(df, {c: finite(F.col(c)) for c in names}, [0.5]).items()}


def imputed(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in values.items()})


def capped(df: DataFrame, *, n: int = 24, seed: int = 42) -> DataFrame:
    """At most n windows of each recording, by hash order."""
    by = Window.partitionBy("split_group_id").orderBy(hash_order(seed, "sample_id"), "sample_id")
    return df.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")
