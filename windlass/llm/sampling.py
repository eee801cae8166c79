"""Bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows of least hash of key (all, if fewer), the same for any partitioning up to rows of equal key.

    Rows above twice the share of hashes that should hold n rows are filtered out where
    they are read, so that what is sorted, and sent to one task, does not grow with the
    table. Should equal keys leave fewer than n rows, all rows compete.
    """
    hashed = df.withColumn("_h", F.xxhash64(key))
    rows = df.count()
    if rows > 2 * n:
        top = -(1 << 63) + int((1 << 64) * min(1.0, 2 * n / rows))
        some = hashed.where(F.col("_h") < F.lit(min(top, (1 << 63) - 1)))
        if some.count() >= n:
            hashed = some
    return hashed.orderBy("_h").limit(n).drop("_h")
