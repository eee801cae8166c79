"""Count windows: consecutive rows of a recording, in order, without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .prefix import RANGES

SIZE, LEAST = 128, 32
META = ["split_group_id", "traffic_label", "source_name", "tool_label", "scenario_type", "evaluation_subset"]


def numbered(df: DataFrame, *, group: str, order: list[Column], size: int = SIZE) -> DataFrame:
    """Adds ``window_number``, ``pos`` (from 0 within the window) and ``window_tx_count``.

    Only a group's last window can be short, so its size follows from the group's row
    count; ranking and counting share one shuffle by group.
    """
    by = Window.partitionBy(group)
    out = df.withColumn("_rn", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    out = out.withColumn("window_number", F.floor(F.col("_rn") / size).cast("long")).withColumn("pos", (F.col("_rn") % size).cast("int"))
    return out.withColumn("window_tx_count", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("window_number") * size)).drop("_rn", "_n")


#: Rows of a recording beyond which its windows are ranked range by range, and the estimated bytes of a log from which recordings are counted at all.
HOT, COUNTED = 4_000_000, 1 << 30


def is_large(df: DataFrame, group: str, *, hot: int = HOT, counted: int = COUNTED) -> bool:
    """Whether some group has more rows than a task should rank: measured, unless the whole table is small."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < counted:
        return False
    return (df.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > hot


def time_ranges(df: DataFrame, time: Column, ranges: int = RANGES) -> DataFrame:
    """Adds ``_t`` (the time) and ``_p``, its range between approximate quantiles; rows without a time are the last."""
    rows = df.withColumn("_t", time)
    found = rows.agg(F.percentile_approx("_t", F.array(*(F.lit((k + 1) / ranges) for k in range(ranges - 1))), F.lit(10_000))).first()[0] or []
    cuts = sorted({x for x in found if x is not None})
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_t"))) if cuts else F.lit(0)
    return rows.withColumn("_p", F.when(F.col("_t").isNull(), F.lit(len(cuts) + 1)).otherwise(place))


def numbered_by_ranges(df: DataFrame, *, group: str, time: Column, seq: str, size: int = SIZE, ranges: int = RANGES) -> DataFrame:
    """:func:`numbered` by (time, seq) for groups too large for one task.

    Time is cut into ranges at approximate quantiles; rows are ranked within a group's
    range and shifted by the group's counts in the ranges before. What is joined back is a
    row for each group and range, and no task holds more than a range of a group. The
    cuts decide where tasks split and nothing else.
    """
    rows = time_ranges(df, time, ranges)
    per = rows.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))
    by = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_n", F.sum("_c").over(by))
    out = rows.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    out = out.withColumn("_rn", F.col("_before") + F.row_number().over(Window.partitionBy(group, "_p").orderBy(F.col("_t").asc_nulls_last(), seq)) - 1)
    out = out.withColumn("window_number", F.floor(F.col("_rn") / size).cast("long")).withColumn("pos", (F.col("_rn") % size).cast("int"))
    return out.withColumn("window_tx_count", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("window_number") * size)).drop("_rn", "_n", "_t", "_p", "_g", "_q", "_c", "_before")


def count_windows(df: DataFrame, *, group: str, order: list[Column], size: int = SIZE, least: int = LEAST) -> DataFrame:
    """:func:`numbered` rows of the windows with at least ``least`` rows."""
    return numbered(df, group=group, order=order, size=size).where(F.col("window_tx_count") >= least)


def recording_order() -> list[Column]:
    """By time, what is no number last, ties by input order."""
    return [finite(F.col("request_timestamp")).asc_nulls_last(), F.col("ingest_seq")]


def sample_id(split: Column, group: Column, window: Column) -> Column:
    return F.concat(split, F.lit("-"), F.substring(F.sha2(group, 256), 1, 16), F.lit("-"), F.lpad(window.cast("string"), 6, "0"))


def recording_windows(canonical: DataFrame, *, size: int = SIZE, least: int = LEAST, large: bool | None = None) -> DataFrame:
    """Canonical rows of all windows kept, with their ``sample_id``.

    One shuffle by recording serves ranking and all that follows. ``large`` is for logs in
    which one recording is too much for a task (None: measured by :func:`is_large`): see
    :func:`numbered_by_ranges`.
    """
    if is_large(canonical, "split_group_id") if large is None else large:
        out = numbered_by_ranges(canonical, group="split_group_id", time=finite(F.col("request_timestamp")), seq="ingest_seq", size=size).where(F.col("window_tx_count") >= least)
    else:
        out = count_windows(canonical, group="split_group_id", order=recording_order(), size=size, least=least)
    return out.withColumn("sample_id", sample_id(F.col("split"), F.col("split_group_id"), F.col("window_number")))


def manifest(windowed: DataFrame) -> DataFrame:
    """A row a window: keys, first row's strata, size, first and last timestamp."""
    first = [F.min_by(c, "pos").alias(c) for c in META]
    return windowed.groupBy("sample_id").agg(
        F.first("split").alias("split"), *first, F.first("window_number").alias("window_number"), F.first("window_tx_count").alias("window_tx_count"),
        F.min_by("request_timestamp", "pos").alias("window_start_timestamp"), F.max_by("request_timestamp", "pos").alias("window_end_timestamp"),
    )


def excluded(canonical: DataFrame, *, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Recordings that give no window: their first window is short, and so is all of them."""
    n = canonical.groupBy("split", "split_group_id").agg(F.count("*").alias("transactions"))
    return n.where(F.col("transactions") < least).withColumn("reason", F.lit(f"fewer than {least} transactions"))


def one_window(windowed: DataFrame, group: str, number: int) -> DataFrame:
    """The rows of one window of a recording."""
    return windowed.where((F.col("split_group_id") == group) & (F.col("window_number") == number)).orderBy("pos")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
