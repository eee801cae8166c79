"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of the hash that thresholds cut; four levels of histograms of 4,096 buckets.
LEVELS, BITS = 4, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(key: Column) -> Column:
    """48 bits of the key's MD5, the same in any engine; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, total)`` to ``(source, total, target)``.

    Sources in code-point order, null last, take the weights in turn. The budget is
    share x the sum of totals; a target stops at cap x its total and the excess goes
    to the others by weight. That is water filling: with sources in order of
    cap/weight, the level is (budget - caps below) / (weights from here on) at the
    first source whose own cap is not below that level. One row a source is all that
    is sorted. Without any words all targets are 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("most", F.col("total") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    below = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("total").over(everyone) * F.lit(share) - below) / rest
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everyone))
        .select("source", "total", F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("most")), F.col("most")).alias("target"))
    )


def mix_limits(narrow: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, size, h)`` to a row for each source: ``s, total, target, whole, cut``.

    A document is taken ``whole`` times, and once more if its hash is under ``cut``.
    """
    totals = narrow.groupBy("source").agg(F.sum("size").alias("total"))
    state = source_targets(totals, weights=weights, share=share, cap=cap)
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("total")).withColumn("prefix", F.lit(0).cast("long"))
    state = plan = scratch.cut(state, "plan")
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        s = state.select(F.col("source").alias("s"), "prefix", "rest").where("rest > 0")
        inside = narrow.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", "prefix", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("inside"))
        upto = sums.withColumn("upto", F.sum("inside").over(by_bucket)).where("upto >= rest AND upto - inside < rest")
        state = scratch.cut(upto.select("source", F.col("bucket").alias("prefix"), (F.col("rest") - (F.col("upto") - F.col("inside"))).alias("rest"), "inside"), f"level{level}")
    nearer = F.when(F.col("inside") - F.col("rest") <= F.col("rest"), F.lit(1)).otherwise(F.lit(0))
    cuts = state.select(F.col("source").alias("c"), (F.col("prefix") + nearer).alias("cut"))
    limits = plan.select(F.col("source").alias("s"), "total", "target", "whole").join(cuts, F.col("s").eqNullSafe(F.col("c")), "left")
    return limits.select("s", "total", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))


def _passes() -> Column:
    return F.col("whole") + F.when(F.col("h") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """Choose documents so that each source's words come near its target.

    Returns ``doc_id, source, size, source_size, target, passes, taken``: passes is how
    often the document is taken (0 up to cap), taken = passes x size. Settings are those
    of :func:`source_targets`.

    A source whose target is k whole totals and a rest takes every document k times,
    and once more those whose hash lies under a threshold. The threshold is found
    with nested histograms: sizes are summed by source and the hash's top 12 bits, and
    only the bucket in which the budget ends is split again, four levels down.
    Histograms are summed before the shuffle and have at most 4,096 rows a source, so
    a source with most of the rows costs no task more than another; documents are
    filtered and never sorted. The document at the boundary is taken if that comes
    nearer to the target.

    Null text has size 0; a null source is a source of its own; a null doc_id hashes
    as the empty text. Rows with equal doc_id are taken or left together. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = scratch.cut(_narrow(docs, "doc_id"), "sizes")
    return (
        narrow.join(mix_limits(narrow, scratch, **settings), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("passes", _passes())
        .select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))
    )


def take_mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents, with all their columns, each as often as :func:`mix_sources` takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    limits = mix_limits(scratch.cut(_narrow(docs), "sizes"), scratch, **settings)
    rows = docs.select(F.struct("*").alias("row"), "source", order_hash(F.col("doc_id")).alias("h")).join(limits, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), _passes().cast("int")))).select("row.*")


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "source", word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id")).alias("h"))
