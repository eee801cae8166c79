"""Running sums and exact percentiles over a whole table without sending it all to one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column; each is one task's window.
RANGES = 64
#: Values that one percentile buffer may hold; buckets into which a bracket is cut.
MOST, BUCKETS = 1 << 20, 1024


def same(keys: list[str], others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, others, strict=True)))


def running_sums(df: DataFrame, order: str, columns: list[str], *, keys: list[str] | None = None, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds ``<column>_upto`` (sum of the rows up to and with this one) and ``<column>_all`` for each column, within ``keys``.

    Rows must be distinct in ``order`` within their keys. Approximate quantiles cut it into
    ranges; sums go within ranges, and the ranges' totals (a row each) are added on top. The
    cuts only decide where tasks split: results are exact whatever they are. What is
    broadcast is a row for each range of each key, so keys should be few (features, labels).
    """
    keys = keys or []
    quantiles = F.percentile_approx(order, F.array(*(F.lit((k + 1) / ranges) for k in range(ranges - 1))), F.lit(10_000))
    names = [f"_k{i}" for i in range(len(keys))]
    if keys:
        cuts = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.array_distinct(quantiles).alias("_cuts"))
        rows = df.join(F.broadcast(cuts), same(keys, names))
    else:
        found = sorted({x for x in df.agg(quantiles).first()[0] or [] if x is not None})
        rows = df.withColumn("_cuts", F.array(*map(F.lit, found)) if found else F.array().cast("array<double>"))
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts", *names)
    step = F.desc if descending else F.asc
    by = Window.partitionBy(*(f"_t{i}" for i in range(len(keys))))
    before = by.orderBy(step("_r")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r")).agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    totals = totals.withColumns({f"_b{i}": F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)) for i in range(len(columns))} | {f"{c}_all": F.sum(f"_s{i}").over(by) for i, c in enumerate(columns)})
    inside = Window.partitionBy(*keys, "_range").orderBy(step(order))
    on = F.col("_range") == F.col("_r")
    out = rows.join(F.broadcast(totals), same(keys, [f"_t{i}" for i in range(len(keys))]) & on if keys else on)
    out = out.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_b{i}") for i, c in enumerate(columns)})
    return out.drop("_range", "_r", *(f"_t{i}" for i in range(len(keys))), *(f"_{x}{i}" for i in range(len(columns)) for x in "sb"))


def percentiles_by(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``keys, n, q``: exact percentiles of a column within few keys, however many rows a key has.

    Equal values are summed first; a percentile lies between the values at the two ranks
    around it, which are the least whose running counts pass them.
    """
    counts = running_sums(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), value, ["n"], keys=keys)
    rank = lambda q, f: f((F.col("n_all") - 1) * F.lit(float(q)))
    ends = [F.min(F.when(F.col("n_upto") > rank(q, f), F.col(value))).alias(f"_{k}{i}") for i, q in enumerate(at) for k, f in (("l", F.floor), ("h", F.ceil))]
    found = counts.groupBy(*keys).agg(F.max("n_all").alias("n"), *ends)
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    share = lambda q: place(q) - F.floor(place(q))
    return found.select(*keys, "n", F.array(*((1 - share(q)) * F.col(f"_l{i}") + share(q) * F.col(f"_h{i}") for i, q in enumerate(at))).alias("q"))


def exact_percentiles(df: DataFrame, columns: dict[str, Column], at: list[float], *, most: int = MOST, buckets: int = BUCKETS) -> dict[str, list[float] | None]:
    """Exact percentiles of each column's values that are not NULL; None for a column without any.

    Up to ``most`` rows fit one percentile buffer. Beyond, the values at the two ranks around
    each percentile are found by nested histograms: a bracket of values is cut into buckets,
    counted by one aggregation for all columns, and the bucket that holds the rank is the next
    bracket, until it holds one value. The driver sees the buckets' counts, never the values.
    """
    x = df.select(*(c.cast("double").alias(k) for k, c in columns.items()))
    facts = x.agg(*(f(k).alias(f"{n}:{k}") for k in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first() if columns else None
    size = {k: facts[f"n:{k}"] for k in columns}
    if max(size.values(), default=0) <= most:
        row = x.agg(*(F.percentile(k, F.array(*map(F.lit, at))).alias(k) for k in columns)).first() if columns else {}
        return {k: row[k] for k in columns}
    ranks = {(k, f((size[k] - 1) * q)) for k in columns if size[k] for q in at for f in (math.floor, math.ceil)}
    found = {(k, r): (facts[f"lo:{k}"], facts[f"hi:{k}"], 0) for k, r in ranks}
    while brackets := sorted({(k, lo, hi) for (k, _), (lo, hi, _) in found.items() if lo < hi}):
        place = lambda k, lo, hi: F.least(F.lit(buckets - 1), F.floor((F.col(k) / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)).cast("int")
        each = [F.struct(F.lit(i).alias("i"), F.when(F.col(k).between(lo, hi), place(k, lo, hi)).alias("b"), F.col(k).alias("v")) for i, (k, lo, hi) in enumerate(brackets)]
        counted = x.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("b IS NOT NULL").groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        inside: dict[int, list] = {}
        for r in sorted(counted.collect()):
            inside.setdefault(r.i, []).append(r)
        for (k, rank), (lo, hi, below) in found.items():
            if lo < hi:
                for r in inside[brackets.index((k, lo, hi))]:
                    if rank < below + r.n:
                        found[k, rank] = (r.lo, r.hi, below)
                        break
                    below += r.n
    out: dict[str, list[float] | None] = {}
    for k in columns:
        out[k] = [] if size[k] else None
        for q in at if size[k] else []:
            p = (size[k] - 1) * q
            lo, hi = found[k, math.floor(p)][0], found[k, math.ceil(p)][0]
            out[k].append((1 - (p - math.floor(p))) * lo + (p - math.floor(p)) * hi)
    return out
