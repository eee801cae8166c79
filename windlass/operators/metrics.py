"""Binary metrics, curves and thresholds over prediction tables: ``label`` (0/1), ``score``, ``prediction``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums

MAX_FPR = 0.01
COUNTS = ["tn", "fp", "fn", "tp"]
RATIOS = ["accuracy", "precision", "recall", "f1", "fpr", "specificity", "balanced_accuracy", "mcc"]


def predicted(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def confusion(prediction: str = "prediction") -> list[Column]:
    y, p = F.col("label") == 1, F.col(prediction) == 1
    return [F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")]


def with_ratios(counts: DataFrame) -> DataFrame:
    """Adds the ratios of tn, fp, fn, tp. What a missing class leaves undefined is NULL, never 0.

    With both classes, precision, F1 and the correlation are 0 where their denominator is 0.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    pos, neg = tp + fn, tn + fp
    both = (pos > 0) & (neg > 0)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    recall, fpr = F.when(pos > 0, tp / pos), F.when(neg > 0, fp / neg)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    values = [F.when(both, (tp + tn) / (pos + neg)), F.when(both, over(tp, tp + fp)), recall, F.when(both, over(2 * tp, 2 * tp + fp + fn)), fpr, 1 - fpr, F.when(both, (recall + 1 - fpr) / 2), F.when(both, over(tp * tn - fp * fn, root))]
    return counts.withColumns(dict(zip(RATIOS, values, strict=True)))


def binary_metrics(df: DataFrame, by: list[str] | None = None, prediction: str = "prediction") -> DataFrame:
    """Counts and ratios, of all rows or by columns; one aggregation."""
    return with_ratios((df.groupBy(*by) if by else df).agg(F.count("*").alias("n"), *confusion(prediction)))


def roc(df: DataFrame) -> DataFrame:
    """``score, tp, fp, positives, negatives``: counts at or above each distinct score.

    Scores are summed first; the running sums go over distinct scores, range by range.
    """
    per = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    sums = running_sums(per, "score", ["p", "n"], descending=True)
    return sums.select("score", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), F.col("p_all").alias("positives"), F.col("n_all").alias("negatives"), "p")


def auroc(df: DataFrame) -> DataFrame:
    """``auroc`` from tie-averaged ranks; NULL without both classes."""
    per = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n"))
    ranked = running_sums(per, "score", ["n"]).withColumn("rank", F.col("n_upto") - (F.col("n") - 1) / 2.0)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    """``auprc``: the sum of precision times the step in recall; NULL without both classes."""
    terms = roc(df).where("positives > 0 AND negatives > 0").withColumn("step", F.col("p") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return terms.agg(F.sum("step").alias("auprc"))


def threshold_at_fpr(df: DataFrame, max_fpr: float = MAX_FPR) -> DataFrame:
    """``threshold, recall, fpr``: the most recall at an allowed false-positive rate, then the least rate, then the highest threshold.

    A point just above the highest score (recall 0, rate 0) is always allowed.
    """
    curve = roc(df)
    points = curve.select("score", (F.col("tp") / F.col("positives")).alias("recall"), (F.col("fp") / F.col("negatives")).alias("fpr"))
    above = curve.agg(F.max("score").alias("score")).select(F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), F.col("score")).cast("double").alias("score"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("fpr")).where("score IS NOT NULL")
    allowed = points.unionByName(above).where(F.col("fpr") <= max_fpr + 1e-12)
    return allowed.orderBy(F.desc("recall"), "fpr", F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "recall", "fpr")


def choose_threshold(df: DataFrame, max_fpr: float = MAX_FPR) -> float:
    """The threshold as a number; raises without both classes."""
    if df.agg(F.count_distinct("label")).first()[0] != 2:
        raise ValueError("a threshold needs both classes")
    return threshold_at_fpr(df, max_fpr).first().threshold


def recordings(df: DataFrame, level: float = 0.95) -> DataFrame:
    """``split_group_id, score, label, source_name``: a recording's score is a high quantile of its windows'."""
    return df.groupBy("split_group_id").agg(F.percentile("score", F.lit(level)).alias("score"), F.min_by("label", "sample_id").alias("label"), F.min_by("source_name", "sample_id").alias("source_name"))


def stratified(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Metrics within each value of each dimension; NULL is a value. One pass by grouping sets."""
    return with_ratios(_sets(df, dimensions, [F.count("*").alias("n"), *confusion()]))


def _sets(df: DataFrame, dimensions: list[str], aggregates: list[Column]) -> DataFrame:
    """``dimension, value`` and the aggregates for every value of every dimension."""
    columns = [F.col(c) for c in dimensions]
    out = df.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id(*columns).alias("_g"), *aggregates)
    n = len(dimensions)
    full = (1 << n) - 1
    ids = {full ^ (1 << (n - 1 - k)): c for k, c in enumerate(dimensions)}
    name = value = None
    for g, c in ids.items():
        name = F.when(F.col("_g") == g, c) if name is None else name.when(F.col("_g") == g, c)
        value = F.when(F.col("_g") == g, F.col(c).cast("string")) if value is None else value.when(F.col("_g") == g, F.col(c).cast("string"))
    return out.select(name.alias("dimension"), value.alias("value"), *[c for c in out.columns if c not in {*dimensions, "_g"}])


def error_type(prediction: str = "prediction") -> Column:
    y, p = F.col("label"), F.col(prediction)
    return F.when((y == 0) & (p == 1), "false_positive").when((y == 1) & (p == 0), "false_negative").otherwise("correct")


def error_summary(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """``dimension, value, n, fp, fn, fpr, fnr`` for every value of every dimension."""
    out = _sets(df, dimensions, [F.count("*").alias("n"), *confusion()])
    return out.select("dimension", "value", "n", "fp", "fn", F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), F.try_divide(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))
