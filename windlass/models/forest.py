"""Random forest on window features, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import imputed, medians


def fit_forest(train: DataFrame, names: list[str], *, trees: int = 300, depth: int = 12, leaf: int = 5, seed: int = 42, weight: str | None = "weight", bins: int = 128) -> tuple[PipelineModel, dict[str, float]]:
    """The model and the medians that fill missing values; ``label`` is 0/1 and ``weight`` balances recordings and classes."""
    fill = medians(train, names)
    settings = {"weightCol": weight} if weight else {}
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", impurity="gini", maxBins=bins, seed=seed, **settings)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), forest]).fit(imputed(train, fill)), fill


def score_forest(model: PipelineModel, fill: dict[str, float], df: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    out = model.transform(imputed(df, fill)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def permutation_importance(model: PipelineModel, fill: dict[str, float], df: DataFrame, names: list[str], threshold: float, *, seed: int = 42) -> DataFrame:
    """``feature, loss``: how much recall + specificity falls when a feature's values are dealt anew among the rows, by hash order."""
    from pyspark.sql import Window

    from ..operators.metrics import binary_metrics, predicted
    from ..operators.sampling import hash_order

    def quality(rows: DataFrame) -> float:
        m = binary_metrics(predicted(score_forest(model, fill, rows), threshold)).first()
        return (m.recall or 0.0) + (m.specificity or 0.0)

    base, out = quality(df), []
    for c in names:
        ranks = df.select(c, F.row_number().over(Window.orderBy(hash_order(seed, "sample_id"))).alias("_k"))
        dealt = df.drop(c).withColumn("_k", F.row_number().over(Window.orderBy("sample_id"))).join(ranks, "_k").drop("_k")
        out.append((c, base - quality(dealt)))
    return df.sparkSession.createDataFrame(out, "feature string, loss double")
