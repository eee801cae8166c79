"""From prepared tables to trained detectors, a frozen choice among them, and predictions of all splits."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import networks
from ..models.forest import fit_forest, score_forest
from ..models.isolation import fit_isolation, score_isolation
from ..models.store import Model, load_model, save_model
from ..operators import graph, metrics, sampling, selection
from ..operators.features import CORE
from ..sources.tables import is_complete, mark_complete, write_table

MODELS = ("rf", "if", "bilstm", "sage")
META = ["sample_id", "split", "split_group_id", "label", "source_name", "evaluation_subset", "tool_label", "traffic_label"]


@dataclass(frozen=True)
class Run:
    """A declared run: settings go to the model's constructor or fit, ``training`` to the networks' loop."""

    run_id: str
    model: str
    settings: dict = field(default_factory=dict)
    training: dict = field(default_factory=dict)


class Tables:
    """What :func:`windlass.plans.prepare.write` wrote."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        self.manifest = read("manifest").withColumn("label", (F.col("traffic_label") == "malicious").cast("int")).select(*META)
        self.scaled = read("scaled").select("sample_id", *CORE).join(self.manifest, "sample_id")
        self.sequences = read("sequences").drop("split")
        self.graphs = graph.graphs(read("nodes").drop("split"), read("edges").drop("split"))

    def inputs(self, model: str) -> DataFrame:
        return self.sequences if model == "bilstm" else self.graphs


def _some(rows: DataFrame, manifest: DataFrame, split: str, most: int):
    """Rows of a split with label and weight, ``most`` by hash order at most: what a network trains on is held by the driver."""
    known = sampling.recording_weights(manifest.where(F.col("split") == split)).select("sample_id", "label", "weight")
    some = known.withColumn("_h", F.xxhash64("sample_id")).orderBy("_h", "sample_id").limit(most).drop("_h")
    return rows.join(F.broadcast(some), "sample_id").orderBy("sample_id").toPandas()


def fit(run: Run, tables: Tables, *, most: int = 200_000) -> Model:
    """One detector on the train split; networks choose their epoch on the validation split."""
    train = tables.scaled.where("split = 'train'")
    if run.model == "rf":
        return fit_forest(sampling.recording_weights(train), CORE, **run.settings)
    if run.model == "if":
        return fit_isolation(train, CORE, **run.settings)
    net = {"bilstm": networks.BiLSTM, "sage": networks.GraphSAGE}[run.model](**run.settings)
    kind = networks.Sequences if run.model == "bilstm" else networks.Graphs
    rows, check = (_some(tables.inputs(run.model), tables.manifest, s, most) for s in ("train", "validation"))
    networks.train(net, kind.of(rows), rows["label"].to_numpy(), rows["weight"].to_numpy(float), kind.of(check), check["label"].to_numpy(), **run.training)
    return net


def score(model: Model, kind: str, tables: Tables) -> DataFrame:
    """META and ``score`` of every window of every split."""
    if kind == "rf":
        return score_forest(*model, tables.scaled).select(*META, "score")
    if kind == "if":
        return score_isolation(model, tables.scaled).select(*META, "score")
    return networks.score_network(model, tables.inputs(kind)).join(tables.manifest, "sample_id").select(*META, "score")


def train(spark: SparkSession, prepared: str, output: str, runs: list[Run], *, max_fpr: float = metrics.MAX_FPR, most: int = 200_000) -> None:
    """Fit, save and score every declared run that has left no marker yet.

    A run's folder has the model, the scores of all windows, and a marker with its
    threshold and its validation metrics.
    """
    tables = Tables(spark, prepared)
    for k, run in enumerate(runs):
        folder = f"{output}/{run.run_id}"
        if is_complete(folder):
            continue
        model = fit(run, tables, most=most)
        save_model(spark, model, f"{folder}/model")
        write_table(score(model, run.model, tables), f"{folder}/scores", mode="overwrite")
        checked = spark.read.parquet(f"{folder}/scores").where("split = 'validation'")
        limit = metrics.choose_threshold(checked, max_fpr)
        m = metrics.binary_metrics(metrics.predicted(checked, limit)).first()
        mark_complete(folder, {"run_id": run.run_id, "model": run.model, "declared": k, "threshold": limit, "recall": m.recall, "fpr": m.fpr, "settings": json.dumps(run.settings, sort_keys=True)})


def select(spark: SparkSession, output: str, runs: list[Run]) -> dict:
    """Freeze the best run of each model and write its predictions of all splits, for the cascade."""
    lock = selection.freeze(selection.finished_runs(spark, output), [r.run_id for r in runs], f"{output}/selected.json")
    for run in selection.finished_runs(spark, output).collect():
        if lock["selected"].get(run.model) == run.run_id:
            write_table(metrics.predicted(spark.read.parquet(f"{output}/{run.run_id}/scores"), run.threshold), f"{output}/predictions/{run.model}")
    return lock


def replay(spark: SparkSession, prepared: str, output: str, run_id: str, model: str, threshold: float) -> DataFrame:
    """A saved detector scores again: how its scores and predictions differ from those written."""
    from ..operators.evaluation import compare_scores

    again = score(load_model(spark, f"{output}/{run_id}/model"), model, Tables(spark, prepared))
    return compare_scores(*(metrics.predicted(df, threshold) for df in (spark.read.parquet(f"{output}/{run_id}/scores"), again)))


#: The runs declared by default: one of each detector with its operator's defaults.
DEFAULT = [Run(f"{m}_base", m) for m in MODELS]
