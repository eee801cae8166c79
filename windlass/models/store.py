"""Fitted detectors in files, so that another process scores as this one does."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..sources.tables import read_bytes, write_bytes
from .autograd import Var
from .isolation import Isolation
from .networks import BiLSTM, GraphSAGE

Model = tuple[PipelineModel, dict[str, float]] | Isolation | BiLSTM | GraphSAGE


def _arrays(path: str, spark: SparkSession, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    write_bytes(spark, path, out.getvalue())


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a detector into a folder: a forest by Spark ML's own writer, others as arrays; ``model.json`` says which."""
    if isinstance(model, tuple):
        model[0].write().overwrite().save(f"{path}/forest")
        facts = {"kind": "forest", "fill": model[1]}
    elif isinstance(model, Isolation):
        sizes = np.array([len(t[0]) for t in model.trees])
        _arrays(f"{path}/arrays.npz", spark, sizes=sizes, **{f"t{k}": np.concatenate([t[k] for t in model.trees]) for k in range(5)})
        facts = {"kind": "isolation", "names": model.names, "fill": model.fill, "size": model.size}
    else:
        _arrays(f"{path}/arrays.npz", spark, **{k: v.value for k, v in model.p.items()})
        facts = {"kind": type(model).__name__, "settings": {k: v for k, v in vars(model).items() if k != "p"}}
    write_bytes(spark, f"{path}/model.json", json.dumps(facts).encode())


def load_model(spark: SparkSession, path: str) -> Model:
    """What :func:`save_model` wrote."""
    facts = json.loads(read_bytes(spark, f"{path}/model.json"))
    if facts["kind"] == "forest":
        return PipelineModel.load(f"{path}/forest"), facts["fill"]
    with np.load(io.BytesIO(read_bytes(spark, f"{path}/arrays.npz"))) as found:
        arrays = {k: found[k] for k in found.files}
    if facts["kind"] == "isolation":
        cuts = np.cumsum(arrays["sizes"])[:-1]
        return Isolation(facts["names"], facts["fill"], list(zip(*(np.split(arrays[f"t{k}"], cuts) for k in range(5)), strict=True)), facts["size"])
    return {"BiLSTM": BiLSTM, "GraphSAGE": GraphSAGE}[facts["kind"]](**facts["settings"], p={k: Var(v) for k, v in arrays.items()})
