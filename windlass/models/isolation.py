"""Isolation forest (Liu, Ting and Zhou, 2008): trees from small samples, scores by Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import balanced_sample, imputed, medians


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class Isolation:
    """Trees as arrays: feature (-1 in a leaf), cut, children, and the depth that a leaf stands for."""

    names: list[str]
    fill: dict[str, float]
    trees: list[tuple[np.ndarray, ...]]
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Higher is more anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = x[rows, np.maximum(feature[node], 0)] < cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += depth[node]
        return 2 ** (-total / len(self.trees) / max(float(expected_depth(self.size)), 1e-12))


def _tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    most = int(np.ceil(np.log2(max(2, len(x)))))
    feature, cut, left, right, depth = [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        k = len(feature)
        for column, value in zip((feature, cut, left, right, depth), (-1, 0.0, k, k, level + float(expected_depth(len(rows)))), strict=True):
            column.append(value)
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if level < most and len(rows) > 1 and len(wide):
            f = int(rng.choice(wide))
            c = rng.uniform(low[f], high[f])
            go = x[rows, f] < c
            if go.any() and not go.all():
                feature[k], cut[k] = f, c
                left[k] = grow(rows[go], level + 1)
                right[k] = grow(rows[~go], level + 1)
        return k

    grow(np.arange(len(x)), 0)
    return tuple(np.array(v) for v in (feature, cut, left, right, depth))


def fit_isolation(train: DataFrame, names: list[str], *, per_recording: int = 64, trees: int = 300, size: int = 256, seed: int = 42, most: int = 200_000) -> Isolation:
    """Fit on benign rows: so many draws of each recording, of which ``most`` by hash reach the driver at most; each tree takes ``size``."""
    benign = train.where("label = 0")
    fill = medians(benign, names)
    drawn = imputed(balanced_sample(benign, n=per_recording, seed=seed), fill)
    rows = drawn.select("sample_id", "draw", *names).orderBy(F.xxhash64("sample_id", "draw"), "sample_id", "draw").limit(most).toPandas().sort_values(["sample_id", "draw"])
    x, rng = rows[names].to_numpy(float), np.random.default_rng(seed)
    size = min(size, len(x))
    return Isolation(names, fill, [_tree(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)], size)


def score_isolation(model: Isolation, df: DataFrame) -> DataFrame:
    """Adds ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).astype(float)))

    filled = imputed(df, model.fill)
    return filled.withColumn("score", F.arrow_udf(score, "double")(*(F.col(c).cast("double") for c in model.names)))
