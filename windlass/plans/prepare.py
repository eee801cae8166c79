"""From raw transactions to aligned representations of every window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, graph, scaling, sequence, windows
from ..sources import canonical as source
from ..sources.tables import guard_output, write_json, write_table


@dataclass
class Prepared:
    """Lazy tables keyed by ``sample_id``, and the two scalers fitted on train."""

    windowed: DataFrame
    manifest: DataFrame
    excluded: DataFrame
    features: DataFrame
    scaled: DataFrame
    sequences: DataFrame
    nodes: DataFrame
    edges: DataFrame
    channel_scaler: list[dict]
    feature_scaler: list[dict]


def prepare(transactions: DataFrame, *, size: int = windows.SIZE, least: int = windows.LEAST, column_map: dict[str, str] | None = None) -> Prepared:
    """Check, window, derive and scale. Only the two fits and the leakage check run; all else is lazy.

    Scalers see the train split alone, whatever the other splits hold.
    """
    rows = source.require_sound_splits(source.require_rows(source.canonical(transactions, column_map)))
    windowed = windows.recording_windows(rows, size=size, least=least)
    feats = features.window_features(windowed)
    channel, feature = scaling.fit_channels(rows), scaling.fit_features(feats, features.FEATURES)
    seq = sequence.sequence_rows(windowed, channel)
    nodes, edges = graph.nodes(seq), graph.edges(seq)
    return Prepared(
        windowed, windows.manifest(windowed), windows.excluded(rows, size=size, least=least), feats, scaling.apply(feats, feature), sequence.sequences(seq, size=size), graph.node_features(nodes, edges), graph.edge_list(nodes, edges), channel, feature
    )


def write(prepared: Prepared, output: str, inputs: list[str]) -> None:
    """Write every table by split; raises if the output exists or lies inside an input."""
    guard_output(output, inputs)
    keyed = prepared.manifest.select("sample_id", "split")
    for name in ("manifest", "excluded", "features", "scaled"):
        write_table(getattr(prepared, name), f"{output}/{name}", partition_by=["split"])
    for name in ("sequences", "nodes", "edges"):
        write_table(getattr(prepared, name).join(keyed, "sample_id"), f"{output}/{name}", partition_by=["split"])
    for name in ("channel_scaler", "feature_scaler"):
        write_json(f"{output}/{name}.json", getattr(prepared, name))


def from_csv(spark: SparkSession, folders: dict[str, str], **settings) -> Prepared:
    """Prepare CSV files, one folder or file a split."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [source.read_transactions(spark, path, column_map=settings.get("column_map")).withColumn("split", F.lit(split)) for split, path in folders.items()]
    return prepare(reduce(DataFrame.unionByName, parts), **settings)
