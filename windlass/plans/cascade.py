"""The two-stage cascade over four detectors' predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import cascade as op


@dataclass
class Decisions:
    rows: DataFrame
    log: DataFrame
    counters: DataFrame
    comparison: DataFrame
    enabled: bool


def decide(predictions: dict[str, DataFrame], features: DataFrame, train_features: DataFrame, *, policy: op.Policy = op.Policy(), arbitrator: op.Arbitrator = op.offline_arbitrator, frozen: bool | None = None) -> Decisions:
    """Assemble, route, ask, merge and gate.

    ``predictions`` has a table for each of rf, if, bilstm and sage; the first one's label
    and keys are kept. Whether replies override is decided here unless it is frozen.
    """
    rows = op.route(op.assemble(predictions), policy).join(op.require_unique(features.select("sample_id", *op.PROMPT_FEATURES), ["sample_id"]), "sample_id")
    reference = {r["traffic_label"]: {k: r[k] for k in op.PROMPT_FEATURES} for r in op.recording_medians(train_features, op.PROMPT_FEATURES).collect()}
    log = op.arbitrate(rows, op.prompt(reference), arbitrator).persist()  # asked once, whatever reads it
    merged = op.apply_replies(rows, log)
    enabled = op.override_enabled(merged, policy) if frozen is None else frozen
    return Decisions(op.production(merged, enabled), log, op.routing_counters(merged), op.edge_comparison(merged), enabled)
