"""From predictions to thresholds, metrics, strata and intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import evaluation, metrics

STRATA = ["source_name", "evaluation_subset", "tool_label"]


@dataclass
class Evaluation:
    window: DataFrame
    recording: DataFrame
    strata: DataFrame
    errors: DataFrame
    intervals: DataFrame


def thresholds(validation: DataFrame, max_fpr: float = metrics.MAX_FPR) -> tuple[float, float]:
    """Of windows, and of recordings' scores."""
    return metrics.choose_threshold(validation, max_fpr), metrics.choose_threshold(metrics.recordings(validation), max_fpr)


def evaluate(scores: DataFrame, window_threshold: float, recording_threshold: float, *, strata: list[str] = STRATA) -> Evaluation:
    """Everything about one scored split (``sample_id, split_group_id, label, score`` and strata) at frozen thresholds."""
    rows = metrics.predicted(scores, window_threshold)
    groups = metrics.predicted(metrics.recordings(scores), recording_threshold)
    return Evaluation(metrics.binary_metrics(rows), metrics.binary_metrics(groups), metrics.stratified(rows, strata), metrics.error_summary(rows, strata), evaluation.poisson_bootstrap(rows))
