"""Two-stage decisions: clear agreement first, a majority vote next, and a budgeted appeal to an arbitrator."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .metrics import binary_metrics, confusion, error_type

# The features shown to the arbitrator.
PROMPT_FEATURES = [
    "query_name_len_mean", "subdomain_len_mean", "query_entropy_mean", "longest_subdomain_entropy_mean", "transaction_bytes_mean", "top_base_domain_share", "unique_subdomain_ratio", "repeated_query_ratio", "qtype_a_ratio", "qtype_txt_ratio",
]
DETECTORS = ["rf", "if", "bilstm", "sage"]


@dataclass(frozen=True)
class Policy:
    """Scores in [low, high] are unclear; so many requests for a recording, and in all; the false-positive rate allowed."""

    low: float = 0.2
    high: float = 0.8
    per_recording: int = 2
    per_split: int = 32
    max_fpr: float = 0.01


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, with a check in the plan that keys are unique."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fine = F.assert_true(n == 1, F.concat(F.lit("duplicate key "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys))))
    return df.withColumn("_ok", fine).where(F.col("_ok").isNull()).drop("_ok")


def unmatched(frames: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Keys that some frame lacks: ``key, frames``; what an inner join of all would drop in silence."""
    tagged = reduce(DataFrame.unionByName, (df.select(key, F.lit(name).alias("frame")) for name, df in frames.items()))
    return tagged.groupBy(key).agg(F.array_sort(F.collect_set("frame")).alias("frames")).where(F.size("frames") < len(frames))


def assemble(predictions: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """One row a sample: the first frame's columns, and ``<name>_score``, ``<name>_prediction`` of each.

    One to one: duplicates raise in the plan. See :func:`unmatched` for what the inner join drops.
    """
    out = None
    for name, df in predictions.items():
        df = require_unique(df, [key]).withColumnsRenamed({"score": f"{name}_score", "prediction": f"{name}_prediction"})
        out = df if out is None else out.join(df.select(key, f"{name}_score", f"{name}_prediction"), key)
    return out


def decided(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds ``stage_two`` and ``cascade_prediction``: the forest's where it is clear and the isolation forest agrees, else two of three."""
    clear = (F.col("rf_score") <= policy.low) | (F.col("rf_score") >= policy.high)
    votes = F.col("rf_prediction") + F.col("bilstm_prediction") + F.col("sage_prediction")
    second = ~(clear & (F.col("rf_prediction") == F.col("if_prediction")))
    return df.withColumn("stage_two", second).withColumn("cascade_prediction", F.when(second, (votes >= 2).cast("int")).otherwise(F.col("rf_prediction")).cast("int"))


def requests(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The samples to ask about: of stage two, the least hashes of each recording, then the least of all. Labels play no part."""
    order = F.sha2("sample_id", 256)
    some = df.where("stage_two").withColumn("_h", order).withColumn("_r", F.row_number().over(Window.partitionBy("split_group_id").orderBy("_h"))).where(F.col("_r") <= policy.per_recording)
    return some.orderBy("_h").limit(policy.per_split).select("sample_id")


def route(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """:func:`decided` and ``llm_requested``. The requests are at most ``per_split`` rows, so they are broadcast."""
    out = decided(df, policy)
    chosen = requests(out, policy).withColumn("llm_requested", F.lit(True))
    return out.join(F.broadcast(chosen), "sample_id", "left").withColumn("llm_requested", F.coalesce("llm_requested", F.lit(False)))


def recording_medians(features: DataFrame, names: list[str]) -> DataFrame:
    """Medians by recording of each feature, then their medians by label: every recording counts alike."""
    mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5)).alias(c)
    by = features.groupBy("traffic_label", "split_group_id").agg(*map(mid, names))
    return by.groupBy("traffic_label").agg(*map(mid, names))


def prompt(reference: dict[str, dict[str, float | None]], names: list[str] = PROMPT_FEATURES) -> Column:
    """JSON with the sample's features, the reference medians and the detectors' votes; no label, source, tool or id."""
    number = lambda c: F.bround(finite(F.col(c)), 4).alias(c)
    medians = F.struct(*(F.struct(*(F.lit(None if v is None else round(v, 4)).cast("double").alias(k) for k, v in reference[label].items())).alias(label) for label in sorted(reference)))
    vote = lambda d: F.when(F.col(f"{d}_prediction") == 1, "malicious").otherwise("benign").alias(d)
    body = F.struct(F.struct(*map(number, names)).alias("window_features"), medians.alias("train_recording_median_reference"), F.struct(*map(vote, DETECTORS)).alias("detector_decisions"), F.bround("rf_score", 4).alias("rf_score"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def valid_reply(raw: Column) -> Column:
    """Whether a reply is an object with a known label and non-blank texts as evidence and limitation.

    Types are those of the JSON itself: a number is no text.
    """
    v = F.try_parse_json(raw)
    text = lambda k: (F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING") & (F.trim(F.try_variant_get(v, f"$.{k}", "string")) != "")
    label = (F.schema_of_variant(F.try_variant_get(v, "$.label", "variant")) == "STRING") & F.try_variant_get(v, "$.label", "string").isin("benign", "malicious")
    return F.coalesce(label & text("evidence") & text("limitation"), F.lit(False))


def reply_label(raw: Column) -> Column:
    return F.when(valid_reply(raw), F.try_variant_get(F.try_parse_json(raw), "$.label", "string"))


Arbitrator = Callable[[str], str]


def http_arbitrator(endpoint: str, *, system: str, timeout: float = 90, seed: int = 42) -> Arbitrator:
    """An arbitrator behind a chat-completions endpoint in JSON mode at temperature 0."""

    def ask(body: str) -> str:
        from urllib.request import Request, urlopen

        data = {"messages": [{"role": "system", "content": system}, {"role": "user", "content": body}], "temperature": 0, "seed": seed, "response_format": {"type": "json_object"}}
        with urlopen(Request(f"{endpoint}/v1/chat/completions", json.dumps(data).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    return ask


def offline_arbitrator(body: str) -> str:
    """A deterministic stand-in: the detectors' majority."""
    votes = json.loads(body)["detector_decisions"]
    label = "malicious" if 2 * sum(v == "malicious" for v in votes.values()) >= len(votes) else "benign"
    return json.dumps({"label": label, "evidence": "majority of the detectors", "limitation": "no payload was seen"})


def arbitrate(routed: DataFrame, body: Column, arbitrator: Arbitrator = offline_arbitrator) -> DataFrame:
    """A log row for each requested sample: ``sample_id, prompt, raw_response, error, valid, seconds``. Failures are rows too."""

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        for part in it:
            rows = []
            for sample, text in zip(part["sample_id"], part["prompt"], strict=True):
                began = perf_counter()
                try:
                    raw, error = arbitrator(text), None
                except Exception as e:  # any failure falls back to the cascade's decision
                    raw, error = None, f"{type(e).__name__}: {e}"
                rows.append((sample, text, raw, error, perf_counter() - began))
            yield pd.DataFrame(rows, columns=["sample_id", "prompt", "raw_response", "error", "seconds"])

    asked = routed.where("llm_requested").select("sample_id", body.alias("prompt"))
    log = asked.mapInPandas(ask, "sample_id string, prompt string, raw_response string, error string, seconds double")
    return log.withColumn("valid", valid_reply(F.col("raw_response")))


def latest_log(log: DataFrame, order: str) -> DataFrame:
    """The last entry of each sample in a log that is only appended to."""
    return log.groupBy("sample_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "sample_id")), order).alias("_")).select("sample_id", "_.*")


def apply_replies(routed: DataFrame, log: DataFrame) -> DataFrame:
    """Adds ``arbitrated_prediction``: the reply where one was requested and is valid, else the cascade's decision."""
    replies = log.select("sample_id", F.col("valid").alias("reply_valid"), reply_label(F.col("raw_response")).alias("reply_label"))
    out = routed.join(replies, "sample_id", "left")
    use = F.col("llm_requested") & F.coalesce("reply_valid", F.lit(False))
    return out.withColumn("arbitrated_prediction", F.when(use, (F.col("reply_label") == "malicious").cast("int")).otherwise(F.col("cascade_prediction")))


def routing_counters(df: DataFrame) -> DataFrame:
    asked, valid, second = F.col("llm_requested"), F.coalesce("reply_valid", F.lit(False)), F.col("stage_two")
    return df.agg(
        F.count("*").alias("n"), F.count_if(second).alias("stage_two"), F.count_if(asked).alias("requested"), F.count_if(asked & valid).alias("valid"), F.count_if(second & ~asked).alias("budget_fallback"), F.count_if(asked & ~valid).alias("invalid_fallback")
    )


def edge_comparison(df: DataFrame, before: str = "cascade_prediction", after: str = "arbitrated_prediction", subset: Column | None = None) -> DataFrame:
    """On the requested rows: correct before and after, corrected, harmed."""
    b, a = F.col(before) == F.col("label"), F.col(after) == F.col("label")
    rows = df.where(F.col("llm_requested") & F.coalesce("reply_valid", F.lit(False)) if subset is None else subset)
    return rows.agg(F.count("*").alias("n"), F.count_if(b).alias("correct_before"), F.count_if(a).alias("correct_after"), F.count_if(~b & a).alias("corrected"), F.count_if(b & ~a).alias("harmed"))


def override_enabled(validation: DataFrame, policy: Policy = Policy(), frozen: bool | None = None) -> bool:
    """Whether replies may override: some are valid, the rate allowed holds, and F1 is no worse. A frozen decision must agree."""
    valid = validation.where(F.col("llm_requested") & F.coalesce("reply_valid", F.lit(False))).limit(1).count()
    before, after = (binary_metrics(validation, prediction=p).first() for p in ("cascade_prediction", "arbitrated_prediction"))
    fpr, f1 = after.fpr if after.fpr is not None else 0.0, (after.f1 or 0.0) >= (before.f1 or 0.0)
    enabled = bool(valid and fpr <= policy.max_fpr and f1)
    if frozen is not None and frozen != enabled:
        raise ValueError("the frozen override decision differs from this one")
    return enabled


def production(df: DataFrame, enabled: bool) -> DataFrame:
    return df.withColumn("production_prediction", F.col("arbitrated_prediction" if enabled else "cascade_prediction"))


def errors_with_features(df: DataFrame, features: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Misclassified rows with their ``error_type`` and their raw features."""
    wrong = df.withColumn("error_type", error_type(prediction)).where("error_type <> 'correct'")
    more = [c for c in features.columns if c == "sample_id" or c not in wrong.columns]
    return wrong.join(require_unique(features.select(*more), ["sample_id"]), "sample_id")


def disagreements_with_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """The rows on which detectors differ, with their features."""
    rows = disagreements(df)
    more = [c for c in features.columns if c == "sample_id" or c not in rows.columns]
    return rows.join(require_unique(features.select(*more), ["sample_id"]), "sample_id")


def mapped(x: Column, values: dict, default: Column | None = None) -> Column:
    """x by a table of values; what is not in it becomes the default, or NULL."""
    out = default if default is not None else F.lit(None)
    for k, v in reversed(values.items()):
        out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
    return out


def disagreements(df: DataFrame) -> DataFrame:
    """Rows whose ``*_prediction`` columns are not all equal."""
    columns = [c for c in df.columns if c.endswith("_prediction")]
    return df.where(F.size(F.array_distinct(F.array(*columns))) > 1)


def decision_counts(df: DataFrame, decision: str) -> DataFrame:
    return df.agg(*confusion(decision))
