"""The 52 aggregate features of a count window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, share_where
from ..functions.similarity import adjacent_jaro_winkler
from .windows import META

HIGH_QUERY_ENTROPY, HIGH_SUBDOMAIN_ENTROPY = 4.0, 3.5
QTYPES = ["A", "AAAA", "CNAME", "TXT", "MX", "NULL", "PRIVATE"]
RCODES = ["NOERROR", "NXDOMAIN", "SERVFAIL", "NULL"]
_STATS = {"mean": F.avg, "std": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5)), "p95": lambda c: F.percentile(c, F.lit(0.95))}
# Feature names, thresholds, and known types and codes.
#: Feature stem, column, statistics, in the features' order where they stand together.
_MOMENTS = [
    ("query_name_len", "query_name_len", "mean std p95"), ("subdomain_len", "subdomain_len", "mean std p95"), ("num_labels", "num_labels", "mean std p95"), ("max_label_len", "max_label_len", "mean p95"),
    ("query_entropy", "query_entropy", "mean std p95"), ("longest_subdomain_entropy", "longest_subdomain_entropy", "mean p95"), ("long_consonant_count", "long_consonant_string_count", "mean"),
    ("transaction_bytes", "total_transaction_bytes", "mean std p95"), ("request_payload", "request_payload_len", "mean"), ("response_payload", "response_payload_len", "mean"), ("response_time", "req_resp_time_diff", "median std p95"),
]
LEXICAL = [f"{s}_{k}" for s in ("query_name_len", "subdomain_len", "num_labels") for k in ("mean", "std", "p95")] + ["max_label_len_mean", "max_label_len_p95"]
ENTROPY = ["query_entropy_mean", "query_entropy_std", "query_entropy_p95", "high_query_entropy_ratio", "longest_subdomain_entropy_mean", "longest_subdomain_entropy_p95", "high_subdomain_entropy_ratio", "long_consonant_count_mean", "long_consonant_positive_ratio"]
VOLUME = ["transaction_bytes_mean", "transaction_bytes_std", "transaction_bytes_p95", "request_payload_mean", "response_payload_mean"]
TIMING = ["response_missing_ratio", "response_time_median", "response_time_std", "response_time_p95"]
RECURRENCE = ["unique_base_domain_ratio", "top_base_domain_share", "unique_subdomain_ratio", "repeated_query_ratio"]
IAT = ["iat_mean", "iat_std", "iat_median", "iat_p95", "iat_cv"]
SIMILARITY = ["adjacent_subdomain_jaro_winkler_mean"]
QTYPE = [f"qtype_{q.lower()}_ratio" for q in QTYPES] + ["qtype_other_ratio"]
RCODE = [f"rcode_{r.lower()}_ratio" for r in RCODES] + ["rcode_other_ratio"]
FEATURES = LEXICAL + ENTROPY + VOLUME + TIMING + RECURRENCE + IAT + SIMILARITY + QTYPE + RCODE
# Features outside the 42 of the core schema.
NOT_CORE = ["query_entropy_std", "response_missing_ratio", "adjacent_subdomain_jaro_winkler_mean", "qtype_aaaa_ratio", "qtype_null_ratio", "qtype_private_ratio", "rcode_noerror_ratio", "rcode_nxdomain_ratio", "rcode_null_ratio", "rcode_other_ratio"]
CORE = [f for f in FEATURES if f not in NOT_CORE]


def _shares(column: str, prefix: str, known: list[str]) -> list[Column]:
    """Shares of upper-cased values, blanks and all; NULL counts as the value NULL."""
    value = F.upper(F.coalesce(column, F.lit("NULL")))
    return [share_where(value == k).alias(f"{prefix}_{k.lower()}_ratio") for k in known] + [share_where(~value.isin(known)).alias(f"{prefix}_other_ratio")]


def window_features(windowed: DataFrame, *, similarity: bool = True, names: list[str] | None = None) -> DataFrame:
    """``sample_id``, the window's meta columns and its features (or those named).

    One aggregation by window on rows that :func:`recording_windows` has already placed
    by recording: neither the lag of the inter-arrival times nor the count of the most
    frequent domain needs another shuffle. Undefined statistics are NULL; text and
    non-finite numbers count as missing, except that the high and positive shares keep
    them in the denominator and a missing ``is_response_missing`` counts as 1.
    ``similarity`` (the only Arrow UDF) can be left out.
    """
    inside = Window.partitionBy("split_group_id", "window_number")
    ts = finite(F.col("request_timestamp"))
    rows = windowed.withColumn("_iat", ts - F.lag(ts).over(inside.orderBy("pos")))
    rows = rows.withColumn("_base", F.count(F.lit(1)).over(Window.partitionBy("split_group_id", "window_number", F.coalesce("base_domain", F.lit("")))))
    n, stat = F.count(F.lit(1)), []
    for stem, column, kinds in _MOMENTS:
        stat += [_STATS[k](finite(F.col(column))).alias(f"{stem}_{k}") for k in kinds.split()]
    distinct = lambda c: F.size(F.collect_set(F.coalesce(c, F.lit("")))) / n
    at_least = lambda c, x: share_where(finite_or_inf(c) >= x)
    aggregates = [
        *stat,
        at_least("query_entropy", HIGH_QUERY_ENTROPY).alias("high_query_entropy_ratio"),
        at_least("longest_subdomain_entropy", HIGH_SUBDOMAIN_ENTROPY).alias("high_subdomain_entropy_ratio"),
        share_where(finite_or_inf("long_consonant_string_count") > 0).alias("long_consonant_positive_ratio"),
        F.avg(F.coalesce(finite(F.col("is_response_missing")), F.lit(1.0))).alias("response_missing_ratio"),
        distinct("base_domain").alias("unique_base_domain_ratio"),
        (F.max("_base") / n).alias("top_base_domain_share"),
        distinct("subdomain").alias("unique_subdomain_ratio"),
        (1 - distinct("query_name_normalized")).alias("repeated_query_ratio"),
        *(_STATS[k](F.col("_iat")).alias(f"iat_{k}") for k in ("mean", "std", "median", "p95")),
        *_shares("query_type", "qtype", QTYPES),
        *_shares("dns_rcode", "rcode", RCODES),
    ]
    if similarity:
        aggregates.append(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("subdomain", F.lit("")).alias("s")))).alias("_ordered"))
    meta = ["sample_id", "split", "split_group_id", "window_number", "window_tx_count"]
    out = rows.groupBy(*meta).agg(*(F.min_by(c, "pos").alias(c) for c in META[1:]), *aggregates)
    out = out.withColumn("iat_cv", F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean")))
    if similarity:
        out = out.withColumn(SIMILARITY[0], adjacent_jaro_winkler(F.col("_ordered.s")))
    chosen = names or [f for f in FEATURES if similarity or f not in SIMILARITY]
    return out.withColumn("label", (F.col("traffic_label") == "malicious").cast("int")).select(*meta, *META[1:], "label", *chosen)


def finite_or_inf(column: str) -> Column:
    """The number, or NULL if it is none: an infinite value still compares."""
    x = F.col(column).try_cast("double")
    return F.when(~F.isnan(x), x)


def core(features: DataFrame) -> DataFrame:
    """``sample_id, label`` and the 42 features of the core schema."""
    return features.select("sample_id", "label", *CORE)
