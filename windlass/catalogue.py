"""All queries of the library by name, with SQL for those that SQL can express.

Both forms run on the same tables: ``events`` joined with ``pages`` as canonical
transactions in windows of 16 rows (tails from 4), or ``lineitem`` in windows of 128
(tails from 32). Figures are rounded so that the order of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.nulls import finite
from .operators import cascade, checks, drift, evaluation, features, graph, metrics, sampling, scaling, sequence, windows
from .sources.canonical import EVENTS_SQL, from_events, label_conflicts, split_leaks

SIZE, LEAST = 16, 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded; -0 is 0."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recording_windows(from_events(spark, sf_dir), size=SIZE, least=LEAST)


_W = (
    EVENTS_SQL
    + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY split_group_id ORDER BY request_timestamp NULLS LAST, ingest_seq) - 1 AS rn, count(*) OVER (PARTITION BY split_group_id) AS gn FROM canon),
w AS (SELECT *, rn // {SIZE} AS window_number, rn % {SIZE} AS pos, least({SIZE}, gn - (rn // {SIZE}) * {SIZE})::BIGINT AS window_tx_count,
      split || '-' || substr(sha256(split_group_id), 1, 16) || '-' || lpad((rn // {SIZE})::VARCHAR, 6, '0') AS sample_id
      FROM numbered WHERE least({SIZE}, gn - (rn // {SIZE}) * {SIZE}) >= {LEAST})"""
)


# --- windows -------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT user_id, value, event_type, epoch_us(ts) / 1e6::DOUBLE AS t, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS gn FROM t),
w AS (SELECT *, rn // 16 AS window_number FROM n WHERE least(16, gn - (rn // 16) * 16) >= 4),
l AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, window_number ORDER BY rn) AS iat FROM w)
SELECT user_id, window_number, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(quantile_cont(value, 0.95), 6) AS value_p95,
  round(avg(iat), 3) AS iat_mean, round(avg((event_type = 'click')::INT), 4) AS click_share
FROM l GROUP BY user_id, window_number""")
def win_events_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's windows of 16 events: size, value statistics, mean gap, share of clicks."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", finite(F.col("value")).alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    w = windows.count_windows(events, group="user_id", order=[F.col("t").asc_nulls_last(), F.col("event_id")], size=SIZE, least=LEAST)
    w = w.withColumn("iat", F.col("t") - F.lag("t").over(Window.partitionBy("user_id", "window_number").orderBy("pos")))
    return w.groupBy("user_id", "window_number").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value_mean"), F.round(F.stddev_pop("value"), 6).alias("value_std"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("value_p95"),
        F.round(F.avg("iat"), 3).alias("iat_mean"), F.round(F.avg((F.col("event_type") == "click").cast("double")), 4).alias("click_share"),
    )


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS rn, count(*) OVER (PARTITION BY l_suppkey) AS gn FROM lineitem)
SELECT l_suppkey, rn // 128 AS window_number, count(*) AS n, round(avg(l_quantity), 4) AS quantity_mean, round(stddev_pop(l_quantity), 4) AS quantity_std, round(quantile_cont(l_extendedprice, 0.95), 6) AS price_p95,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS price_median, round(avg((l_returnflag = 'R')::INT), 4) AS returned_share
FROM n WHERE least(128, gn - (rn // 128) * 128) >= 32 GROUP BY l_suppkey, rn // 128""")
def win_lineitem_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's windows of 128 lines: size, quantity and price statistics, share of returns."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    w = windows.count_windows(lines, group="l_suppkey", order=[F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")])
    return w.groupBy("l_suppkey", "window_number").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("quantity_mean"), F.round(F.stddev_pop("l_quantity"), 4).alias("quantity_std"), F.round(F.percentile("l_extendedprice", F.lit(0.95)), 6).alias("price_p95"),
        F.round(F.percentile("l_extendedprice", F.lit(0.5)), 6).alias("price_median"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 4).alias("returned_share"),
    )


@query(f"""WITH {_W}
SELECT sample_id, any_value(split) AS split, any_value(split_group_id) AS split_group_id, any_value(traffic_label) AS traffic_label, any_value(source_name) AS source_name, any_value(tool_label) AS tool_label, any_value(scenario_type) AS scenario_type,
  any_value(evaluation_subset) AS evaluation_subset, any_value(window_number) AS window_number, any_value(window_tx_count) AS window_tx_count, min_by(request_timestamp, pos) AS window_start_timestamp, max_by(request_timestamp, pos) AS window_end_timestamp
FROM w GROUP BY sample_id""")
def win_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.manifest(windowed(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL}
SELECT split, split_group_id, count(*) AS transactions, 'fewer than 60 transactions' AS reason FROM canon GROUP BY ALL HAVING count(*) < 60""")
def win_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.excluded(from_events(spark, sf_dir), size=64, least=60)


# --- the 52 features -----------------------------------------------------------------------------------------

_COLUMN = {stem: column for stem, column, _ in features._MOMENTS}
_FEATURE_SQL = {
    **{f"{stem}_{k}": {"mean": "avg({0})", "std": "stddev_pop({0})", "median": "quantile_cont({0}, 0.5)", "p95": "quantile_cont({0}, 0.95)"}[k].format(column) for stem, column, kinds in features._MOMENTS for k in kinds.split()},
    "high_query_entropy_ratio": "avg(coalesce(query_entropy >= 4.0, false)::INT)",
    "high_subdomain_entropy_ratio": "avg(coalesce(longest_subdomain_entropy >= 3.5, false)::INT)",
    "long_consonant_positive_ratio": "avg(coalesce(long_consonant_string_count > 0, false)::INT)",
    "response_missing_ratio": "avg(coalesce(is_response_missing, 1))",
    "unique_base_domain_ratio": "count(DISTINCT coalesce(base_domain, '')) / count(*)::DOUBLE",
    "top_base_domain_share": "max(base_n) / count(*)::DOUBLE",
    "unique_subdomain_ratio": "count(DISTINCT coalesce(subdomain, '')) / count(*)::DOUBLE",
    "repeated_query_ratio": "1 - count(DISTINCT coalesce(query_name_normalized, '')) / count(*)::DOUBLE",
    "iat_mean": "avg(iat)", "iat_std": "stddev_pop(iat)", "iat_median": "quantile_cont(iat, 0.5)", "iat_p95": "quantile_cont(iat, 0.95)", "iat_cv": "CASE WHEN avg(iat) > 0 THEN stddev_pop(iat) / avg(iat) END",
    **{f"qtype_{q.lower()}_ratio": f"avg((upper(coalesce(query_type, 'NULL')) = '{q}')::INT)" for q in features.QTYPES},
    "qtype_other_ratio": f"avg((upper(coalesce(query_type, 'NULL')) NOT IN ({', '.join(map(repr, features.QTYPES))}))::INT)",
    **{f"rcode_{r.lower()}_ratio": f"avg((upper(coalesce(dns_rcode, 'NULL')) = '{r}')::INT)" for r in features.RCODES},
    "rcode_other_ratio": f"avg((upper(coalesce(dns_rcode, 'NULL')) NOT IN ({', '.join(map(repr, features.RCODES))}))::INT)",
}
_FW = _W + """,
fw AS (SELECT *, request_timestamp - lag(request_timestamp) OVER (PARTITION BY sample_id ORDER BY pos) AS iat, count(*) OVER (PARTITION BY sample_id, coalesce(base_domain, '')) AS base_n FROM w)"""


def _feature_query(name: str, names: list[str], digits: int = 4) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.window_features(windowed(spark, sf_dir), similarity=False, names=names).select("sample_id", *names), digits)

    run.__name__ = name
    run.__doc__ = "Features of each window: " + ", ".join(names)
    query(f"WITH {_FW} SELECT sample_id, {', '.join(f'round({_FEATURE_SQL[f]}, {digits}) AS {f}' for f in names)} FROM fw GROUP BY sample_id")(run)


for _name, _names, _digits in (
    ("feat_lexical", features.LEXICAL, 4), ("feat_entropy", features.ENTROPY, 4), ("feat_volume", features.VOLUME, 3), ("feat_timing", features.TIMING, 9), ("feat_recurrence", features.RECURRENCE, 4),
    ("feat_iat", features.IAT, 3), ("feat_qtype", features.QTYPE, 4), ("feat_rcode", features.RCODE, 4), ("feat_core_42", features.CORE, 3),
):
    _feature_query(_name, _names, _digits)


@query()
def feat_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: other engines floor transpositions and boost only above 0.7."""
    return features.window_features(windowed(spark, sf_dir), names=features.SIMILARITY).select("sample_id", *features.SIMILARITY)


# --- scalers, sequences, graphs ------------------------------------------------------------------------------


def _rule_sql(x: str, rule: str) -> str:
    return {"identity_clip_0_1": f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0), 1) END", "log1p_robust": f"CASE WHEN ({x}) IS NOT NULL THEN ln(1 + greatest({x}, 0)) END", "robust": f"({x})"}[rule]


def _fit_sql(source: str, rules: dict[str, str]) -> str:
    def one(name: str, rule: str) -> str:
        if rule == "identity_clip_0_1":
            return f"SELECT '{name}' AS feature, '{rule}' AS transformation, 0.0::DOUBLE AS center, 1.0::DOUBLE AS iqr"
        q = [f"quantile_cont({_rule_sql(name, rule)}, {p})" for p in (0.25, 0.5, 0.75)]
        return f"SELECT '{name}' AS feature, '{rule}' AS transformation, coalesce({q[1]}, 0) AS center, CASE WHEN {q[2]} - {q[0]} > 1e-12 THEN {q[2]} - {q[0]} ELSE 1 END AS iqr FROM {source}"

    return " UNION ALL ".join(one(n, r) for n, r in rules.items())


_CHANNEL_RULES = {c: scaling.channel_rule(c) for c in scaling.CHANNELS}
_GAPS = """,
gaps0 AS (SELECT *, request_timestamp - lag(request_timestamp) OVER (PARTITION BY split_group_id ORDER BY request_timestamp NULLS LAST, ingest_seq) AS gap FROM canon WHERE split = 'train'),
gaps AS (SELECT *, CASE WHEN gap >= 0 THEN gap END AS interarrival_time FROM gaps0)"""
_TX_SCALER = _GAPS + f", txs AS ({_fit_sql('gaps', _CHANNEL_RULES)})"
_TAB_NAMES = [f for f in features.FEATURES if f not in features.SIMILARITY]
_TAB = ", tab AS (SELECT sample_id, any_value(split) AS split, any_value(split_group_id) AS split_group_id, any_value(traffic_label) AS traffic_label, any_value(source_name) AS source_name, " + ", ".join(f"{_FEATURE_SQL[f]} AS {f}" for f in _TAB_NAMES) + " FROM fw GROUP BY sample_id)"
_TAB_RULES = {f: scaling.feature_rule(f) for f in _TAB_NAMES}
_TAB_SCALER = f", tab_train AS (SELECT * FROM tab WHERE split = 'train'), tabs AS ({_fit_sql('tab_train', _TAB_RULES)})"


@query(f"WITH {EVENTS_SQL}{_TX_SCALER} SELECT feature, transformation, round(center, 4) AS center, round(iqr, 4) AS iqr, 'train' AS fit_partition FROM txs")
def scaler_tx_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.scaler_table(spark, scaling.fit_channels(from_events(spark, sf_dir))))


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(windowed(spark, sf_dir), similarity=False)


@query(f"WITH {_FW}{_TAB}{_TAB_SCALER} SELECT feature, transformation, round(center, 4) AS center, round(iqr, 4) AS iqr, 'train' AS fit_partition FROM tabs")
def scaler_tab_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.scaler_table(spark, scaling.fit_features(tabular(spark, sf_dir), _TAB_NAMES)))


def _scaled_sql(x: str, rule: str, scaler: str, feature: str) -> str:
    if rule == "identity_clip_0_1":
        return f"coalesce({_rule_sql(x, rule)}, 0)"
    return f"coalesce(({_rule_sql(x, rule)} - (SELECT center FROM {scaler} WHERE feature = '{feature}')) / (SELECT iqr FROM {scaler} WHERE feature = '{feature}'), 0)"


_SCALED = ["query_name_len_mean", "query_entropy_p95", "transaction_bytes_p95", "response_time_std", "unique_subdomain_ratio", "top_base_domain_share", "iat_cv", "qtype_txt_ratio", "high_query_entropy_ratio"]


@query(f"WITH {_FW}{_TAB}{_TAB_SCALER} SELECT sample_id, " + ", ".join(f"round({_scaled_sql(f, _TAB_RULES[f], 'tabs', f)}, 3) + 0.0::DOUBLE AS {f}" for f in _SCALED) + " FROM tab")
def scale_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled features (compared before they become floats' last digits)."""
    tab = tabular(spark, sf_dir)
    fitted = scaling.fit_features(tab, _SCALED)
    return tab.select("sample_id", *((F.round(F.coalesce(finite(_z(F.col(r["feature"]), r)), F.lit(0.0)), 3) + 0.0).alias(r["feature"]) for r in fitted))


def _z(x: Column, r: dict) -> Column:
    z = scaling.transformed(x, r["transformation"])
    return z if r["transformation"] == "identity_clip_0_1" else (z - r["center"]) / r["iqr"]


def sequence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sequence_rows(windowed(spark, sf_dir), scaling.fit_channels(from_events(spark, sf_dir)))


def _ids_sql(x: str, ids: dict[str, int]) -> str:
    return f"CASE upper({x}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ids.items()) + " ELSE 1 END"


_SEQ = _FW + _TX_SCALER + ", sq AS (SELECT sample_id, pos, window_tx_count, client_ip, server_ip, base_domain, subdomain, query_type, " + ", ".join(
    _scaled_sql({"interarrival_time": "CASE WHEN pos = 0 THEN 0 WHEN iat >= 0 THEN iat END", "is_response_missing": "coalesce(is_response_missing, 0)"}.get(c, c), r, "txs", c) + f" AS x_{c}" for c, r in _CHANNEL_RULES.items()
) + f", {_ids_sql('query_type', sequence.QTYPE_IDS)} AS qtype_id, {_ids_sql('dns_rcode', sequence.RCODE_IDS)} AS rcode_id FROM fw)"


@query(f"WITH {_SEQ} SELECT sample_id, pos::INT AS pos, qtype_id::SMALLINT AS qtype_id, rcode_id::SMALLINT AS rcode_id, " + ", ".join(f"round(x_{c}, 2) + 0.0::DOUBLE AS x_{c}" for c in ("query_name_len", "query_entropy", "interarrival_time", "is_response_missing")) + " FROM sq")
def seq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled channels and ids of every transaction in its window."""
    rows = sequence_table(spark, sf_dir)
    return rounded(rows.select("sample_id", "pos", "qtype_id", "rcode_id", *(F.col(f"x_{c}").cast("double").alias(f"x_{c}") for c in ("query_name_len", "query_entropy", "interarrival_time", "is_response_missing"))), 2)


@query(f"WITH {_W} SELECT sample_id, count(*)::INT AS length, {SIZE} AS padded, {SIZE}::INT - count(*)::INT AS pads FROM w GROUP BY sample_id")
def seq_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, padded lengths and padding of the sequence tensors."""
    s = sequence.sequences(sequence_table(spark, sf_dir), size=SIZE)
    return s.select("sample_id", sequence.mask_length(F.col("mask")).alias("length"), F.size("continuous").alias("padded"), F.size(F.filter("qtype_id", lambda x: x == 0)).alias("pads"))


_GRAPH = _SEQ + """,
ent AS (SELECT *, coalesce(nullif(client_ip, ''), '<missing>') AS k0, coalesce(nullif(server_ip, ''), '<missing>') AS k1, coalesce(nullif(base_domain, ''), '<missing>') AS k2, nullif(subdomain, '') AS k3 FROM sq),
long AS (SELECT *, 0 AS r, 'client' AS kind, k0 AS key FROM ent UNION ALL SELECT *, 1, 'server', k1 FROM ent UNION ALL SELECT *, 2, 'base', k2 FROM ent UNION ALL SELECT *, 3, 'subdomain', k3 FROM ent WHERE k3 IS NOT NULL),
gn0 AS (SELECT sample_id, kind, key, min(pos * 4 + r) AS first, count(*) AS transactions, count(*) / any_value(window_tx_count)::DOUBLE AS activity_ratio, avg(x_query_name_len) AS mean_query_name_len, avg((coalesce(query_type, '') = 'A')::INT) AS a_share,
  avg((coalesce(query_type, '') IN ('TXT', 'NULL', 'PRIVATE', 'CNAME'))::INT) AS tunnel_share FROM long GROUP BY ALL),
gnode AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY first) - 1)::INT AS node_id FROM gn0),
gedge AS (SELECT sample_id, type, src_kind, src_key, dst_kind, dst_key, count(*) AS transactions, count(*) / any_value(window_tx_count)::DOUBLE AS interaction_ratio FROM (
  SELECT *, 0 AS type, 'client' AS src_kind, k0 AS src_key, 'server' AS dst_kind, k1 AS dst_key FROM ent UNION ALL SELECT *, 1, 'client', k0, 'base', k2 FROM ent UNION ALL SELECT *, 2, 'base', k2, 'subdomain', k3 FROM ent WHERE k3 IS NOT NULL) GROUP BY ALL),
gdeg AS (SELECT sample_id, kind, key, count(*) AS degree FROM (SELECT sample_id, src_kind AS kind, src_key AS key FROM gedge UNION ALL SELECT sample_id, dst_kind, dst_key FROM gedge) GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT sample_id, node_id, kind, key, transactions, round(activity_ratio, 4) AS activity_ratio, round(mean_query_name_len, 3) + 0.0::DOUBLE AS mean_query_name_len, round(a_share, 4) AS a_share, round(tunnel_share, 4) AS tunnel_share FROM gnode")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.nodes(sequence_table(spark, sf_dir)).select("sample_id", "node_id", "kind", "key", "transactions", "activity_ratio", "mean_query_name_len", "a_share", "tunnel_share")
    return rounded(n.withColumn("mean_query_name_len", F.round("mean_query_name_len", 3)))


@query(f"WITH {_GRAPH} SELECT sample_id, type, src_kind, src_key, dst_kind, dst_key, transactions, round(interaction_ratio, 4) AS interaction_ratio FROM gedge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.edges(sequence_table(spark, sf_dir)).drop(*(f"mean_{c}" for c in graph.EDGE_CHANNELS)))


@query(f"WITH {_GRAPH} SELECT sample_id, kind, key, degree FROM gdeg")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.edges(sequence_table(spark, sf_dir)))


@query(f"""WITH {_GRAPH},
ids AS (SELECT sample_id, kind, key, node_id, activity_ratio, a_share FROM gnode),
el AS (SELECT e.sample_id, s.node_id AS src, d.node_id AS dst FROM gedge e JOIN ids s ON e.sample_id = s.sample_id AND e.src_kind = s.kind AND e.src_key = s.key JOIN ids d ON e.sample_id = d.sample_id AND e.dst_kind = d.kind AND e.dst_key = d.key),
both_ AS (SELECT * FROM el UNION ALL SELECT sample_id, dst, src FROM el)
SELECT b.sample_id, b.dst AS node_id, round(avg(activity_ratio), 9) AS activity_ratio, round(avg(a_share), 9) AS a_share FROM both_ b JOIN ids s ON b.sample_id = s.sample_id AND b.src = s.node_id GROUP BY b.sample_id, b.dst""")
def sage_mean_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence_table(spark, sf_dir)
    n, e = graph.nodes(rows), graph.edges(rows)
    return rounded(graph.mean_neighbours(graph.edge_list(n, e), n, ["activity_ratio", "a_share"]), 9)  # at 4 digits many means lie halfway, and the order of summation shows


@query(f"WITH {_GRAPH} SELECT sample_id, round(avg(activity_ratio), 4) AS mean_activity_ratio, round(max(activity_ratio), 4) AS max_activity_ratio FROM gnode GROUP BY sample_id")
def graph_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.readout(graph.nodes(sequence_table(spark, sf_dir)), ["activity_ratio"], maximum=True))


# --- metrics over four deterministic pseudo-detectors --------------------------------------------------------


def _hash(name: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat("sample_id", F.lit(name)), 256), 1, 7), 16, 10).cast("long") % 100


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with label, and a score and a prediction of each of rf, if, bilstm, sage."""
    m = windows.manifest(windowed(spark, sf_dir)).withColumn("label", (F.col("traffic_label") == "malicious").cast("int"))
    m = m.withColumns({f"{d}_score": (_hash(d) + 60 * F.col("label")) / 160.0 for d in cascade.DETECTORS})
    return m.withColumns({f"{d}_prediction": (F.col(f"{d}_score") >= 0.5).cast("int") for d in cascade.DETECTORS}).withColumns({"score": F.col("rf_score"), "prediction": F.col("rf_prediction")})


_DET = _W + """,
det0 AS (SELECT sample_id, any_value(split) AS split, any_value(split_group_id) AS split_group_id, any_value(source_name) AS source_name, any_value(tool_label) AS tool_label, any_value(evaluation_subset) AS evaluation_subset, any_value((traffic_label = 'malicious')::INT) AS label FROM w GROUP BY sample_id),
det1 AS (SELECT *, """ + ", ".join(f"(('0x' || substr(sha256(sample_id || '{d}'), 1, 7))::BIGINT % 100 + 60 * label) / 160.0::DOUBLE AS {d}_score" for d in cascade.DETECTORS) + """ FROM det0),
det AS (SELECT *, """ + ", ".join(f"({d}_score >= 0.5)::INT AS {d}_prediction" for d in cascade.DETECTORS) + ", rf_score AS score, (rf_score >= 0.5)::INT AS prediction FROM det1)"  # fmt: skip
_CONF = "count(*) FILTER (label = 0 AND {p} = 0) AS tn, count(*) FILTER (label = 0 AND {p} = 1) AS fp, count(*) FILTER (label = 1 AND {p} = 0) AS fn, count(*) FILTER (label = 1 AND {p} = 1) AS tp"
_CONFUSION = _CONF.format(p="prediction")
_RATIOS = """n, tn, fp, fn, tp,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp + tn) / n::DOUBLE END, 6) AS accuracy, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END END, 6) AS f1,
  round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp)::DOUBLE END, 6) AS fpr, round(CASE WHEN tn + fp > 0 THEN 1 - fp / (tn + fp)::DOUBLE END, 6) AS specificity,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + 1 - fp / (tn + fp)::DOUBLE) / 2 END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN CASE WHEN (tp + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END END, 6) AS mcc"""


@query(f"WITH {_DET}, c AS (SELECT split, count(*) AS n, {_CONFUSION} FROM det GROUP BY split) SELECT split, {_RATIOS} FROM c")
def metrics_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios by split; external_test has one class only."""
    return rounded(metrics.binary_metrics(detections(spark, sf_dir), ["split"]), 6)


@query(f"""WITH {_DET}, p AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM det GROUP BY score)
SELECT round(score, 6) AS score, (sum(p) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS positives, (sum(n) OVER ())::BIGINT AS negatives FROM p""")
def metrics_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc(detections(spark, sf_dir)).drop("p"), 6)


@query(f"""WITH {_DET}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM det), s AS (SELECT sum(r) FILTER (label = 1) AS r, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM r)
SELECT round((r - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM s""")
def metrics_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(detections(spark, sf_dir)), 6)


@query(f"""WITH {_DET}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM det GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, sum(p) OVER () AS all_p FROM g)
SELECT round(sum(p / all_p::DOUBLE * tp / n::DOUBLE), 6) AS auprc FROM c""")
def metrics_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(detections(spark, sf_dir)), 6)


_POINTS = """, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM det GROUP BY score),
pts AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / (sum(p) OVER ())::DOUBLE AS recall, sum(n) OVER (ORDER BY score DESC) / (sum(n) OVER ())::DOUBLE AS fpr FROM g)"""


@query(f"WITH {_DET}{_POINTS} SELECT round(score, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM pts WHERE fpr <= 0.05 + 1e-12 ORDER BY pts.recall DESC, pts.fpr, pts.score DESC LIMIT 1")
def threshold_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_at_fpr(detections(spark, sf_dir), 0.05), 6)


@query(f"WITH {_DET} SELECT split_group_id, round(quantile_cont(score, 0.95), 9) AS score, min_by(label, sample_id) AS label, min_by(source_name, sample_id) AS source_name FROM det GROUP BY split_group_id")
def recording_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.recordings(detections(spark, sf_dir)), 9)


_STRATA = ["source_name", "evaluation_subset", "tool_label"]
_SETS = f", c AS ({' UNION ALL '.join(f'SELECT {chr(39)}{d}{chr(39)} AS dimension, {d} AS value, count(*) AS n, {_CONFUSION} FROM det GROUP BY {d}' for d in _STRATA)})"


@query(f"WITH {_DET}{_SETS} SELECT dimension, value, {_RATIOS} FROM c")
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.stratified(detections(spark, sf_dir), _STRATA), 6)


@query(f"WITH {_DET}{_SETS} SELECT dimension, value, n, fp, fn, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS fnr FROM c")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_summary(detections(spark, sf_dir), _STRATA), 6)


@query(f"WITH {_DET} SELECT sample_id, CASE WHEN label = 0 AND prediction = 1 THEN 'false_positive' WHEN label = 1 AND prediction = 0 THEN 'false_negative' ELSE 'correct' END AS error_type FROM det")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("sample_id", metrics.error_type().alias("error_type"))


@query(f"""WITH {_DET}, e AS (SELECT *, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM det WHERE label <> prediction)
SELECT split, source_name, error_type, count(*) AS windows, count(DISTINCT split_group_id) AS recordings, min(sample_id) AS sample_id FROM e GROUP BY ALL""")
def representative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.representative_errors(detections(spark, sf_dir), ["split", "source_name"])


# --- weights and samples -------------------------------------------------------------------------------------


@query(f"""WITH {_DET}, g AS (SELECT label, split_group_id, count(*) AS n FROM det GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY label) AS groups FROM g), x AS (SELECT *, 1.0::DOUBLE / (groups * n) AS w FROM k)
SELECT sample_id, round(w * (SELECT sum(n) FROM x) / (SELECT sum(w * n) FROM x), 6) AS weight FROM det JOIN x USING (label, split_group_id)""")
def recording_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.recording_weights(detections(spark, sf_dir)).select("sample_id", "weight"), 6)


@query(f"""WITH {_DET}, r AS (SELECT sample_id, split_group_id, row_number() OVER (PARTITION BY split_group_id ORDER BY sha256('42|' || sample_id), sample_id) - 1 AS r, count(*) OVER (PARTITION BY split_group_id) AS n FROM det)
SELECT sample_id, r::INT AS draw FROM r WHERE n >= 4 AND r < 4
UNION ALL SELECT sample_id, k::INT FROM r, range(4) t(k) WHERE n < 4 AND ('0x' || substr(sha256('42|' || split_group_id || '|' || k), 1, 8))::BIGINT % n = r""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(detections(spark, sf_dir), n=4).select("sample_id", "draw")


@query(f"WITH {_DET}, r AS (SELECT sample_id, row_number() OVER (PARTITION BY split_group_id ORDER BY sha256('42|' || sample_id), sample_id) AS r FROM det) SELECT sample_id FROM r WHERE r <= 3")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(detections(spark, sf_dir), n=3).select("sample_id")


# --- cascade -------------------------------------------------------------------------------------------------

_ROUTE = _DET + """,
dec AS (SELECT *, NOT ((rf_score <= 0.2 OR rf_score >= 0.8) AND rf_prediction = if_prediction) AS stage_two FROM det),
cas AS (SELECT *, CASE WHEN stage_two THEN (rf_prediction + bilstm_prediction + sage_prediction >= 2)::INT ELSE rf_prediction END AS cascade_prediction FROM dec),
rq0 AS (SELECT sample_id, sha256(sample_id) AS h, row_number() OVER (PARTITION BY split_group_id ORDER BY sha256(sample_id)) AS r FROM cas WHERE stage_two),
rq AS (SELECT sample_id FROM rq0 WHERE r <= 2 ORDER BY h LIMIT 32),
routed AS (SELECT cas.*, rq.sample_id IS NOT NULL AS llm_requested FROM cas LEFT JOIN rq USING (sample_id)),
rep AS (SELECT *, (rf_prediction + if_prediction + bilstm_prediction + sage_prediction >= 2)::INT AS reply, CASE WHEN llm_requested THEN (rf_prediction + if_prediction + bilstm_prediction + sage_prediction >= 2)::INT ELSE cascade_prediction END AS arbitrated_prediction FROM routed)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.route(detections(spark, sf_dir))


def arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed rows with the replies of the offline arbitrator (the detectors' majority)."""
    rows = routed(spark, sf_dir)
    body = F.to_json(F.struct(F.struct(*(F.when(F.col(f"{d}_prediction") == 1, "malicious").otherwise("benign").alias(d) for d in cascade.DETECTORS)).alias("detector_decisions")))
    return cascade.apply_replies(rows, cascade.arbitrate(rows, body))


@query(f"WITH {_ROUTE} SELECT sample_id, stage_two, cascade_prediction, llm_requested FROM routed")
def cascade_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("sample_id", "stage_two", "cascade_prediction", "llm_requested")


@query(f"WITH {_ROUTE} SELECT sample_id FROM rq")
def cascade_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.requests(cascade.decided(detections(spark, sf_dir)))


@query(f"WITH {_ROUTE} SELECT count(*) AS n, count(*) FILTER (cascade_prediction = label) AS correct_before, count(*) FILTER (reply = label) AS correct_after, count(*) FILTER (cascade_prediction <> label AND reply = label) AS corrected, count(*) FILTER (cascade_prediction = label AND reply <> label) AS harmed FROM rep WHERE llm_requested")
def edge_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.edge_comparison(arbitrated(spark, sf_dir))


@query(f"WITH {_ROUTE} SELECT count(*) AS n, count(*) FILTER (stage_two) AS stage_two, count(*) FILTER (llm_requested) AS requested, count(*) FILTER (llm_requested) AS valid, count(*) FILTER (stage_two AND NOT llm_requested) AS budget_fallback, 0::BIGINT AS invalid_fallback FROM routed")
def routing_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.routing_counters(arbitrated(spark, sf_dir))


@query(f"WITH {_ROUTE} SELECT sample_id, arbitrated_prediction FROM rep")
def arbitrated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrated(spark, sf_dir).select("sample_id", "arbitrated_prediction")


@query(f"WITH {_DET} SELECT sample_id FROM det WHERE NOT (rf_prediction = if_prediction AND rf_prediction = bilstm_prediction AND rf_prediction = sage_prediction)")
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {d: detections(spark, sf_dir).select("sample_id", F.col(f"{d}_score").alias("score"), F.col(f"{d}_prediction").alias("prediction")) for d in cascade.DETECTORS}
    return cascade.disagreements(cascade.assemble(frames)).select("sample_id")


@query("""
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"label":"benign","evidence":"short names","limitation":"no payload"}' WHEN 1 THEN '{"label":"uncertain","evidence":"a","limitation":"b"}'
  WHEN 2 THEN '{"label":"malicious","evidence":1,"limitation":"x"}' WHEN 3 THEN '{"label":"malicious","evidence":"  ","limitation":"x"}' WHEN 4 THEN 'no json' ELSE props END AS raw FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r)
SELECT event_id, coalesce(json_type(j, '$.label') = 'VARCHAR' AND (j ->> '$.label') IN ('benign', 'malicious') AND json_type(j, '$.evidence') = 'VARCHAR' AND trim(j ->> '$.evidence') <> '' AND json_type(j, '$.limitation') = 'VARCHAR' AND trim(j ->> '$.limitation') <> '', false) AS valid FROM j""")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    raw = F.when(k == 0, '{"label":"benign","evidence":"short names","limitation":"no payload"}').when(k == 1, '{"label":"uncertain","evidence":"a","limitation":"b"}').when(k == 2, '{"label":"malicious","evidence":1,"limitation":"x"}')
    raw = raw.when(k == 3, '{"label":"malicious","evidence":"  ","limitation":"x"}').when(k == 4, "no json").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", cascade.valid_reply(raw).alias("valid"))


# --- references, drift, tests --------------------------------------------------------------------------------

_NAMES = ["query_name_len_mean", "query_entropy_mean", "transaction_bytes_mean", "unique_subdomain_ratio", "response_time_median"]
_MED = _FW + _TAB + ", rec AS (SELECT split, split_group_id, traffic_label, source_name, " + ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in _NAMES) + " FROM tab GROUP BY ALL)"
_LONG = _MED + ", lng AS (" + " UNION ALL ".join(f"SELECT split, split_group_id, traffic_label AS label, source_name, '{f}' AS feature, {f} AS value FROM rec WHERE {f} IS NOT NULL" for f in _NAMES) + ")"


@query(f"WITH {_MED} SELECT traffic_label, {', '.join(f'round(quantile_cont({f}, 0.5), 4) AS {f}' for f in _NAMES)} FROM rec WHERE split = 'train' GROUP BY traffic_label")
def reference_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cascade.recording_medians(tabular(spark, sf_dir).where("split = 'train'"), _NAMES))


def long_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.group_medians(tabular(spark, sf_dir).withColumnRenamed("label", "y").withColumnRenamed("traffic_label", "label"), ["split", "split_group_id", "label", "source_name"], _NAMES)


@query(f"""WITH {_LONG}, ref AS (SELECT label, feature, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lng WHERE split = 'train' GROUP BY ALL),
h AS (SELECT split, label, feature, quantile_cont(value, 0.5) AS median, count(*) AS n FROM lng WHERE split <> 'train' GROUP BY ALL)
SELECT split, label, feature, n, round(CASE WHEN iqr > 1e-12 THEN (median - center) / iqr END, 4) AS shift FROM h JOIN ref USING (label, feature)""")
def distribution_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_medians(spark, sf_dir)
    return rounded(drift.shift(rows.where("split = 'train'"), rows.where("split <> 'train'"), ["split"]).select("split", "label", "feature", "n", "shift"))


@query(f"""WITH {_LONG}, p AS (SELECT label, feature, round(value, 6) AS value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split <> 'train') AS b FROM lng GROUP BY label, feature, round(value, 6)),
c AS (SELECT label, feature, sum(a) OVER (PARTITION BY label, feature ORDER BY value) AS a, sum(b) OVER (PARTITION BY label, feature ORDER BY value) AS b, sum(a) OVER (PARTITION BY label, feature) AS n1, sum(b) OVER (PARTITION BY label, feature) AS n2 FROM p)
SELECT label, feature, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, round(max(abs(a / n1::DOUBLE - b / n2::DOUBLE)), 6) AS ks FROM c GROUP BY ALL""")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_medians(spark, sf_dir).withColumn("value", F.round("value", 6)).withColumn("second", F.col("split") != "train")
    return rounded(drift.ks_statistic(rows, ["label", "feature"]), 6)


_MWU = f"""WITH {_LONG}, r AS (SELECT feature, label = 'malicious' AS second, rank() OVER (PARTITION BY feature ORDER BY round(value, 6)) + (count(*) OVER (PARTITION BY feature, round(value, 6)) - 1) / 2.0::DOUBLE AS r FROM lng),
s AS (SELECT feature, count(*) FILTER (NOT second) AS n1, count(*) FILTER (second) AS n2, sum(r) FILTER (second) AS r FROM r GROUP BY feature), u AS (SELECT feature, n1, n2, r - n2 * (n2 + 1) / 2.0::DOUBLE AS u FROM s)"""


def mwu_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_medians(spark, sf_dir).withColumn("value", F.round("value", 6)).withColumn("second", F.col("label") == "malicious")
    return drift.mann_whitney(rows, ["feature"])


@query(_MWU + " SELECT feature, n1, n2, round(u, 4) AS u FROM u")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mwu_table(spark, sf_dir).drop("ties"))


@query(_MWU + " SELECT feature, round(2 * u / (n1 * n2) - 1, 6) AS delta, CASE WHEN abs(2 * u / (n1 * n2) - 1) < 0.147 THEN 'negligible' WHEN abs(2 * u / (n1 * n2) - 1) < 0.33 THEN 'small' WHEN abs(2 * u / (n1 * n2) - 1) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM u")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.cliffs_delta(mwu_table(spark, sf_dir)).select("feature", "delta", "magnitude"), 6)


@query("""WITH p AS (SELECT p_name AS feature, p_partkey % 97 / 1000.0::DOUBLE AS p_value, p_partkey FROM part WHERE p_partkey <= 50), r AS (SELECT *, row_number() OVER (ORDER BY p_value, p_partkey::VARCHAR) AS k, count(*) OVER () AS m FROM p)
SELECT p_partkey::VARCHAR AS feature, p_value, round(max(least(1, p_value * (m - k + 1))) OVER (ORDER BY p_value, p_partkey::VARCHAR), 6) AS holm_p FROM r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's adjustment of made-up p-values, one a part."""
    p = table(spark, sf_dir, "part").where("p_partkey <= 50").select(F.col("p_partkey").cast("string").alias("feature"), (F.col("p_partkey") % 97 / 1000.0).alias("p_value"))
    return drift.holm(p).select("feature", "p_value", F.round("holm_p", 6).alias("holm_p"))


@query(f"""WITH {_FW}{_TAB}, b AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, min({f}) AS low, max({f}) AS high FROM tab WHERE split = 'train' AND traffic_label = 'benign'" for f in _NAMES)}),
v AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value FROM tab WHERE split = 'test' AND {f} IS NOT NULL" for f in _NAMES)})
SELECT feature, count(*) AS n, round(avg((round(value, 6) > round(high, 6))::INT), 6) AS above, round(avg((round(value, 6) < round(low, 6))::INT), 6) AS below FROM v JOIN b USING (feature) GROUP BY feature""")
def error_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of test values outside the range of benign training values."""
    tab = tabular(spark, sf_dir).withColumns({f: F.round(f, 6) for f in _NAMES})
    return rounded(drift.envelope(tab.where("split = 'train' AND traffic_label = 'benign'"), tab.where("split = 'test'"), _NAMES), 6)


# --- whole rows of what other queries compare in part --------------------------------------------------------

_X = lambda c: f"round(avg(x_{c}::FLOAT::DOUBLE), 2) + 0.0::DOUBLE AS mean_{c}"


@query(f"WITH {_SEQ} SELECT sample_id, pos::INT AS pos, " + ", ".join(f"round(x_{c}::FLOAT::DOUBLE, 2) + 0.0::DOUBLE AS x_{c}" for c in scaling.CHANNELS) + " FROM sq")
def seq_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 15 scaled channels of every transaction in its window."""
    rows = sequence_table(spark, sf_dir)
    return rounded(rows.select("sample_id", "pos", *(F.col(f"x_{c}").cast("double").alias(f"x_{c}") for c in scaling.CHANNELS)), 2)


@query(f"""WITH {_GRAPH}, means AS (SELECT sample_id, kind, key, {", ".join(_X(c) for c in graph.NODE_CHANNELS)} FROM long GROUP BY ALL), sizes AS (SELECT sample_id, count(*) AS size FROM gnode GROUP BY sample_id)
SELECT g.sample_id, g.node_id, g.kind, g.key, {", ".join(f"(g.kind = '{k}')::INT::DOUBLE AS is_{k}" for k in graph.KINDS)}, round(g.activity_ratio, 4) AS activity_ratio, {", ".join(f"m.mean_{c}" for c in graph.NODE_CHANNELS)},
  round(coalesce(d.degree, 0) / greatest(size - 1, 1)::DOUBLE, 4) AS degree_ratio, round(g.a_share, 4) AS a_share, round(g.tunnel_share, 4) AS tunnel_share
FROM gnode g JOIN means m USING (sample_id, kind, key) JOIN sizes USING (sample_id) LEFT JOIN gdeg d USING (sample_id, kind, key)""")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 features of every node."""
    rows = sequence_table(spark, sf_dir)
    n = graph.nodes(rows)
    return rounded(graph.node_features(n, graph.edges(rows)).withColumns({f"mean_{c}": F.round(f"mean_{c}", 2) for c in graph.NODE_CHANNELS}))


@query(f"""WITH {_GRAPH}, e0 AS (SELECT *, 0 AS type, 'client' AS src_kind, k0 AS src_key, 'server' AS dst_kind, k1 AS dst_key FROM ent UNION ALL SELECT *, 1, 'client', k0, 'base', k2 FROM ent UNION ALL SELECT *, 2, 'base', k2, 'subdomain', k3 FROM ent WHERE k3 IS NOT NULL)
SELECT sample_id, type, src_kind, src_key, dst_kind, dst_key, {", ".join(_X(c) for c in graph.EDGE_CHANNELS)} FROM e0 GROUP BY ALL""")
def edge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both means of every edge."""
    return rounded(graph.edges(sequence_table(spark, sf_dir)).drop("transactions", "interaction_ratio"), 2)


@query(f"""WITH {EVENTS_SQL} SELECT split, split_group_id, traffic_label, query_type, count(*) AS n, round(sum(query_name_len), 2) AS name_len, round(avg(total_transaction_bytes), 4) AS bytes, min(ingest_seq) AS first_seq FROM canon GROUP BY ALL""")
def canonical_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical view through the vendor adapter, the checks and the projection."""
    from .sources.canonical import canonical, require_rows

    vendor = from_events(spark, sf_dir).withColumnRenamed("query_type", "vendor_type").withColumn("traffic_label", F.upper("traffic_label")).withColumn("extra", F.lit(1))
    rows = require_rows(canonical(vendor, {"vendor_type": "query_type"}))
    return rows.groupBy("split", "split_group_id", "traffic_label", "query_type").agg(F.count("*").alias("n"), F.round(F.sum("query_name_len"), 2).alias("name_len"), F.round(F.avg("total_transaction_bytes"), 4).alias("bytes"), F.min("ingest_seq").alias("first_seq"))


@query(f"WITH {_W} SELECT sample_id, pos::INT AS pos, ingest_seq FROM w WHERE window_number = 1 AND split_group_id = (SELECT min(split_group_id) FROM w)")
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the second window of the first recording."""
    w = windowed(spark, sf_dir)
    return windows.one_window(w, w.agg(F.min("split_group_id")).first()[0], 1).select("sample_id", "pos", "ingest_seq")


_DET_TAB = _DET + _FW[len(_W) :] + _TAB


@query(f"""WITH {_DET_TAB} SELECT d.sample_id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, {", ".join(f"round(t.{f}, 4) AS {f}" for f in _NAMES)} FROM det d JOIN tab t USING (sample_id) WHERE label <> prediction""")
def errors_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misclassified windows with raw features."""
    return rounded(cascade.errors_with_features(detections(spark, sf_dir), tabular(spark, sf_dir)).select("sample_id", "error_type", *_NAMES))


@query(f"""WITH {_DET_TAB} SELECT d.sample_id, {", ".join(f"round(t.{f}, 4) AS {f}" for f in _NAMES)} FROM det d JOIN tab t USING (sample_id) WHERE NOT (rf_prediction = if_prediction AND rf_prediction = bilstm_prediction AND rf_prediction = sage_prediction)""")
def disagreements_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows on which the detectors differ, with features."""
    rows = detections(spark, sf_dir).select("sample_id", *(f"{d}_prediction" for d in cascade.DETECTORS))
    return rounded(cascade.disagreements_with_features(rows, tabular(spark, sf_dir)).select("sample_id", *_NAMES))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'AAAA' ELSE 'other' END AS kind FROM events")
def value_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", cascade.mapped(F.col("event_type"), {"click": "A", "view": "AAAA"}, F.lit("other")).alias("kind"))


@query("SELECT p_partkey::VARCHAR AS feature FROM part WHERE p_partkey % 97 / 1000.0::DOUBLE < 0.05 AND abs((p_partkey % 41 - 20) / 40.0::DOUBLE) >= 0.147")
def feature_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule for core features on made-up tests, one a part."""
    key = F.col("p_partkey")
    tests = table(spark, sf_dir, "part").select(key.cast("string").alias("feature"), (key % 97 / 1000.0).alias("holm_p"), ((key % 41 - 20) / 40.0).alias("delta"))
    return drift.feature_core(tests)


@query(f"WITH {_DET}, c AS (SELECT count(*) AS n, {_CONF.format(p='(score >= 0.6)::INT')} FROM det WHERE split = 'train') SELECT {_RATIOS} FROM c")
def train_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.train_fit(detections(spark, sf_dir), 0.6), 6)


@query(f"WITH {_DET} SELECT count(*) AS n, round(max(abs(rf_score - if_score)), 6) AS max_score_difference, bool_and(rf_prediction = if_prediction) AS predictions_equal FROM det")
def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorings of the same samples."""
    det = detections(spark, sf_dir)
    one, two = (det.select("sample_id", F.col(f"{d}_score").alias("score"), F.col(f"{d}_prediction").alias("prediction")) for d in ("rf", "if"))
    return rounded(evaluation.compare_scores(one, two), 6)


@query(f"""WITH {_DET}, c AS (SELECT split, count(*) FILTER (label = 1 AND prediction = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE AS recall, count(*) FILTER (label = 0 AND prediction = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE AS fpr FROM det GROUP BY split)
SELECT 'rf' AS model, {", ".join(f"round({f}({m}), 6) AS {m}_{k}" for m in ("recall", "fpr") for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))} FROM c""")
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of metrics over runs of one model (here the splits)."""
    runs = metrics.binary_metrics(detections(spark, sf_dir), ["split"]).withColumn("model", F.lit("rf"))
    return rounded(evaluation.seed_stability(runs, ["recall", "fpr"]), 6)


# --- checks --------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT 'split' AS kind, count(*) AS recordings FROM (SELECT split_group_id FROM canon GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'label', count(*) FROM (SELECT split_group_id FROM canon GROUP BY 1 HAVING count(DISTINCT traffic_label) > 1)")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_events(spark, sf_dir)
    leaks, labels = split_leaks(rows), label_conflicts(rows)
    return leaks.agg(F.lit("split").alias("kind"), F.count("*").alias("recordings")).unionByName(labels.agg(F.lit("label").alias("kind"), F.count("*").alias("recordings")))


@query(f"""WITH {_W} SELECT v.check, true AS passed, v.observed, v.expected FROM (
  SELECT 'sample ids are unique' AS check, count(DISTINCT sample_id)::VARCHAR AS observed, count(DISTINCT sample_id)::VARCHAR AS expected FROM w
  {' '.join(f"UNION ALL SELECT '{c}', '0', '0'" for c in ('features and manifest have the same samples', 'windows have the size in the manifest', 'positions are dense', 'features are finite or missing', 'no recording is in two splits', 'no recording has two labels'))}) v""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir)
    return checks.report(checks.window_checks(w, windows.manifest(w), features.window_features(w, similarity=False), _TAB_NAMES))


@query(f"""WITH {_W}, m AS (SELECT split, sample_id, any_value(traffic_label) AS l FROM w GROUP BY ALL), a AS (SELECT split, count(*) AS rows, count(DISTINCT split_group_id) AS recordings FROM w GROUP BY split)
SELECT split, a.rows, recordings, count(*) AS windows, count(*) FILTER (l = 'benign') AS benign, count(*) FILTER (l = 'malicious') AS malicious FROM m JOIN a USING (split) GROUP BY ALL""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir)
    return evaluation.split_summary(w, windows.manifest(w))


@query(f"WITH {_FW}{_TAB} SELECT sample_id, true AS matches FROM tab")
def reconstruction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features computed again from rows in another order."""
    again = features.window_features(windows.recording_windows(from_events(spark, sf_dir).repartition(7), size=SIZE, least=LEAST), similarity=False)
    return checks.reconstruction(again, tabular(spark, sf_dir), _TAB_NAMES).select("sample_id", "matches")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.poisson_bootstrap(detections(spark, sf_dir))


@query()
def exact_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recording_intervals(metrics.recordings(detections(spark, sf_dir)).withColumn("prediction", (F.col("score") >= 0.8).cast("int")))


# --- detectors -----------------------------------------------------------------------------------------------

_MODEL_NAMES = [f for f in features.CORE if f != "iat_cv"] + ["iat_cv"]


def scored_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scaled core features with label and recording weight: the train split, and all."""
    tab = tabular(spark, sf_dir).persist()  # a row a window; every fit reads it again
    tab = scaling.apply(tab, scaling.fit_features(tab, features.CORE)).persist()  # so that what follows is no part of this projection
    return sampling.recording_weights(tab.where("split = 'train'")), tab


@query()
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest: fitted on train, scores of all windows."""
    from .models.forest import fit_forest, score_forest

    train, everything = scored_splits(spark, sf_dir)
    model, fill = fit_forest(train, _MODEL_NAMES, trees=20, depth=6)
    return score_forest(model, fill, everything).select("sample_id", "split", "label", "score")


@query()
def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest: fitted on benign train windows, scores of all windows."""
    from .models.isolation import fit_isolation, score_isolation

    train, everything = scored_splits(spark, sf_dir)
    return score_isolation(fit_isolation(train, _MODEL_NAMES, per_recording=8, trees=100), everything).select("sample_id", "split", "label", "score")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.manifest(windowed(spark, sf_dir)).withColumn("label", (F.col("traffic_label") == "malicious").cast("int")).select("sample_id", "split", "split_group_id", "label")


def _trained(net, data, rows: DataFrame, spark: SparkSession, sf_dir: str, epochs: int) -> DataFrame:
    """Train on at most 2,000 train windows by hash order, choose the epoch on at most 1,000 validation ones, score all."""
    from .models import networks

    rows = rows.persist()  # a row a window; read for training, for choosing the epoch and for scoring
    labels = _labels(spark, sf_dir).withColumn("_h", F.sha2("sample_id", 256)).persist()
    # windows are chosen by their labels alone: ordering whole windows would send each task's first n of them to the driver
    some = lambda split, n: networks.gathered(data, rows.join(F.broadcast(labels.where(F.col("split") == split).orderBy("_h").limit(n)), "sample_id"), "_h")
    (fit_data, fit), (check_data, check) = some("train", 2000), some("validation", 1000)
    labels.unpersist()
    counts = fit.groupby(["label", "split_group_id"])["sample_id"].transform("count")
    weight = 1 / (counts * fit.groupby("label")["split_group_id"].transform("nunique"))
    networks.train(net, fit_data, fit["label"].to_numpy(), weight.to_numpy(), check_data, check["label"].to_numpy(), epochs=epochs)
    return networks.score_network(net, rows)


@query()
def bilstm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence network, trained for a few epochs; scores of all windows."""
    from .models.networks import BiLSTM, Sequences

    return _trained(BiLSTM(hidden=8), Sequences, sequence.sequences(sequence_table(spark, sf_dir), size=SIZE), spark, sf_dir, epochs=2)


def _trained_on_all(net, rows: DataFrame, spark: SparkSession, sf_dir: str, epochs: int) -> DataFrame:
    """Train on all train windows, choose the epoch on all validation ones, score all."""
    from .llm.scratch import Scratch
    from .models import networks

    labels = _labels(spark, sf_dir).persist()  # a row a window; counted by recording and class
    weights = sampling.recording_weights(labels.where("split = 'train' AND label IS NOT NULL")).select("sample_id", "weight")
    labelled = labels.join(weights, "sample_id", "left").select("sample_id", "split", "label", "weight")
    # read in each epoch, for choosing it and for scoring: as a table, since each of the many jobs of an epoch would walk a longer lineage
    whole = Scratch(spark, "networks").cut(networks.packed(rows.join(labelled, "sample_id", "left")), "windows")
    labels.unpersist()
    networks.train_packed(net, whole, epochs=epochs)
    return networks.score_packed(net, whole).select("sample_id", "score")


@query()
def sage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph network, trained for a few epochs; scores of all windows."""
    from .models.networks import GraphSAGE

    rows = sequence_table(spark, sf_dir)
    n, e = graph.nodes(rows), graph.edges(rows)
    return _trained_on_all(GraphSAGE(hidden=8), graph.graphs(graph.node_features(n, e), graph.edge_list(n, e)), spark, sf_dir, epochs=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
