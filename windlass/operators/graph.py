"""Typed entity graphs of windows, as node and edge tables keyed by ``sample_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds, edge types, and the channels that describe nodes and edges.
KINDS = ["client", "server", "base", "subdomain"]
#: Edge type: kinds of its ends.
EDGE_TYPES = [("client", "server"), ("client", "base"), ("base", "subdomain")]
MISSING = "<missing>"
NODE_CHANNELS = ["query_name_len", "subdomain_len", "query_entropy", "total_transaction_bytes", "is_response_missing"]
EDGE_CHANNELS = ["total_transaction_bytes", "req_resp_time_diff"]
TUNNEL_TYPES = ["TXT", "NULL", "PRIVATE", "CNAME"]


def _entities() -> dict[str, Column]:
    """A row's entity of each kind; an empty or missing subdomain is none."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING))
    return {"client": named("client_ip"), "server": named("server_ip"), "base": named("base_domain"), "subdomain": F.nullif(F.col("subdomain"), F.lit(""))}


def nodes(rows: DataFrame) -> DataFrame:
    """``sample_id, node_id, kind, key`` and the node's features, from :func:`sequence_rows`.

    A node is a (kind, key) of a window; ids follow first appearance, and within a row the
    order of KINDS. Rows are exploded to their four entities at most and aggregated once;
    degrees come from :func:`degrees`.
    """
    qtype = F.upper(F.coalesce("query_type", F.lit("")))
    each = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), key.alias("key")) for k, (kind, key) in enumerate(_entities().items())))
    long = rows.withColumn("_t", qtype).withColumn("e", F.explode(each)).where("e.key IS NOT NULL")
    n = F.count("*")
    out = long.groupBy("sample_id", "e.kind", "e.key").agg(
        F.min(F.col("pos") * len(KINDS) + F.col("e.rank")).alias("first"), n.alias("transactions"), (n / F.first("window_tx_count")).alias("activity_ratio"), *(F.avg(f"x_{c}").alias(f"mean_{c}") for c in NODE_CHANNELS),
        F.avg((F.col("_t") == "A").cast("double")).alias("a_share"), F.avg(F.col("_t").isin(TUNNEL_TYPES).cast("double")).alias("tunnel_share"),
    )
    return out.withColumn("node_id", F.row_number().over(Window.partitionBy("sample_id").orderBy("first")) - 1).drop("first")


def edges(rows: DataFrame) -> DataFrame:
    """``sample_id, type, src_kind, src_key, dst_kind, dst_key`` and the edge's features; each typed edge once."""
    e = _entities()
    each = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("src_kind"), e[a].alias("src_key"), F.lit(b).alias("dst_kind"), e[b].alias("dst_key")) for t, (a, b) in enumerate(EDGE_TYPES)))
    long = rows.withColumn("e", F.explode(each)).where("e.dst_key IS NOT NULL")
    n = F.count("*")
    return long.groupBy("sample_id", "e.type", "e.src_kind", "e.src_key", "e.dst_kind", "e.dst_key").agg(n.alias("transactions"), (n / F.first("window_tx_count")).alias("interaction_ratio"), *(F.avg(f"x_{c}").alias(f"mean_{c}") for c in EDGE_CHANNELS))


def symmetric(edge: DataFrame) -> DataFrame:
    """Both directions of every edge, with equal features."""
    swap = {"src_kind": "dst_kind", "src_key": "dst_key", "dst_kind": "src_kind", "dst_key": "src_key"}
    return edge.unionByName(edge.select(*(F.col(swap.get(c, c)).alias(c) for c in edge.columns)))


def degrees(edge: DataFrame) -> DataFrame:
    """``sample_id, kind, key, degree``: distinct typed edges that touch a node."""
    ends = F.array(F.struct(F.col("src_kind").alias("kind"), F.col("src_key").alias("key")), F.struct(F.col("dst_kind").alias("kind"), F.col("dst_key").alias("key")))
    return edge.select("sample_id", F.explode(ends).alias("n")).groupBy("sample_id", "n.kind", "n.key").agg(F.count("*").alias("degree"))


def node_features(node: DataFrame, edge: DataFrame) -> DataFrame:
    """The 13 node features: kind (4), activity, five means, degree ratio, two shares."""
    size = F.count(F.lit(1)).over(Window.partitionBy("sample_id"))
    out = node.join(degrees(edge), ["sample_id", "kind", "key"], "left").withColumn("degree_ratio", F.coalesce("degree", F.lit(0)) / F.greatest(size - 1, F.lit(1)))
    kinds = [(F.col("kind") == k).cast("double").alias(f"is_{k}") for k in KINDS]
    return out.select("sample_id", "node_id", "kind", "key", *kinds, "activity_ratio", *(f"mean_{c}" for c in NODE_CHANNELS), "degree_ratio", "a_share", "tunnel_share")


NODE_FEATURES = [f"is_{k}" for k in KINDS] + ["activity_ratio"] + [f"mean_{c}" for c in NODE_CHANNELS] + ["degree_ratio", "a_share", "tunnel_share"]
EDGE_FEATURES = [f"is_type_{t}" for t in range(len(EDGE_TYPES))] + ["interaction_ratio"] + [f"mean_{c}" for c in EDGE_CHANNELS]


def edge_list(node: DataFrame, edge: DataFrame) -> DataFrame:
    """``sample_id, src, dst, type`` and the 6 edge features, both directions, by node id."""
    ids = node.select("sample_id", "kind", "key", "node_id")
    src, dst = ids.toDF("sample_id", "src_kind", "src_key", "src"), ids.toDF("sample_id", "dst_kind", "dst_key", "dst")
    out = symmetric(edge).join(src, ["sample_id", "src_kind", "src_key"]).join(dst, ["sample_id", "dst_kind", "dst_key"])
    types = [(F.col("type") == t).cast("double").alias(f"is_type_{t}") for t in range(len(EDGE_TYPES))]
    return out.select("sample_id", "src", "dst", "type", *types, "interaction_ratio", *(f"mean_{c}" for c in EDGE_CHANNELS))


def mean_neighbours(edge: DataFrame, node: DataFrame, columns: list[str]) -> DataFrame:
    """``sample_id, node_id`` and the means of ``columns`` over the sources of edges into the node; an isolated node has none."""
    src = node.select("sample_id", F.col("node_id").alias("src"), *columns)
    return edge.select("sample_id", "src", "dst").join(src, ["sample_id", "src"]).groupBy("sample_id", F.col("dst").alias("node_id")).agg(*(F.avg(c).alias(c) for c in columns))


def readout(node: DataFrame, columns: list[str], *, maximum: bool = False) -> DataFrame:
    """Per graph means, and maxima if wanted."""
    return node.groupBy("sample_id").agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.max(c).alias(f"max_{c}") for c in columns if maximum))


def graphs(node: DataFrame, edge: DataFrame) -> DataFrame:
    """A row a window: ``nodes`` (features by node id) and ``edges`` (src, dst, features)."""
    vector = lambda columns: F.array(*(F.col(c).cast("float") for c in columns))
    n = node.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("node_id", vector(NODE_FEATURES).alias("x")))).alias("nodes"))
    e = edge.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", vector(EDGE_FEATURES).alias("x")))).alias("edges"))
    return n.join(e, "sample_id", "left")


