"""Canonical transaction tables: schema, adapters, validation, and a view over the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexical as lx

# The canonical columns.
TEXT = ["split_group_id", "traffic_label", "source_name", "tool_label", "scenario_type", "evaluation_subset", "base_domain", "subdomain", "query_name_normalized", "query_type", "dns_rcode", "client_ip", "server_ip"]
NUMBERS = [
    "request_timestamp", "query_name_len", "subdomain_len", "num_labels", "max_label_len", "long_consonant_string_count", "query_entropy", "longest_subdomain_entropy",
    "req_resp_time_diff", "total_transaction_bytes", "request_payload_len", "response_payload_len", "request_len", "response_len", "is_response_missing",
]
COLUMNS = TEXT + NUMBERS
#: Everything as text: numbers are coerced at use, and identifiers such as "007" stay as they are.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def read_transactions(spark: SparkSession, path: str, *, format: str = "csv", column_map: dict[str, str] | None = None, null_value: str = "") -> DataFrame:
    """Scan raw transactions; only columns that a query uses are parsed.

    CSV is read with a header and every column as text. ``null_value`` is what stands
    for NULL ("" by default, so the literal texts NULL and NA stay values).
    """
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).option("nullValue", null_value).option("enforceSchema", False)
    return adapt(reader.format(format).load(path), column_map)


def adapt(df: DataFrame, column_map: dict[str, str] | None = None) -> DataFrame:
    """Vendor names to canonical ones; a partial map is allowed."""
    return df.withColumnsRenamed(column_map or {})


def column_names(spark: SparkSession, path: str, format: str = "csv") -> list[str]:
    """The header alone."""
    return spark.read.format(format).option("header", True).load(path).columns


def canonical(df: DataFrame, column_map: dict[str, str] | None = None) -> DataFrame:
    """Adapt, check and project to the canonical columns plus ``ingest_seq`` and, if there, ``split``.

    A column that is missing raises at once. A null recording key or a label other than
    benign or malicious (in any case) raises when the rows are read: the checks are part
    of the scan and cost no pass. Rows without ``ingest_seq`` are numbered in scan order.
    """
    df = adapt(df, column_map)
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    label = F.lower("traffic_label")
    checked = {
        "split_group_id": F.when(F.col("split_group_id").isNull(), F.raise_error(F.lit("split_group_id is null"))).otherwise(F.col("split_group_id").cast("string")),
        "traffic_label": F.when(label.isin("benign", "malicious"), label).otherwise(F.raise_error(F.concat(F.lit("unknown traffic_label: "), F.coalesce(label, F.lit("null"))))),
    }
    seq = F.col("ingest_seq").cast("long") if "ingest_seq" in df.columns else F.monotonically_increasing_id()
    text = [checked.get(c, F.col(c).cast("string")).alias(c) for c in TEXT]
    numbers = [F.col(c).try_cast("double").alias(c) for c in NUMBERS]
    more = [F.col("split")] if "split" in df.columns else []
    return df.select(*text, *numbers, seq.alias("ingest_seq"), *more)


def require_rows(df: DataFrame) -> DataFrame:
    """The same rows; raises if there are none."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def split_leaks(df: DataFrame) -> DataFrame:
    """Recordings that occur in more than one split: ``split_group_id, splits``."""
    return df.groupBy("split_group_id").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def label_conflicts(df: DataFrame) -> DataFrame:
    """Recordings with more than one label: ``split_group_id, labels``."""
    return df.groupBy("split_group_id").agg(F.count_distinct("traffic_label").alias("labels")).where("labels > 1")


def require_sound_splits(df: DataFrame) -> DataFrame:
    """The same rows; raises if a recording is in two splits or has two labels (one aggregation)."""
    bad = df.groupBy("split_group_id").agg(F.count_distinct("split").alias("s"), F.count_distinct("traffic_label").alias("l")).where("s > 1 OR l > 1").limit(1).collect()
    if bad:
        raise ValueError(f"Recording leakage: {bad[0].split_group_id}" if bad[0].s > 1 else f"Mixed labels: {bad[0].split_group_id}")
    return df


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical view over ``events`` and ``pages``: each event is a transaction on one page's host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("html_len"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    host = lx.host_of(F.col("url"))
    joined = events.withColumn("page_id", F.col("event_id") % pages.count()).join(pages, "page_id").withColumn("host", host)
    kind, user = F.col("event_type"), F.col("user_id")
    fold = user % 10
    sub, url_len, html_len = lx.subdomain(F.col("host")), F.length("url"), F.col("html_len")
    text = lambda prefix, k: F.concat(F.lit(prefix), (user % k).cast("string"))
    return joined.select(
        user.cast("string").alias("split_group_id"), F.when(user % 2 == 1, "malicious").otherwise("benign").alias("traffic_label"), text("source_", 3).alias("source_name"), text("tool_", 4).alias("tool_label"), text("scenario_", 5).alias("scenario_type"),
        F.when(user % 3 != 0, text("subset_", 3)).alias("evaluation_subset"), lx.base_domain(F.col("host")).alias("base_domain"), sub.alias("subdomain"), F.col("host").alias("query_name_normalized"),
        F.when(kind == "click", "A").when(kind == "view", "AAAA").when(kind == "purchase", "TXT").when(kind == "signup", "CNAME").alias("query_type"),
        F.when(kind == "error", "NXDOMAIN").when(F.col("value") > 300, "SERVFAIL").otherwise("NOERROR").alias("dns_rcode"), F.concat(F.lit("c"), user.cast("string")).alias("client_ip"), F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")).alias("server_ip"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("request_timestamp"), F.length("host").cast("double").alias("query_name_len"), F.length(sub).cast("double").alias("subdomain_len"), F.size(F.split("host", "[.]")).cast("double").alias("num_labels"),
        lx.longest_label(F.col("host")).cast("double").alias("max_label_len"), lx.consonant_runs(F.col("host")).cast("double").alias("long_consonant_string_count"), lx.entropy(F.col("host")).alias("query_entropy"), lx.entropy(sub).alias("longest_subdomain_entropy"),
        F.when(kind != "error", F.col("value") / 1000.0).alias("req_resp_time_diff"), (url_len + html_len).cast("double").alias("total_transaction_bytes"), (url_len - 12).cast("double").alias("request_payload_len"), (html_len - 12).cast("double").alias("response_payload_len"),
        url_len.cast("double").alias("request_len"), html_len.cast("double").alias("response_len"), (kind == "error").cast("double").alias("is_response_missing"), F.col("event_id").alias("ingest_seq"),
        F.when(fold <= 4, "train").when(fold.isin(6, 7), "validation").when(fold.isin(5, 8), "test").otherwise("external_test").alias("split"),
    )


#: The same view in SQL for DuckDB, as a list of common table expressions.
EVENTS_SQL = r"""
canon0 AS (
  SELECT e.*, p.url, length(p.html) AS html_len, p.page_id, lower(regexp_extract(p.url, '^https?://([^/:?#]+)', 1)) AS host
  FROM (SELECT e0.*, e0.event_id % n.n AS pid FROM events e0, (SELECT count(*) AS n FROM pages) n) e JOIN pages p ON p.page_id = e.pid),
canon1 AS (SELECT *, string_split(host, '.') AS labels FROM canon0),
canon2 AS (SELECT *, array_to_string(labels[greatest(len(labels) - 1, 1):], '.') AS base_domain, array_to_string(labels[1:greatest(len(labels) - 2, 0)], '.') AS subdomain FROM canon1),
canon AS (
  SELECT cast(user_id AS VARCHAR) AS split_group_id, CASE WHEN user_id % 2 = 1 THEN 'malicious' ELSE 'benign' END AS traffic_label,
    'source_' || (user_id % 3) AS source_name, 'tool_' || (user_id % 4) AS tool_label, 'scenario_' || (user_id % 5) AS scenario_type, CASE WHEN user_id % 3 <> 0 THEN 'subset_' || (user_id % 3) END AS evaluation_subset,
    base_domain, subdomain, host AS query_name_normalized,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'AAAA' WHEN 'purchase' THEN 'TXT' WHEN 'signup' THEN 'CNAME' END AS query_type,
    CASE WHEN event_type = 'error' THEN 'NXDOMAIN' WHEN value > 300 THEN 'SERVFAIL' ELSE 'NOERROR' END AS dns_rcode,
    'c' || user_id AS client_ip, 's' || (page_id % 7) AS server_ip, epoch_us(ts) / 1e6::DOUBLE AS request_timestamp,
    length(host)::DOUBLE AS query_name_len, length(subdomain)::DOUBLE AS subdomain_len, len(labels)::DOUBLE AS num_labels, list_max(list_transform(labels, lambda x: length(x)))::DOUBLE AS max_label_len,
    len(regexp_extract_all(host, '[bcdfghjklmnpqrstvwxyz]{4,}'))::DOUBLE AS long_consonant_string_count,
    coalesce(list_sum(list_transform(list_sort(list_distinct(string_split(host, ''))), lambda c: -(len(list_filter(string_split(host, ''), lambda x: x = c)) / length(host)::DOUBLE) * log2(len(list_filter(string_split(host, ''), lambda x: x = c)) / length(host)::DOUBLE))), 0) AS query_entropy,
    CASE WHEN length(subdomain) = 0 THEN 0 ELSE list_sum(list_transform(list_sort(list_distinct(string_split(subdomain, ''))), lambda c: -(len(list_filter(string_split(subdomain, ''), lambda x: x = c)) / length(subdomain)::DOUBLE) * log2(len(list_filter(string_split(subdomain, ''), lambda x: x = c)) / length(subdomain)::DOUBLE))) END AS longest_subdomain_entropy,
    CASE WHEN event_type <> 'error' THEN value / 1000.0::DOUBLE END AS req_resp_time_diff, (length(url) + html_len)::DOUBLE AS total_transaction_bytes, (length(url) - 12)::DOUBLE AS request_payload_len,
    (html_len - 12)::DOUBLE AS response_payload_len, length(url)::DOUBLE AS request_len, html_len::DOUBLE AS response_len, (event_type = 'error')::INT::DOUBLE AS is_response_missing, event_id AS ingest_seq,
    CASE WHEN user_id % 10 <= 4 THEN 'train' WHEN user_id % 10 IN (6, 7) THEN 'validation' WHEN user_id % 10 IN (5, 8) THEN 'test' ELSE 'external_test' END AS split
  FROM canon2)"""
