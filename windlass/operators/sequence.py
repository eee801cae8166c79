"""Fixed-length sequences of scaled transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .scaling import CHANNELS, scaled
from .windows import SIZE

# Ids of query types and response codes; 0 pads, 1 is anything else.
QTYPE_IDS = {"A": 2, "AAAA": 3, "CNAME": 4, "TXT": 5, "MX": 6, "NULL": 7, "PRIVATE": 8, "NS": 9, "SOA": 10, "PTR": 11, "KEY": 12, "SRV": 13, "SVCB": 14, "HTTPS": 15, "ANY": 16}
RCODE_IDS = {"NOERROR": 2, "NXDOMAIN": 3, "SERVFAIL": 4, "REFUSED": 5, "FORMERR": 6, "NOTIMP": 7, "NULL": 8}
UNKNOWN = 1


def vocabulary_id(value: Column, ids: dict[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in ids.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(table, F.coalesce(F.upper(value), F.lit(""))), F.lit(UNKNOWN)).cast("short")


def sequence_rows(windowed: DataFrame, scaler: list[dict]) -> DataFrame:
    """A row a transaction: keys, its scaled channels, ``qtype_id`` and ``rcode_id``.

    The first row of a window has a gap of 0 (which is then scaled); an invalid or negative
    gap and any other missing value become 0 after scaling.
    """
    ts = finite(F.col("request_timestamp"))
    gap = ts - F.lag(ts).over(Window.partitionBy("split_group_id", "window_number").orderBy("pos"))
    rows = windowed.withColumn("interarrival_time", F.when(F.col("pos") == 0, F.lit(0.0)).when(gap >= 0, gap)).withColumn("is_response_missing", F.coalesce(finite(F.col("is_response_missing")), F.lit(0.0)))
    by = {r["feature"]: r for r in scaler}
    channels = [scaled(F.col(c), by[c]).alias(f"x_{c}") for c in CHANNELS]
    keys = ["sample_id", "split", "split_group_id", "window_number", "pos", "window_tx_count", "client_ip", "server_ip", "base_domain", "subdomain", "query_type"]
    return rows.select(*keys, *channels, vocabulary_id(F.col("query_type"), QTYPE_IDS).alias("qtype_id"), vocabulary_id(F.col("dns_rcode"), RCODE_IDS).alias("rcode_id"))


def sequences(rows: DataFrame, *, size: int = SIZE) -> DataFrame:
    """A row a window: ``continuous`` (size x channels), ``qtype_id``, ``rcode_id``, ``mask``, ``length``; padded with zeros."""
    item = F.struct("pos", F.array(*(F.col(f"x_{c}") for c in CHANNELS)).alias("x"), "qtype_id", "rcode_id")
    out = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    n = F.size("s")
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(CHANNELS)), size - n)
    ids = lambda c: F.concat(F.col(f"s.{c}"), F.array_repeat(F.lit(0).cast("short"), size - n)).alias(c)
    mask = F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), size - n))
    return out.select("sample_id", F.concat("s.x", zeros).alias("continuous"), ids("qtype_id"), ids("rcode_id"), mask.alias("mask"), n.alias("length"))


def mask_length(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x))
