"""Count windows over a stream."""

import time

from windlass.streaming.count_windows import stream_count_windows


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "split_group_id string, request_timestamp double, ingest_seq long, value double"
    source = str(tmp_path / "in")
    for batch in range(2):
        rows = [(g, float(k), k, float(k)) for g, n in (("a", 10), ("b", 3)) for k in range(batch * n, (batch + 1) * n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = stream_count_windows(stream, size=8, least=4, quiet_ms=1000).writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        deadline = time.time() + 90  # processing-time timers keep the query busy, so it never has processed all
        while time.time() < deadline and spark.table("windows_out").count() < 4:
            time.sleep(1)
        got = {(r.split_group_id, r.window_number, r.window_tx_count) for r in spark.table("windows_out").collect()}
    finally:
        query.stop()
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert got == {("a", 0, 8), ("a", 1, 8), ("a", 2, 4), ("b", 0, 6)}
