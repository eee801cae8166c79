"""Sinks with guards, and logs that are only appended to."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    """A path, with its file system's scheme, and that file system: whatever Spark itself can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def guard_output(output: str, inputs: list[str], spark: SparkSession | None = None) -> None:
    """Raise if the output exists or lies inside an input, on any file system of the session's."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no session to look with")
    out, fs = _hadoop(spark, output)
    if fs.exists(out):
        raise FileExistsError(output)
    for i in inputs:
        inside = _hadoop(spark, i)[0].toString().rstrip("/")
        if out.toString().rstrip("/") == inside or out.toString().startswith(inside + "/"):
            raise ValueError(f"{output} is inside {i}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written over."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    p, fs = _hadoop(spark, path)
    found = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(found))
    finally:
        found.close()


def append_csv(df: DataFrame, path: str) -> None:
    """Rows for a folder of CSV files, each with the header, which :func:`read_csv` takes once; other columns than before raise."""
    spark = df.sparkSession
    p, fs = _hadoop(spark, path)
    if fs.exists(p) and (before := read_csv(spark, path).columns) != df.columns:
        raise ValueError(f"{path} has columns {before}")
    df.write.mode("append").option("header", True).csv(path)


def write_npz(df: DataFrame, path: str, tensors: list[str], *, key: str = "sample_id") -> DataFrame:
    """One NPZ file a partition with the key and the tensors stacked; ``file, rows`` of each.

    All rows of a tensor column must have one shape. A task that runs again writes its file
    over; the table returned must be read for the files to be written.
    """
    from pyspark import TaskContext

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows = [r for b in it for r in b.to_pylist()]
        if rows:
            system, root = fs.FileSystem.from_uri(path)
            system.create_dir(root, recursive=True)
            name, out = f"part-{TaskContext.get().partitionId():05d}.npz", io.BytesIO()
            np.savez_compressed(out, **{key: np.array([r[key] for r in rows])}, **{t: np.array([r[t] for r in rows]) for t in tensors})
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(out.getvalue())
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([len(rows)], pa.int64())})

    return df.select(key, *tensors).mapInArrow(write, "file string, rows long")


def read_npz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of NPZ files whose arrays are the columns of ``schema``, along their first axis."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b["content"].to_pylist():
                with np.load(io.BytesIO(data)) as f:
                    yield pa.RecordBatch.from_pydict({n: pa.array(f[n].tolist()) for n in names})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return found.select("content").mapInArrow(read, schema)


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, format: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(format).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Small reference tables; a byte-order mark is no part of the header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, key: str, order: str, schema: str | None = None) -> DataFrame:
    """A JSON-lines log; of each key the entry last in order."""
    log = (spark.read.schema(schema) if schema else spark.read).json(path)
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), order).alias("_")).select(key, "_.*")


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def write_json(path: str, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=1, default=str))


def is_complete(run: str) -> bool:
    """Whether a run left its marker; a run that has one is not run again."""
    return (Path(run) / "COMPLETE.json").exists()


def mark_complete(run: str, metrics: dict) -> None:
    Path(run).mkdir(parents=True, exist_ok=True)
    write_json(str(Path(run) / "COMPLETE.json"), metrics)
