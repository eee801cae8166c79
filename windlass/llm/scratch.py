"""Tables in the folder that all executors share.

Operators cut lineage by writing a Parquet table there and reading it back: the
files outlive any executor, and a lost task re-reads them instead of computing
its ancestors again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="windlass-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: While an operator runs a job of its own: small Arrow batches, and no shuffle files left behind.
RUN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


_lock, _users, _before = threading.Lock(), Counter(), {}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; where several threads ask for them, they stay until the last is done."""
    with _lock:
        for k, v in values.items():
            if not _users[k, v]:
                _before[k, v] = spark.conf.get(k, None)
                spark.conf.set(k, v)
            _users[k, v] += 1
    try:
        yield
    finally:
        with _lock:
            for k, v in values.items():
                _users[k, v] -= 1
                if not _users[k, v]:
                    before = _before.pop((k, v))
                    spark.conf.unset(k) if before is None else spark.conf.set(k, before)


_made: ContextVar[list["Scratch"] | None] = ContextVar("made", default=None)


@contextmanager
def collected() -> Iterator[list["Scratch"]]:
    """All folders that this thread's operators open inside."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


class Scratch:
    """One operator call's folder under :func:`shared_root`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/windlass/{name}-{uuid.uuid4().hex}"
        if (made := _made.get()) is not None:
            made.append(self)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back; its shuffle files go once it is written."""
        path = f"{self.path}/{tag}"
        with settings(self.spark, RUN):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tag: str = "") -> None:
        """Remove one table, or all of them: only once no DataFrame in use reads it."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tag}" if tag else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
