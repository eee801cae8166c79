"""Choice among finished runs under declared rules, and the locks that freeze it."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEEDS = (17, 2026)


def finished_runs(spark: SparkSession, root: str) -> DataFrame:
    """The contents of every ``<root>/*/COMPLETE.json`` and its ``path``."""
    return spark.read.option("multiLine", True).json(f"{root}/*/COMPLETE.json").withColumn("path", F.col("_metadata.file_path"))


def best_runs(runs: DataFrame) -> DataFrame:
    """Per model the run of most recall, then least false-positive rate, then first declared (``declared``). Seed repeats play no part."""
    order = Window.partitionBy("model").orderBy(F.desc("recall"), "fpr", "declared")
    return runs.where(~F.col("run_id").rlike(r"_seed\d+$")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sensitivity(runs: DataFrame) -> DataFrame:
    """One row a run, in declared order."""
    return runs.orderBy("model", "declared")


def seed_repeats(configs: list[dict], chosen: list[str], seeds: tuple[int, ...] = SEEDS) -> list[dict]:
    """The chosen runs' settings with other seeds."""
    return [{**c, "run_id": f"{c['run_id']}_seed{s}", "seed": s} for c in configs if c["run_id"] in chosen for s in seeds]


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def freeze(runs: DataFrame, declared: list[str], target: str, files: list[str] | None = None) -> dict:
    """Write the choice as a lock file. Raises if a declared run is missing or the choice is frozen already."""
    path = Path(target)
    if path.exists():
        raise FileExistsError(target)
    done = {r.run_id for r in runs.select("run_id").collect()}
    if missing := [r for r in declared if r not in done]:
        raise ValueError(f"runs are missing: {missing}")
    lock = {"selected": {r.model: r.run_id for r in best_runs(runs).collect()}, "files": {r.path: r.sha256 for r in checksums(runs.sparkSession, files).collect()} if files else {}, "frozen_at": datetime.now(timezone.utc).isoformat()}
    path.write_text(json.dumps(lock, indent=1))
    return lock
