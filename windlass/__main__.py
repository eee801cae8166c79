"""python -m windlass prepare | train | evaluate | cascade: the plans over files."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

SPLITS = ("train", "validation", "test", "external_test")


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """CSV files <raw>/<split>.csv (or folders of that name) to tables by split."""
    from .plans import prepare as plan

    found = {s: str(p) for s in SPLITS for p in (Path(a.raw) / f"{s}.csv", Path(a.raw) / s) if p.exists()}
    plan.write(plan.from_csv(spark, found, column_map=json.loads(Path(a.column_map).read_text()) if a.column_map else None), a.output, [a.raw])


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prepared tables to detectors, a frozen choice, and predictions of all splits; --runs is a JSON list of runs."""
    from .plans import train as plan

    runs = [plan.Run(**r) for r in json.loads(Path(a.runs).read_text())] if a.runs else plan.DEFAULT
    plan.train(spark, a.prepared, a.output, runs, max_fpr=a.max_fpr)
    plan.select(spark, a.output, runs)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Thresholds from the validation scores, then metrics, strata and intervals of the others, as JSON."""
    from .plans import evaluate as plan

    scores = spark.read.parquet(a.scores)
    window, recording = plan.thresholds(scores.where("split = 'validation'"), a.max_fpr)
    out = {"window_threshold": window, "recording_threshold": recording}
    for split in (r.split for r in scores.select("split").distinct().orderBy("split").collect()):
        e = plan.evaluate(scores.where(scores.split == split), window, recording)
        out[split] = {k: [r.asDict() for r in df.collect()] for k, df in vars(e).items()}
    Path(a.output).write_text(json.dumps(out, indent=1))


def cascade(spark: SparkSession, a: argparse.Namespace) -> None:
    """Predictions <predictions>/<rf|if|bilstm|sage> and features to decisions, log and counters."""
    from .operators.cascade import DETECTORS, http_arbitrator, offline_arbitrator
    from .plans import cascade as plan

    features = spark.read.parquet(a.features)
    ask = http_arbitrator(a.endpoint, system=Path(a.system).read_text()) if a.endpoint else offline_arbitrator
    out = plan.decide({d: spark.read.parquet(f"{a.predictions}/{d}") for d in DETECTORS}, features, features.where("split = 'train'"), arbitrator=ask)
    out.rows.write.parquet(f"{a.output}/decisions")
    out.log.write.json(f"{a.output}/log")
    out.counters.write.json(f"{a.output}/counters")
    out.comparison.write.json(f"{a.output}/comparison")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="windlass", description=__doc__)
    sub = parser.add_subparsers(required=True)
    for f, options in ((prepare, ("raw", "output")), (train, ("prepared", "output")), (evaluate, ("scores", "output")), (cascade, ("predictions", "features", "output"))):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        if f is prepare:
            p.add_argument("--column-map")
        if f is train:
            p.add_argument("--runs")
        if f in (train, evaluate):
            p.add_argument("--max-fpr", type=float, default=0.01)
        if f is cascade:
            p.add_argument("--endpoint")
            p.add_argument("--system", help="file with the arbitrator's instructions")
    a = parser.parse_args(argv)
    a.run(SparkSession.builder.appName("windlass").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
