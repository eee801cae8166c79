"""The plans over files."""

import json

import pytest
from pyspark.sql import functions as F

from .test_windows_and_features import recordings

from windlass.__main__ import main
from windlass.operators.cascade import DETECTORS
from windlass.plans import train
from windlass.sources import canonical as source


def test_files_in_files_out(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for split in ("train", "validation", "test"):
        rows = [r for r in recordings() if r["split"] == split]
        text = lambda r: ",".join("" if r[c] is None else str(r[c]) for c in source.COLUMNS)
        for r in rows:
            if r["split_group_id"].endswith("small"):
                r["split_group_id"] = "x" + r["split_group_id"]
        extra = [r | {"split_group_id": f"{split}-bad", "traffic_label": "malicious"} for r in rows if r["split_group_id"] == f"{split}-large"]
        (raw / f"{split}.csv").write_text("\n".join([",".join(source.COLUMNS), *map(text, rows + extra)]) + "\n")
    main(["prepare", "--raw", str(raw), "--output", str(tmp_path / "out")])
    manifest = spark.read.parquet(str(tmp_path / "out/manifest"))
    assert {(r.split, r["count"]) for r in manifest.groupBy("split").count().collect()} == {("train", 4), ("validation", 4), ("test", 4)}
    assert json.loads((tmp_path / "out/channel_scaler.json").read_text())[0]["feature"] == "query_name_len"
    runs = [{"run_id": "rf_a", "model": "rf", "settings": {"trees": 3, "depth": 2, "leaf": 1}}, {"run_id": "rf_b", "model": "rf", "settings": {"trees": 2, "depth": 2, "leaf": 1}}, {"run_id": "if_a", "model": "if", "settings": {"trees": 5, "per_recording": 2}}]
    runs += [{"run_id": f"{m}_a", "model": m, "settings": {"hidden": 3}, "training": {"epochs": 1, "batch": 2}} for m in ("bilstm", "sage")]
    (tmp_path / "runs.json").write_text(json.dumps(runs))
    main(["train", "--prepared", str(tmp_path / "out"), "--output", str(tmp_path / "runs"), "--runs", str(tmp_path / "runs.json"), "--max-fpr", "1.0"])
    lock = json.loads((tmp_path / "runs/selected.json").read_text())
    assert set(lock["selected"]) == set(DETECTORS) and lock["selected"]["rf"] in ("rf_a", "rf_b")
    for m in DETECTORS:
        made = spark.read.parquet(str(tmp_path / f"runs/predictions/{m}"))
        assert made.count() == 12 and made.where("score IS NULL OR prediction NOT IN (0, 1)").count() == 0
        again = train.replay(spark, str(tmp_path / "out"), str(tmp_path / "runs"), lock["selected"][m], m, json.loads((tmp_path / f"runs/{lock['selected'][m]}/COMPLETE.json").read_text())["threshold"]).first()
        assert again.n == 12 and again.max_score_difference < 1e-9 and again.predictions_equal
    written = (tmp_path / "runs/rf_a/COMPLETE.json").stat().st_mtime_ns
    train.train(spark, str(tmp_path / "out"), str(tmp_path / "runs"), [train.Run(**r) for r in runs])
    assert (tmp_path / "runs/rf_a/COMPLETE.json").stat().st_mtime_ns == written  # a run that is complete is not run again
    with pytest.raises(FileExistsError):
        train.select(spark, str(tmp_path / "runs"), [train.Run(**r) for r in runs])
    label = (F.col("traffic_label") == "malicious").cast("int")
    scores = manifest.withColumn("label", label).withColumn("score", F.col("label") * 0.5 + 0.2)
    scores.write.parquet(str(tmp_path / "scores"))
    main(["evaluate", "--scores", str(tmp_path / "scores"), "--output", str(tmp_path / "metrics.json")])
    out = json.loads((tmp_path / "metrics.json").read_text())
    assert out["window_threshold"] == 0.7 and out["test"]["window"][0]["f1"] == 1.0
    for d in DETECTORS:
        scores.withColumn("prediction", F.col("label")).write.parquet(str(tmp_path / f"predictions/{d}"))
    main(["cascade", "--predictions", str(tmp_path / "predictions"), "--features", str(tmp_path / "out/features"), "--output", str(tmp_path / "decisions")])
    assert spark.read.parquet(str(tmp_path / "decisions/decisions")).where("production_prediction = label").count() == 12
