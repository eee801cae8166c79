"""Statistics that must not depend on how they are spread over tasks, and files of every kind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.models.isolation import Isolation
from windlass.models.networks import GraphSAGE
from windlass.models.store import load_model, save_model
from windlass.operators import cascade, drift, evaluation, features, prefix, scaling, selection, windows
from windlass.sources import tables
from windlass.sources.canonical import canonical

from .test_windows_and_features import frame, transaction


def values(seed=0, n=2000):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"k": rng.choice(["a", "b"], n), "x": np.round(rng.normal(size=n), 2), "y": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(1e6, n)), "second": rng.random(n) < 0.3})


def test_percentiles_by_nested_histograms(spark):
    data, at = values(), [0.0, 0.25, 0.5, 0.95, 1.0]
    data.loc[::7, "y"] = np.nan
    data["none"] = np.nan
    df = spark.createDataFrame(data).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "none")})
    for most, buckets in ((1 << 20, 1024), (10, 3), (10, 1024)):
        got = prefix.exact_percentiles(df, {c: F.col(c) for c in ("x", "y", "none")}, at, most=most, buckets=buckets)
        assert got["none"] is None
        for c in ("x", "y"):
            assert got[c] == pytest.approx(np.quantile(data[c].dropna(), at).tolist(), rel=1e-12)
    assert prefix.exact_percentiles(df.limit(0), {"x": F.col("x")}, at) == {"x": None}
    wide = spark.createDataFrame([(v,) for v in (-1.7e308, -1.0, 0.0, 1.0, 1.7e308)], "v double")
    assert prefix.exact_percentiles(wide, {"v": F.col("v")}, [0.25, 0.5, 1.0], most=1) == {"v": [-1.0, 0.0, 1.7e308]}


def test_percentiles_and_tests_within_keys(spark):
    data = values(1)
    df = spark.createDataFrame(data)
    for r in prefix.percentiles_by(df, ["k"], "y", [0.1, 0.5, 0.99]).collect():
        own = data.y[data.k == r.k]
        assert r.n == len(own) and r.q == pytest.approx(np.quantile(own, [0.1, 0.5, 0.99]).tolist(), rel=1e-12)
    ks = {r.k: r for r in drift.ks_statistic(df.select("k", F.col("x").alias("value"), "second"), ["k"]).collect()}
    mwu = {r.k: r for r in drift.mann_whitney(df.select("k", F.col("x").alias("value"), "second"), ["k"]).collect()}
    for k in "ab":
        one, two = (data.x[(data.k == k) & (data.second == s)].to_numpy() for s in (False, True))
        every = np.unique(data.x)
        gaps = [abs((one <= v).mean() - (two <= v).mean()) for v in every]
        assert ks[k].ks == pytest.approx(max(gaps)) and (ks[k].n1, ks[k].n2) == (len(one), len(two))
        assert mwu[k].u == pytest.approx(sum((two > v).sum() + 0.5 * (two == v).sum() for v in one))


def test_hot_recordings_give_the_same_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(g, None if rng.random() < 0.05 else float(rng.integers(0, 60)), k) for k, g in enumerate(["hot"] * 500 + ["small"] * 9 + [None] * 3)]
    df = spark.createDataFrame(rows, "split_group_id string, request_timestamp double, ingest_seq long")
    one, many = (sorted(map(repr, scaling.recording_iat(df, large=large).select("ingest_seq", "interarrival_time").collect())) for large in (False, True))
    assert one == many
    assert windows.is_large(df, "split_group_id", hot=400, counted=0) and not windows.is_large(df, "split_group_id", hot=500, counted=0)
    assert not windows.is_large(df.limit(0), "split_group_id", counted=0)


def test_types_keep_their_blanks(spark):
    raw = [transaction("blank", k, query_type=q, dns_rcode="noerror") for k, q in enumerate([" TXT", "txt", None, "A"] * 10)]
    w = windows.recording_windows(canonical(frame(spark, raw)))
    got = features.window_features(w, similarity=False, names=features.QTYPE + features.RCODE).first()
    assert (got.qtype_txt_ratio, got.qtype_other_ratio, got.qtype_null_ratio, got.rcode_noerror_ratio) == (0.25, 0.25, 0.25, 1.0)


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfname,n\nx,1\n")
    assert tables.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["name", "n"]
    log = str(tmp_path / "log")
    for k in range(2):
        tables.append_csv(spark.createDataFrame([(k, "v")], "k int, v string"), log)
    assert sorted(r.k for r in tables.read_csv(spark, log, "k int, v string").collect()) == [0, 1]
    with pytest.raises(ValueError, match="has columns"):
        tables.append_csv(spark.createDataFrame([(1,)], "other int"), log)
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert selection.checksums(spark, [str(tmp_path / "a.bin")]).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    rows = spark.createDataFrame([("s1", [[1.5, 2.0], [3.0, 4.0]], [1, 2]), ("s2", [[0.0, 0.5], [9.0, 1.0]], [3, 4])], "sample_id string, x array<array<double>>, ids array<long>")
    assert sum(r.rows for r in tables.write_npz(rows.repartition(2), f"file://{tmp_path}/npz", ["x", "ids"]).collect()) == 2
    back = tables.read_npz(spark, f"{tmp_path}/npz", "sample_id string, x array<array<double>>, ids array<long>")
    assert sorted(back.collect()) == sorted(rows.collect())
    with pytest.raises(FileExistsError):
        tables.guard_output(log, [], spark)


def test_models_come_back_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    net = GraphSAGE(hidden=3, pooling="mean_max")
    save_model(spark, net, f"{tmp_path}/net")
    again = load_model(spark, f"{tmp_path}/net")
    assert again.pooling == "mean_max" and all(np.array_equal(v.value, again.p[k].value) for k, v in net.p.items())
    from windlass.models.isolation import _tree

    model = Isolation(["a", "b"], {"a": 0.0, "b": 1.0}, [_tree(rng.normal(size=(n, 2)), rng) for n in (5, 9)], 9)
    save_model(spark, model, f"{tmp_path}/forest")
    x = rng.normal(size=(20, 2))
    assert np.array_equal(load_model(spark, f"{tmp_path}/forest").score(x), model.score(x))


def test_errors_and_disagreements_carry_features(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("b", 0, 1, 0), ("c", 1, 0, 0)], "sample_id string, label int, prediction int, other_prediction int")
    feats = spark.createDataFrame([("a", 1.0, 9), ("b", 2.0, 9), ("c", 3.0, 9), ("d", 4.0, 9)], "sample_id string, f double, label int")
    got = {r.sample_id: (r.error_type, r.f, r.label) for r in cascade.errors_with_features(rows, feats).collect()}
    assert got == {"b": ("false_positive", 2.0, 0), "c": ("false_negative", 3.0, 1)}
    apart = cascade.disagreements_with_features(rows.withColumnRenamed("prediction", "one_prediction"), feats)
    assert [(r.sample_id, r.f) for r in apart.collect()] == [("b", 2.0)]
    assert [r.v for r in rows.orderBy("sample_id").select(cascade.mapped(F.col("sample_id"), {"a": "x", "b": "y"}).alias("v")).collect()] == ["x", "y", None]


def test_core_rule_train_fit_and_one_window(spark):
    tests = spark.createDataFrame([("f", 0.01, 0.5), ("g", 0.2, 0.9), ("h", 0.01, -0.1), ("i", 0.04, -0.3)], "feature string, holm_p double, delta double")
    assert sorted(r.feature for r in drift.feature_core(tests).collect()) == ["f", "i"]
    scored = spark.createDataFrame([("train", 1, 0.9), ("train", 0, 0.1), ("test", 0, 0.9)], "split string, label int, score double")
    fit = evaluation.train_fit(scored, 0.5).first()
    assert (fit.n, fit.recall, fit.fpr) == (2, 1.0, 0.0)
    rows = spark.createDataFrame([("g", w, p) for w in range(2) for p in (1, 0)] + [("h", 1, 0)], "split_group_id string, window_number long, pos int")
    assert [r.pos for r in windows.one_window(rows, "g", 1).collect()] == [0, 1]
    runs = spark.createDataFrame([("rf", 1, "b"), ("rf", 0, "a"), ("if", 0, "c")], "model string, declared int, run_id string")
    assert [r.run_id for r in selection.sensitivity(runs).collect()] == ["c", "a", "b"]
