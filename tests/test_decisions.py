"""Metrics, cascade, samples, drift, selection and intervals."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.functions import tails
from windlass.operators import cascade, drift, evaluation, metrics, sampling, selection
from windlass.operators.prefix import running_sums
from windlass.plans import cascade as cascade_plan
from windlass.plans import evaluate as evaluate_plan
from windlass.sources import tables


def scores(spark, labels, values, groups=None):
    return spark.createDataFrame([(f"s{k:04d}", f"g{g}", int(y), float(s), "src", None, "t") for k, (y, s, g) in enumerate(zip(labels, values, groups or range(len(labels))))], "sample_id string, split_group_id string, label int, score double, source_name string, evaluation_subset string, tool_label string")


def test_threshold_respects_ties_and_rate(spark):
    df = scores(spark, [0] * 100 + [1] * 20, [0.1] * 99 + [0.8] + [0.8] * 10 + [0.9] * 10)
    t = metrics.threshold_at_fpr(df).first()
    assert (t.threshold, t.recall, t.fpr) == (0.8, 1.0, 0.01)
    t = metrics.threshold_at_fpr(df, 0.0).first()
    assert (t.threshold, t.recall) == (0.9, 0.5)
    worst = metrics.threshold_at_fpr(scores(spark, [1, 0], [0.1, 0.9]), 0.0).first()
    assert worst.threshold == math.nextafter(0.9, math.inf) and worst.recall == 0.0
    with pytest.raises(ValueError):
        metrics.choose_threshold(df.where("label = 1"))


def test_missing_classes_are_null(spark):
    m = metrics.binary_metrics(metrics.predicted(scores(spark, [1, 1], [0.2, 0.9]), 0.5)).first()
    assert (m.recall, m.fpr, m.f1, m.precision, m.accuracy) == (0.5, None, None, None, None)
    m = metrics.binary_metrics(metrics.predicted(scores(spark, [0, 0], [0.2, 0.9]), 0.5)).first()
    assert (m.recall, m.fpr, m.specificity, m.f1) == (None, 0.5, 0.5, None)
    assert metrics.auroc(scores(spark, [1, 1], [0.2, 0.9])).first().auroc is None
    assert metrics.average_precision(scores(spark, [1, 1], [0.2, 0.9])).first().auprc is None
    empty = metrics.binary_metrics(metrics.predicted(scores(spark, [0, 1], [0.1, 0.2]), 0.5)).first()
    assert (empty.precision, empty.f1, empty.mcc) == (0.0, 0.0, 0.0)


def test_published_figures(spark):
    counts = spark.createDataFrame([(1179, 0, 4, 1156)], "tn long, fp long, fn long, tp long")
    m = metrics.with_ratios(counts).first()
    assert (round(m.recall, 6), round(m.f1, 6), round(m.mcc, 6)) == (0.996552, 0.998273, 0.996585)
    df = scores(spark, [0] * 1179 + [1] * 1160, [0] * 1178 + [1] + [0] + [1] * 1159)
    assert metrics.auroc(df).first().auroc == pytest.approx(0.9991448773068936)
    assert metrics.average_precision(df).first().auprc == pytest.approx(0.9987041383656847)
    assert tails.exact_interval(15, 15) == pytest.approx((0.78198, 1.0), abs=1e-5)
    assert tails.exact_interval(0, 11) == pytest.approx((0.0, 0.28491), abs=1e-5)
    assert tails.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)


def test_curves_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = scores(spark, y, s)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert metrics.auroc(df).first().auroc == pytest.approx(np.mean(pairs))
    ap, last = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp = ((s >= t) & (y == 1)).sum()
        ap += (tp - last) / y.sum() * tp / (s >= t).sum()
        last = tp
    assert metrics.average_precision(df).first().auprc == pytest.approx(ap)


def test_running_sums(spark):
    rng = np.random.default_rng(7)
    x = rng.permutation(500)
    v = rng.integers(0, 9, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, v)], "x double, v long")
    for down in (False, True):
        got = {r.x: (r.v_upto, r.v_all) for r in running_sums(df, "x", ["v"], descending=down, ranges=7).collect()}
        assert got == {float(a): (int(v[x >= a].sum() if down else v[x <= a].sum()), int(v.sum())) for a in x}
    assert running_sums(df.limit(0), "x", ["v"]).count() == 0


def test_strata_keep_null(spark):
    out = metrics.stratified(metrics.predicted(scores(spark, [0, 1], [0.9, 0.9]), 0.5), ["source_name", "evaluation_subset"]).collect()
    assert {(r.dimension, r.value, r.n, r.fp) for r in out} == {("source_name", "src", 2, 1), ("evaluation_subset", None, 2, 1)}


def routing(spark, label=0):
    rows = [("a", "g1", 0.99, 1, 1, 0, 0), ("b", "g1", 0.5, 1, 0, 0, 1), ("c", "g2", 0.99, 1, 0, 1, 0), ("d", "g3", 0.1, 0, 0, 0, 0)]
    return spark.createDataFrame([(*r, label) for r in rows], "sample_id string, split_group_id string, rf_score double, rf_prediction int, if_prediction int, bilstm_prediction int, sage_prediction int, label int")


def test_routing(spark):
    policy = cascade.Policy(per_recording=1, per_split=1)
    rows = cascade.route(routing(spark), policy).orderBy("sample_id").collect()
    assert [r.stage_two for r in rows] == [False, True, True, False]
    assert [r.cascade_prediction for r in rows] == [1, 1, 1, 0]
    assert sum(r.llm_requested for r in rows) == 1
    flipped = cascade.route(routing(spark, 1), policy).orderBy("sample_id").collect()
    assert [r.llm_requested for r in flipped] == [r.llm_requested for r in rows]


@pytest.mark.parametrize(
    ("raw", "valid"),
    [
        ('{"label":"uncertain"}', False), ('{"label":"malicious","evidence":"","limitation":"x"}', False), ('{"label":"benign","evidence":"Short names","limitation":"No payload"}', True), ('{"label":"benign","evidence":1,"limitation":"x"}', False),
        ('{"label":"benign","evidence":"  ","limitation":"x"}', False), ("not json", False), (None, False), ("[1]", False), ('{"label":"benign","evidence":"a","limitation":null}', False),
    ],
)
def test_replies(spark, raw, valid):
    assert spark.createDataFrame([(raw,)], "r string").select(cascade.valid_reply(F.col("r"))).first()[0] is valid


def detector_tables(spark):
    base = [(f"s{k}", f"g{k % 4}", k % 2, "source-x", "tool-y") for k in range(40)]
    out = {}
    for d, shift in zip(cascade.DETECTORS, range(4)):
        out[d] = spark.createDataFrame([(*b, ((k * 7 + shift * 3) % 20) / 20, int((k * 7 + shift * 3) % 20 >= 10)) for k, b in enumerate(base)], "sample_id string, split_group_id string, label int, source_name string, tool_label string, score double, prediction int")
    return out


def test_cascade_plan(spark):
    feats = spark.createDataFrame([(f"s{k}", f"g{k % 4}", "malicious" if k % 2 else "benign", *([float(k)] * 9), None) for k in range(40)], "sample_id string, split_group_id string, traffic_label string, " + ", ".join(f"{f} double" for f in cascade.PROMPT_FEATURES))
    out = cascade_plan.decide(detector_tables(spark), feats, feats)
    c = out.counters.first()
    assert c.n == 40 and c.requested == c.valid == min(32, c.requested) and c.stage_two == c.requested + c.budget_fallback
    text = out.log.first().prompt
    body = json.loads(text)
    assert set(body) == {"window_features", "train_recording_median_reference", "detector_decisions", "rf_score"} and body["window_features"]["qtype_txt_ratio"] is None
    assert not any(x in text for x in ("source-x", "tool-y", '"s1"', "g1", "label"))

    def broken(body):
        raise TimeoutError("late")

    fallen = cascade_plan.decide(detector_tables(spark), feats, feats, arbitrator=broken)
    assert not fallen.enabled and fallen.counters.first().invalid_fallback == c.requested
    assert fallen.rows.where("arbitrated_prediction <> cascade_prediction").count() == 0
    with pytest.raises(ValueError):
        cascade.override_enabled(fallen.rows, frozen=True)


def test_assembly_is_one_to_one(spark):
    frames = detector_tables(spark)
    with pytest.raises(Exception, match="duplicate key"):
        cascade.assemble(frames | {"if": frames["if"].union(frames["if"].limit(1))}).collect()
    lost = cascade.unmatched(frames | {"sage": frames["sage"].where("sample_id <> 's3'")}).collect()
    assert [r.sample_id for r in lost] == ["s3"]


def test_weights_balance(spark):
    df = spark.createDataFrame([(f"s{k}", g, y) for k, (g, y) in enumerate(zip("aaabcc", (0, 0, 0, 0, 1, 1)))], "sample_id string, split_group_id string, label int")
    w = sampling.recording_weights(df)
    mass = {r.split_group_id: r.m for r in w.groupBy("split_group_id").agg(F.sum("weight").alias("m")).collect()}
    assert mass["a"] == pytest.approx(mass["b"]) and mass["c"] == pytest.approx(mass["a"] + mass["b"]) and sum(mass.values()) == pytest.approx(6)


def test_samples(spark):
    df = spark.createDataFrame([(f"s{k}", f"g{k % 2 if k < 80 else 2}", 1.0 + k % 3) for k in range(85)], "sample_id string, split_group_id string, weight double")
    counts = {r.split_group_id: (r.n, r.d) for r in sampling.balanced_sample(df, n=20).groupBy("split_group_id").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).collect()}
    assert counts["g0"] == counts["g1"] == (20, 20) and counts["g2"][0] == 20 and counts["g2"][1] <= 5
    again = lambda n: sorted(map(tuple, sampling.balanced_sample(df.repartition(n), n=20).select("sample_id", "draw").collect()))
    assert again(1) == again(6)
    assert 150 < sampling.weighted_sample(df, n=200).count() < 250
    assert sampling.medians(df.withColumn("e", F.lit(None).cast("double")), ["weight", "e"]) == {"weight": 2.0, "e": 0.0}


def test_drift(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=50), 1), np.round(rng.normal(0.5, 1, 40), 1)
    df = spark.createDataFrame([("f", False, float(x)) for x in a] + [("f", True, float(x)) for x in b], "feature string, second boolean, value double")
    ks = drift.ks_statistic(df, ["feature"]).first()
    grid = np.unique(np.concatenate((a, b)))
    assert ks.ks == pytest.approx(max(abs((a <= g).mean() - (b <= g).mean()) for g in grid))
    m = drift.p_values(drift.cliffs_delta(drift.mann_whitney(df, ["feature"]))).first()
    u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    assert m.u == pytest.approx(u) and m.delta == pytest.approx(2 * u / 2000 - 1) and 0 < m.p_value < 1
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "feature string, p_value double")
    assert {r.feature: round(r.holm_p, 6) for r in drift.holm(p).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_intervals(spark):
    rng = np.random.default_rng(3)
    y = [k % 2 for k in range(30)]
    df = metrics.predicted(scores(spark, np.repeat(y, 5), rng.random(150) * 0.6 + np.repeat(y, 5) * 0.4, list(np.repeat(range(30), 5))), 0.5)
    exact = {r.metric: (r.low, r.high) for r in evaluation.cluster_bootstrap(df, repeats=200).collect()}
    again = {r.metric: (r.low, r.high) for r in evaluation.cluster_bootstrap(df.repartition(7), repeats=200).collect()}
    assert exact == again and all(0 <= a <= b <= 1 for a, b in exact.values())
    spread = {r.metric: (r.low, r.high) for r in evaluation.poisson_bootstrap(df, repeats=200).collect()}
    assert all(abs(exact[k][j] - spread[k][j]) < 0.12 for k in exact for j in (0, 1))
    one = {r.metric: r.low for r in evaluation.cluster_bootstrap(df.where("label = 1"), repeats=20).collect()}
    assert one["fpr"] is None and one["f1"] is None and one["recall"] is not None
    e = evaluate_plan.evaluate(df.drop("prediction"), *evaluate_plan.thresholds(df.drop("prediction")))
    assert e.window.first().n == 150 and e.recording.first().n == 30 and e.strata.count() == 3 and e.errors.count() == 3


def test_selection_and_logs(spark, tmp_path):
    for k, (run, model, recall, fpr) in enumerate([("rf_base", "rf", 0.9, 0.0), ("rf_b", "rf", 0.95, 0.01), ("rf_c", "rf", 0.95, 0.01), ("rf_base_seed17", "rf", 1.0, 0.0), ("if_base", "if", 0.5, 0.0)]):
        tables.mark_complete(str(tmp_path / "runs" / run), {"run_id": run, "model": model, "recall": recall, "fpr": fpr, "declared": k})
    assert tables.is_complete(str(tmp_path / "runs/rf_b")) and not tables.is_complete(str(tmp_path / "runs/none"))
    runs = selection.finished_runs(spark, str(tmp_path / "runs"))
    assert {r.model: r.run_id for r in selection.best_runs(runs).collect()} == {"rf": "rf_b", "if": "if_base"}
    with pytest.raises(ValueError, match="missing"):
        selection.freeze(runs, ["rf_base", "sage"], str(tmp_path / "lock.json"))
    lock = selection.freeze(runs, ["rf_base", "if_base"], str(tmp_path / "lock.json"), [str(tmp_path / "runs/rf_b/COMPLETE.json")])
    assert lock["selected"]["rf"] == "rf_b" and len(next(iter(lock["files"].values()))) == 64
    with pytest.raises(FileExistsError):
        selection.freeze(runs, ["rf_base"], str(tmp_path / "lock.json"))
    assert [c["run_id"] for c in selection.seed_repeats([{"run_id": "x", "seed": 1}, {"run_id": "y", "seed": 1}], ["y"])] == ["y_seed17", "y_seed2026"]
    stable = evaluation.seed_stability(runs.where("model = 'rf'"), ["recall"]).first()
    assert stable.recall_std == pytest.approx(np.std([0.9, 0.95, 0.95, 1.0], ddof=1)) and stable.recall_max == 1.0
    for k in range(2):
        tables.append_log(spark.createDataFrame([("a", k, k == 1)], "sample_id string, at int, valid boolean"), str(tmp_path / "log"))
    assert tables.read_log(spark, str(tmp_path / "log"), "sample_id", "at").collect()[0].valid is True
