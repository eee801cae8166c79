"""Windows, features, scalers, sequences and graphs on hand-made transactions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.functions import similarity as sim
from windlass.functions.nulls import finite
from windlass.operators import checks, features, graph, scaling, sequence, windows
from windlass.plans import prepare as plan
from windlass.sources import canonical as source
from windlass.sources import tables


def transaction(group, k, **more):
    row = dict.fromkeys(source.COLUMNS)
    row |= {
        "split_group_id": group, "traffic_label": "benign", "source_name": "s", "request_timestamp": str(float(k)), "base_domain": "example.com", "subdomain": f"w{k % 5}", "query_name_normalized": f"w{k % 5}.example.com", "query_type": "A", "dns_rcode": "NOERROR",
        "query_name_len": str(10 + k % 7), "subdomain_len": "3", "num_labels": "3", "max_label_len": "7", "long_consonant_string_count": "0", "query_entropy": "2.5", "longest_subdomain_entropy": "1.0", "req_resp_time_diff": "0.5", "total_transaction_bytes": "100",
        "request_payload_len": "20", "response_payload_len": "30", "request_len": "40", "response_len": "60", "is_response_missing": "0", "client_ip": "c", "server_ip": "s", "split": "train", "ingest_seq": k,
    }
    return row | more


def frame(spark, rows):
    names = [*source.COLUMNS, "split", "ingest_seq"]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} string" for c in names[:-1]) + ", ingest_seq long")


def recordings(held_out_len="11"):
    rows = []
    for split in ("train", "validation", "test", "external_test"):
        rows += [transaction(f"{split}-large", k, split=split, **({} if split == "train" else {"query_name_len": held_out_len})) for k in range(160)]
        rows += [transaction(f"{split}-small", k, split=split, traffic_label="Malicious") for k in range(31)]
    return rows


def test_prepare_end_to_end(spark, tmp_path):
    p = plan.prepare(frame(spark, recordings()).repartition(5))
    m = p.manifest.orderBy("split", "window_number").collect()
    assert sorted({(r.split, r.window_number, r.window_tx_count) for r in m}) == sorted((s, n, c) for s in ("train", "validation", "test", "external_test") for n, c in ((0, 128), (1, 32)))
    assert {(r.split_group_id, r.transactions) for r in p.excluded.collect()} == {(f"{s}-small", 31) for s in ("train", "validation", "test", "external_test")}
    assert m[0].sample_id.startswith("external_test-" + hashlib.sha256(b"external_test-large").hexdigest()[:16])
    assert len(features.core(p.features).columns) == 44 and len(features.FEATURES) == 52
    assert checks.report(checks.window_checks(p.windowed, p.manifest, p.features, features.FEATURES) + checks.sequence_checks(p.sequences, p.manifest) + checks.graph_checks(p.nodes, p.edges)).where("NOT passed").count() == 0
    assert p.scaled.select(*(F.count_if(F.col(f).isNull() | F.isnan(f)).alias(f) for f in features.FEATURES)).first() == tuple([0] * 52)
    s = p.sequences.first()
    assert (len(s.continuous), len(s.continuous[0]), len(s.mask), sum(s.mask)) == (128, 15, 128, s.length)
    assert s.length == 128 or not any(s.continuous[-1]) and s.qtype_id[-1] == 0
    plan.write(p, str(tmp_path / "out"), [str(tmp_path / "in")])
    assert spark.read.parquet(str(tmp_path / "out/features")).where("split = 'train'").count() == 2
    with pytest.raises(FileExistsError):
        plan.write(p, str(tmp_path / "out"), [])
    with pytest.raises(ValueError):
        tables.guard_output(str(tmp_path / "in/out"), [str(tmp_path / "in")])


def test_scalers_see_train_only(spark):
    a, b = plan.prepare(frame(spark, recordings())), plan.prepare(frame(spark, recordings("10000")))
    assert a.channel_scaler == b.channel_scaler and a.feature_scaler == b.feature_scaler
    train = lambda p: sorted(map(tuple, p.scaled.where("split = 'train'").select("sample_id", *features.FEATURES).collect()))
    assert train(a) == train(b)


def test_windows_do_not_depend_on_partitions(spark):
    rows = [transaction(f"g{k % 3}", k, request_timestamp=[str(k // 4), "nan", "x", None][0 if k % 11 else k % 4]) for k in range(200)]
    a, b = (windows.recording_windows(source.canonical(frame(spark, rows).repartition(n)), size=16, least=4).select("sample_id", "pos", "ingest_seq") for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    large = windows.recording_windows(source.canonical(frame(spark, rows)), size=16, least=4, large=True).select("sample_id", "pos", "ingest_seq")
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, a.collect()))


def test_canonical_checks(spark, tmp_path):
    rows = [transaction("007", k) for k in range(3)]
    vendor = frame(spark, rows).withColumnRenamed("query_type", "vendor_dns_type")
    with pytest.raises(ValueError, match="query_type"):
        source.canonical(vendor)
    assert source.canonical(vendor, {"vendor_dns_type": "query_type"}).first().query_type == "A"
    for bad in ({"split_group_id": None}, {"traffic_label": "odd"}, {"traffic_label": None}):
        with pytest.raises(Exception, match="split_group_id is null|unknown traffic_label"):
            source.canonical(frame(spark, [transaction("g", 0, **bad)])).collect()
    with pytest.raises(ValueError, match="no rows"):
        source.require_rows(source.canonical(frame(spark, rows).limit(0)))
    with pytest.raises(ValueError, match="Recording leakage"):
        source.require_sound_splits(source.canonical(frame(spark, rows + [transaction("007", 9, split="test")])))
    with pytest.raises(ValueError, match="Mixed labels"):
        source.require_sound_splits(source.canonical(frame(spark, rows + [transaction("007", 9, traffic_label="malicious")])))
    path = tmp_path / "t.csv"
    path.write_text("﻿" + ",".join(source.COLUMNS) + "\n" + ",".join("007" if c == "split_group_id" else "NULL" if c == "query_type" else "" if c == "dns_rcode" else "benign" for c in source.COLUMNS) + "\n", encoding="utf-8")
    r = source.canonical(source.read_transactions(spark, str(path))).first()
    assert (r.split_group_id, r.query_type, r.dns_rcode, r.query_name_len) == ("007", "NULL", None, None)
    assert source.column_names(spark, str(path))[0] == source.COLUMNS[0]


def test_missing_and_odd_values(spark):
    odd = ["nan", "inf", "-inf", "text", None, "5.0", "3.0", "4.0"]
    rows = [transaction("g", k, query_entropy=v, is_response_missing=None if k < 2 else "0", query_type=[None, "a", "NULL", "zz"][k % 4], subdomain=None, total_transaction_bytes=None) for k, v in enumerate(odd)]
    f = features.window_features(windows.recording_windows(source.canonical(frame(spark, rows)), size=8, least=2)).first()
    assert f.query_entropy_mean == 4.0 and f.query_entropy_std == pytest.approx(math.sqrt(2 / 3))
    assert f.high_query_entropy_ratio == 3 / 8  # 5, 4 and infinity; what is no number stays in the denominator
    assert f.response_missing_ratio == 2 / 8
    assert (f.qtype_null_ratio, f.qtype_a_ratio, f.qtype_other_ratio) == (0.5, 0.25, 0.25)
    assert f.transaction_bytes_mean is None and f.transaction_bytes_p95 is None
    assert f.unique_subdomain_ratio == 1 / 8 and f.adjacent_subdomain_jaro_winkler_mean == 1.0
    assert f.iat_mean == 1.0 and f.iat_cv == 0.0
    assert spark.sql("select 'NaN' x union all select 'Infinity' union all select '1e3' union all select 'q'").select(F.sum(finite(F.col("x")))).first()[0] == 1000.0


def test_features_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [transaction("g", k, total_transaction_bytes=str(rng.integers(50, 900)), request_timestamp=str(float(np.round(rng.random() * 1000, 3)))) for k in range(40)]
    f = features.window_features(windows.recording_windows(source.canonical(frame(spark, rows)), size=64, least=4)).first()
    x, t = np.array([float(r["total_transaction_bytes"]) for r in rows]), np.sort([float(r["request_timestamp"]) for r in rows])
    assert f.transaction_bytes_std == pytest.approx(x.std()) and f.transaction_bytes_p95 == pytest.approx(np.quantile(x, 0.95))
    assert f.iat_median == pytest.approx(np.median(np.diff(t))) and f.iat_cv == pytest.approx(np.diff(t).std() / np.diff(t).mean())


@pytest.mark.parametrize(
    ("a", "b", "jaro", "winkler"),
    [("", "", 1, 1), ("a", "", 0, 0), ("martha", "marhta", 0.944444, 0.961111), ("dwayne", "duane", 0.822222, 0.84), ("dcabbcbcd", "cad", 0.611111, 0.611111), ("abc", "axyzw", 0.511111, 0.56)],
)
def test_similarity(spark, a, b, jaro, winkler):
    assert sim.jaro(a, b) == pytest.approx(jaro, abs=1e-6) and sim.jaro_winkler(a, b) == pytest.approx(winkler, abs=1e-6)
    assert spark.createDataFrame([(a, b)], "a string, b string").select(sim.similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(winkler, abs=1e-6)


def test_pairs_are_sampled_evenly():
    assert sim.sampled(24) == list(range(24)) and len(sim.sampled(127)) == 24
    assert sim.sampled(127)[0] == 0 and sim.sampled(127)[-1] == 126


def test_scaler_rules_and_degenerate_fits(spark):
    assert scaling.feature_rule("high_query_entropy_ratio") == "identity_clip_0_1" and scaling.feature_rule("query_entropy_std") == "robust"
    assert scaling.feature_rule("adjacent_subdomain_jaro_winkler_mean") == "log1p_robust"
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (float("nan"), None, 5.0)], "a_entropy double, b double, c double")
    fit = {r["feature"]: r for r in scaling.fit(df, {"a_entropy": "robust", "b": "log1p_robust", "c": "log1p_robust"})}
    assert (fit["a_entropy"]["center"], fit["a_entropy"]["iqr"]) == (1.5, 0.5)
    assert (fit["b"]["center"], fit["b"]["iqr"]) == (0.0, 1.0) and fit["c"]["iqr"] == 1.0
    assert [r.a_entropy for r in scaling.apply(df, [fit["a_entropy"]]).collect()] == [-1.0, 1.0, 0.0]


def test_graph_semantics(spark):
    rows = [transaction("g", 0, base_domain=None, subdomain=""), transaction("g", 1, base_domain="b", subdomain="b"), transaction("g", 2, base_domain="c", subdomain="b", query_type="TXT"), transaction("g", 3, client_ip="")]
    c = source.canonical(frame(spark, rows))
    seq = sequence.sequence_rows(windows.recording_windows(c, size=8, least=2), scaling.fit_channels(c))
    n, e = graph.nodes(seq), graph.edges(seq)
    ids = {(r.kind, r.key): r.node_id for r in n.collect()}
    assert ids == {("client", "c"): 0, ("server", "s"): 1, ("base", "<missing>"): 2, ("base", "b"): 3, ("subdomain", "b"): 4, ("base", "c"): 5, ("client", "<missing>"): 6, ("base", "example.com"): 7, ("subdomain", "w3"): 8}
    assert e.count() == len({(r.type, r.src_key, r.dst_key) for r in e.collect()}) == 9
    degree = {(r.kind, r.key): r.degree for r in graph.degrees(e).collect()}
    assert degree["client", "c"] == 4 and degree["subdomain", "b"] == 2
    full = {r.node_id: r for r in graph.node_features(n, e).collect()}
    assert full[0].degree_ratio == 4 / 8 and full[4].tunnel_share == 0.5 and full[0].activity_ratio == 0.75
    both = graph.edge_list(n, e)
    assert both.count() == 18 and both.where("src = 4").count() == 2
    g = graph.graphs(graph.node_features(n, e), both).first()
    assert len(g.nodes) == 9 and len(g.nodes[0].x) == 13 and len(g.edges[0].x) == 6
    near = {r.node_id: r.activity_ratio for r in graph.mean_neighbours(both, n, ["activity_ratio"]).collect()}
    assert near[4] == pytest.approx((0.25 + 0.25) / 2)


def test_sequence_vocabulary_and_gaps(spark):
    rows = [transaction("g", 0, query_type=None, dns_rcode="nxdomain", request_timestamp="5"), transaction("g", 1, query_type="any", dns_rcode="odd", request_timestamp="7"), transaction("g", 2, query_type="https", request_timestamp="bad")]
    c = source.canonical(frame(spark, rows))
    fit = scaling.fit_channels(c)
    got = sequence.sequence_rows(windows.recording_windows(c, size=8, least=2), fit).orderBy("pos").collect()
    assert [(r.qtype_id, r.rcode_id) for r in got] == [(1, 3), (16, 1), (15, 2)]
    gap = next(r for r in fit if r["feature"] == "interarrival_time")
    assert got[0].x_interarrival_time == pytest.approx(-gap["center"] / gap["iqr"]) and got[2].x_interarrival_time == 0.0


def test_reconstruction_finds_changes(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 1.0)], "sample_id string, f double, g double")
    b = spark.createDataFrame([("x", 1.000001, None), ("y", 2.1, 1.0), ("z", 1.0, 1.0)], "sample_id string, f double, g double")
    assert {r.sample_id: r.matches for r in checks.reconstruction(a, b, ["f", "g"]).collect()} == {"x": True, "y": False, "z": False}
