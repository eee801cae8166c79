"""Detectors: what they must not depend on, and that they learn."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.models.autograd import Var, logit_loss
from windlass.models.forest import fit_forest, score_forest
from windlass.models.isolation import fit_isolation, score_isolation
from windlass.models.networks import BiLSTM, Graphs, GraphSAGE, Sequences, probabilities, score_network, train
from windlass.operators import metrics


def sequences(rng, lengths, steps=128):
    n = len(lengths)
    return Sequences(rng.normal(size=(n, steps, 15)), rng.integers(0, 17, (n, steps)), rng.integers(0, 9, (n, steps)), np.array(lengths))


def test_padding_plays_no_part():
    rng, net = np.random.default_rng(0), BiLSTM(hidden=6, layers=2)
    s = sequences(rng, [32, 128, 1])
    a = probabilities(net, s)
    for k, n in enumerate(s.length):
        s.x[k, n:], s.q[k, n:], s.r[k, n:] = 1e6, 16, 8
    assert np.array_equal(a, probabilities(net, s))


def test_graphs_do_not_leak():
    rng, net = np.random.default_rng(1), GraphSAGE(hidden=6, pooling="mean_max")
    one = (rng.normal(size=(3, 13)), np.array([(0, 1), (1, 0), (1, 2), (2, 1)]))
    other = (rng.normal(size=(5, 13)), np.array([(0, 4), (4, 0), (2, 3), (3, 2)]))
    alone, both = probabilities(net, Graphs.union([one])), probabilities(net, Graphs.union([one, other]))
    assert both[0] == pytest.approx(alone[0], abs=1e-12)
    assert probabilities(net, Graphs.union([one, other]).take(np.array([1])))[0] == pytest.approx(both[1], abs=1e-12)


@pytest.mark.parametrize("kind", ["sequence", "graph"])
def test_gradients(kind):
    rng = np.random.default_rng(2)
    if kind == "sequence":
        net, data = BiLSTM(hidden=3), sequences(rng, [2, 4], 4)
    else:
        net, data = GraphSAGE(hidden=4), Graphs.union([(rng.normal(size=(3, 13)), np.array([(0, 1), (1, 0)])), (rng.normal(size=(2, 13)), np.array([(0, 1)]))])
    y, w = np.array([0, 1]), np.array([1.0, 2.0])
    logit = net(data)
    logit.backward(logit_loss(logit, y, w)[1])
    for name, v in net.p.items():
        flat = v.value.ravel()
        for k in rng.choice(flat.size, min(3, flat.size), replace=False):
            old, eps = flat[k], 1e-6
            up, down = (logit_loss((flat.__setitem__(k, x), net(data))[1], y, w)[0] for x in (old + eps, old - eps))
            flat[k] = old
            grad = 0.0 if v.grad is None else v.grad.ravel()[k]
            assert grad == pytest.approx((up - down) / (2 * eps), abs=1e-6), name


def test_networks_learn(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 80)
    s = sequences(rng, [8] * 80, 8)
    s.x[:, :, 0] += 3 * y[:, None]
    net = BiLSTM(hidden=6)
    curve = train(net, s, y, np.ones(80), s, y, batch=20, rate=0.02, epochs=8)
    assert curve[-1]["auprc"] > 0.95
    rows = spark.createDataFrame(pd.DataFrame({"sample_id": [f"s{k}" for k in range(80)], "continuous": [x.tolist() for x in s.x], "qtype_id": [x.tolist() for x in s.q], "rcode_id": [x.tolist() for x in s.r], "length": s.length}))
    scored = {r.sample_id: r.score for r in score_network(net, rows).collect()}
    assert [scored[f"s{k}"] for k in range(80)] == pytest.approx(probabilities(net, s).tolist())


def test_forests(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", f"g{k % 20}", int(k % 20 >= 10), *(float(x) for x in rng.normal(3.0 * (k % 20 >= 10), 1, 4)), None, 1.0) for k in range(400)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "sample_id string, split_group_id string, label int, a double, b double, c double, d double, e double, weight double")
    model, fill = fit_forest(df, names, trees=10, depth=4)
    assert metrics.auroc(score_forest(model, fill, df)).first().auroc > 0.98
    one = fit_isolation(df, names, per_recording=16, trees=50)
    scored = score_isolation(one, df)
    assert metrics.auroc(scored).first().auroc > 0.95
    assert 0 < scored.agg(F.min("score")).first()[0] <= scored.agg(F.max("score")).first()[0] < 1
    assert Var(np.ones(2)).grad is None


def test_networks_choose_windows_before_gathering_them(spark, monkeypatch):
    """The driver gets the chosen windows, not every task's first ones; and of each the right graph, label and weight."""
    import hashlib

    from windlass import catalogue
    from windlass.models import networks

    n = 12_000
    key = spark.range(0, n, 1, 48).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("sample_id"), "id")
    node = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.struct(k.alias("node_id"), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda c: (F.col("id") + c / 16).cast("float")).alias("x")))
    edge = F.when(F.col("id") % 5 != 0, F.array(F.struct(F.lit(0).alias("src"), F.lit(39).alias("dst")), F.struct(F.lit(39).alias("src"), F.lit(0).alias("dst"))))
    rows = key.select("sample_id", node.alias("nodes"), edge.alias("edges"))
    labels = key.select("sample_id", F.when(F.col("id") % 3 == 0, "validation").otherwise("train").alias("split"), (F.col("id") % 7).cast("string").alias("split_group_id"), (F.col("id") % 7 % 2).cast("int").alias("label"))
    monkeypatch.setattr(catalogue, "_labels", lambda spark, sf_dir: labels)
    seen = []
    monkeypatch.setattr(networks, "train", lambda net, *given, **settings: seen.extend(given))
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "16m")
    try:
        scored = catalogue._trained(GraphSAGE(hidden=2, layers=1), Graphs, rows, spark, "", epochs=1)
    finally:
        conf.remove("spark.driver.maxResultSize")
    data, y, weight, check, check_y = seen
    order = sorted(range(n), key=lambda k: hashlib.sha256(f"w{k}".encode()).hexdigest())
    for got, label, chosen in ((data, y, [k for k in order if k % 3][:2000]), (check, check_y, [k for k in order if k % 3 == 0][:1000])):
        assert len(got) == len(chosen) and got.x[::40, 0].tolist() == chosen and label.tolist() == [k % 7 % 2 for k in chosen]
        assert got.member.tolist() == np.repeat(np.arange(len(chosen)), 40).tolist()
        ends = [(40 * i + a, 40 * i + 39 - a) for i, k in enumerate(chosen) if k % 5 for a in (0, 39)]
        assert list(zip(got.src.tolist(), got.dst.tolist())) == ends
    assert weight.sum() == pytest.approx(2)
    assert "MapInPandas" not in scored._jdf.queryExecution().toString()  # whole Arrow batches as Python objects fill an executor
    assert scored.count() == n
    spark.catalog.clearCache()


def test_joined_batches_are_one():
    rng = np.random.default_rng(2)
    some = [(rng.normal(size=(k, 13)), np.array([(0, k - 1)] * (k > 1), int).reshape(-1, 2)) for k in (3, 1, 4, 2, 2)]
    one, two = Graphs.union(some), Graphs.joined([Graphs.union(some[:2]), Graphs.union(some[2:])])
    assert one.n == two.n and all((getattr(one, c) == getattr(two, c)).all() for c in ("x", "src", "dst", "member"))
    long, short = sequences(rng, [6, 3], steps=6), sequences(rng, [2], steps=2)
    net, both = BiLSTM(hidden=3), Sequences.joined([long, short])
    assert both.x.shape == (3, 6, 15) and both.length.tolist() == [6, 3, 2]
    assert probabilities(net, both) == pytest.approx(np.concatenate([probabilities(net, long), probabilities(net, short)]), abs=1e-12)


def test_sage_score_trains_on_every_window_of_the_train_split(spark, monkeypatch):
    """Each train window takes part once in every epoch with its label and weight, and every validation one chooses the epoch."""
    from windlass import catalogue
    from windlass.models import networks

    n = 4_500
    key = spark.range(0, n, 1, 8).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("sample_id"), "id")
    node = F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda k: F.struct(k.alias("node_id"), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda c: (F.col("id") + c / 16).cast("float")).alias("x")))
    edge = F.when(F.col("id") % 3 == 2, F.array(F.struct(F.lit(0).alias("src"), F.lit(2).alias("dst"))))
    split = F.when(F.col("id") % 9 < 3, "validation").otherwise("train")
    label = F.when(F.col("id") == 8, F.lit(None)).otherwise((F.col("id") % 7 % 2).cast("int"))
    labels = key.select("sample_id", split.alias("split"), (F.col("id") % 7).cast("string").alias("split_group_id"), label.alias("label"))
    monkeypatch.setattr(catalogue, "sequence_table", lambda spark, sf_dir: None)
    for name in ("nodes", "edges", "node_features", "edge_list"):
        monkeypatch.setattr(catalogue.graph, name, lambda *a: None)
    monkeypatch.setattr(catalogue.graph, "graphs", lambda *a: key.select("sample_id", node.alias("nodes"), edge.alias("edges")))
    monkeypatch.setattr(catalogue, "_labels", lambda spark, sf_dir: labels)
    fit, used, compared, checked = [], [], [], []
    forward, loss, precision = GraphSAGE.__call__, networks.logit_loss, metrics.average_precision
    monkeypatch.setattr(GraphSAGE, "__call__", lambda net, g, rng=None: (fit.append(g) if rng is not None else compared.append(g)) or forward(net, g, rng))
    monkeypatch.setattr(networks, "logit_loss", lambda logit, y, w: used.append((y, w)) or loss(logit, y, w))
    monkeypatch.setattr(metrics, "average_precision", lambda df: checked.append(df.count()) or precision(df))
    scored = catalogue.sage_score(spark, "")
    train = [k for k in range(n) if k % 9 >= 3 and k != 8]
    got = [[int(x) for x in g.x[np.unique(g.member, return_index=True)[1], 0]] for g in fit]
    epochs = [sum(got[: len(got) // 2], []), sum(got[len(got) // 2 :], [])]
    assert [sorted(e) for e in epochs] == [train, train] and epochs[0] != epochs[1]
    assert max(map(len, got)) <= 64 and min(map(len, got)) >= 62
    counts = {c: [k % 7 for k in train].count(c) for c in range(7)}
    whole = {c: len(train) / 2 / len([d for d in range(7) if d % 2 == c % 2]) / counts[c] for c in range(7)}
    for ids, (y, w) in zip(got, used, strict=True):
        assert y.tolist() == [k % 7 % 2 for k in ids] and w == pytest.approx([whole[k % 7] for k in ids])
    assert checked == [1500, 1500] and not compared
    assert scored.columns == ["sample_id", "score"] and scored.select("sample_id").distinct().count() == scored.count() == n
    spark.catalog.clearCache()


def test_packed_graphs_are_the_same_graphs(spark):
    from windlass.models.networks import _average_precision, packed, score_packed, train_packed

    rng = np.random.default_rng(5)
    sizes = [3, 1, 64, 2, 7] * 60
    xs = [rng.normal(size=(k, 13)).astype("f4") for k in sizes]
    ends = [None if k < 3 else [(0, k - 1), (k - 1, 0), (1, 2)] for k in sizes]
    ends[5], xs[1][0, 4] = [], np.nan
    rows = spark.createDataFrame(
        [(f"s{k:03}", "train" if k % 2 else "validation", k // 2 % 2 if k != 7 else None, 1.0, [(i, v.tolist()) for i, v in enumerate(x)], e) for k, (x, e) in enumerate(zip(xs, ends))],
        "sample_id string, split string, label int, weight double, nodes array<struct<node_id: int, x: array<float>>>, edges array<struct<src: int, dst: int>>",
    )
    some = packed(rows).orderBy("sample_id").toPandas()
    one, two = Graphs.of(rows.orderBy("sample_id").toPandas()), Graphs.unpacked(some["nodes"].tolist(), some["ends"].tolist())
    assert one.n == two.n and all(np.array_equal(getattr(one, c), getattr(two, c), equal_nan=True) for c in ("x", "src", "dst", "member"))
    net, whole = GraphSAGE(hidden=3), packed(rows.where("sample_id <> 's001'"))
    score = lambda df: {r.sample_id: r.score for r in df.collect()}
    assert score(score_packed(net, whole, most=7)) == pytest.approx(score(score_network(net, rows.where("sample_id <> 's001'"))), abs=1e-12)
    curve = train_packed(net, whole, epochs=1)
    found = score_packed(net, whole.where("split = 'validation'")).toPandas()
    assert curve[0]["auprc"] == pytest.approx(_average_precision(found["label"].to_numpy(), found["score"].to_numpy()), abs=1e-9)
    with pytest.raises(ValueError, match="train split"):
        train_packed(net, whole.where("split = 'validation'"))
