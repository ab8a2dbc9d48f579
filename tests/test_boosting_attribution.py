"""Boosting against a plain-Python run, tree attributions against all coalitions, kernel map, net and exact AUC."""

from __future__ import annotations

from itertools import combinations
from math import factorial, log

import numpy as np
import pytest

from domlens.operators import attribution as AT
from domlens.operators import boosting as B
from domlens.operators import kernel as K
from domlens.operators import ml as ML
from domlens.operators import network as N
from domlens.operators import ranking as R
from domlens.operators import trees as T
from domlens.operators import tuning as G

FEATURES = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 5)), 2)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    rows = [(i, *map(float, r), float(v), float(i % 3)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label double, three double").repartition(3).cache()
    return df, x, y


# ---------------------------------------------------------------- AdaBoost
def plain_tree(x, y, w, edges, depth, split_rows):
    """Leaf verdicts by weighted Gini, splits of equal gain by feature and edge."""
    out = np.zeros(len(y))

    def gini(rows):
        s = np.array([w[rows][y[rows] == c].sum() for c in (0, 1)])
        return s.sum() - (s ** 2).sum() / max(s.sum(), 1e-300)

    def grow(rows, level):
        best = (1e-12, None)
        if level < depth and len(rows) >= split_rows:
            for f in range(x.shape[1]):
                for at in edges[f]:
                    left = rows[x[rows, f] <= at]
                    right = rows[x[rows, f] > at]
                    if len(left) and len(right):
                        gain = round(gini(rows) - gini(left) - gini(right), 12)
                        if gain > best[0]:
                            best = (gain, (left, right))
        if best[1] is None:
            out[rows] = float(w[rows][y[rows] == 1].sum() > w[rows][y[rows] == 0].sum())
        else:
            for part in best[1]:
                grow(part, level + 1)

    grow(np.arange(len(y)), 0)
    return out


def test_adaboost_is_the_plain_run(table, monkeypatch):
    monkeypatch.setattr(B, "CUT", 3)  # the state is written anew in between
    df, x, y = table
    edges = [np.quantile(x[:, f], [0.2, 0.4, 0.6, 0.8]) for f in range(5)]
    found = B.fit(df, FEATURES, "label", B.AdaBoost(2), 8, 2, edges=edges, split_rows=5)
    w, errors, stages = np.ones(len(y)), [], []
    for _ in range(8):
        miss = plain_tree(x, y, w, edges, 2, 5) != y
        errors.append(w[miss].sum() / w.sum())
        stages.append(log((1 - errors[-1]) / errors[-1]))
        w = w * np.exp(stages[-1] * miss)
    assert found.errors == pytest.approx(errors, rel=1e-9) and found.stages == pytest.approx(stages, rel=1e-9)
    votes = {r["id"]: r["margin"] for r in T.margins(df, found.ensemble, ["id"]).collect()}
    assert {i: v[1] > v[0] for i, v in votes.items()} == {i: bool(np.argmax(m)) for i, m in enumerate(found.ensemble.margin(x))}
    assert np.mean([(votes[i][1] > votes[i][0]) == (y[i] == 1) for i in range(len(y))]) > 0.85


def test_boosting_of_odd_rows(spark, table):
    df, _, _ = table
    odd = df.limit(60).unionByName(spark.createDataFrame([(900, None, None, None, None, None, 1.0, 2.0), (901, 1.0, 1.0, 1.0, 1.0, 1.0, None, None)], df.schema))
    model = B.fit(odd, FEATURES, "label", B.Logistic(), 3, 2)
    assert len(model.losses) == 3 and model.losses[0] == pytest.approx(log(2)) and model.losses[2] < model.losses[0]
    assert T.margins(odd, model.ensemble, ["id"]).count() == 62
    assert B.fit(df.limit(0), FEATURES, "label", B.Logistic(), 3, 2, edges=[np.zeros(1)] * 5).ensemble.trees == []
    perfect = B.fit(df.withColumn("label", (df["x0"] > 0).cast("double")), FEATURES, "label", B.AdaBoost(2), 5, 2, edges=[np.zeros(1)] * 5)
    assert perfect.errors == [0.0] and perfect.stages == [1.0]


def test_softmax_loss_falls(table):
    df, x, _ = table
    model = B.fit(df, FEATURES, "three", B.Softmax(3), 6, 4, least_rows=3, max_leaves=8)
    assert model.losses[0] == pytest.approx(log(3)) and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert len(model.ensemble.trees) == 18 and all((t.feature < 0).sum() <= 8 for t in model.ensemble.trees)


# ---------------------------------------------------------------- attributions
def coalition(tree: T.Tree, row, inside, output, node=0):
    if tree.feature[node] < 0:
        return tree.value[node][output]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in inside:
        return coalition(tree, row, inside, output, left if row[tree.feature[node]] <= tree.threshold[node] else right)
    return (tree.cover[left] * coalition(tree, row, inside, output, left) + tree.cover[right] * coalition(tree, row, inside, output, right)) / tree.cover[node]


def brute(model: T.Ensemble, row, output):
    d = len(model.features)
    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for s in combinations(others, size):
                share = factorial(size) * factorial(d - size - 1) / factorial(d)
                for tree, w in zip(model.trees, model.weights):
                    out[i] += share * w * (coalition(tree, row, {*s, i}, output) - coalition(tree, row, set(s), output))
    return out


def models(df):
    data = ML.assemble(FEATURES).transform(df)
    yield T.from_spark(ML.random_forest(4, 6).fit(data), FEATURES), 1, ML.random_forest(4, 6).fit(data)
    yield T.from_spark(ML.boosted_trees(4, 3).fit(data), FEATURES), 0, ML.boosted_trees(4, 3).fit(data)
    yield T.from_spark(ML.decision_tree(8).fit(data), FEATURES), 1, None
    yield B.fit(df, FEATURES, "label", B.Logistic(), 5, 4).ensemble, 0, None
    yield B.fit(df, FEATURES, "three", B.Softmax(3), 2, 5).ensemble, 2, None


def test_attributions_are_brute_force(spark, table):
    df, x, _ = table
    for model, output, fitted in models(df):
        found = {r["sample_id"]: r for r in AT.attributions(df, model, "id", output).collect()}
        assert len(found) == len(x)
        for i, r in found.items():
            assert sum(r["values"]) == pytest.approx(r["margin"] - r["expected"], abs=1e-9)
            if i % 40 == 0:
                assert r["values"] == pytest.approx(brute(model, x[i], output), abs=1e-9)
        if fitted is not None:  # the margin is what Spark returns
            scored = ML.score(fitted, ML.assemble(FEATURES).transform(df)).select("id", "probability", "rawPrediction").collect()
            for r in scored:
                expected = r["probability"][1] if output else r["rawPrediction"][1]
                assert found[r["id"]]["margin"] == pytest.approx(expected, abs=1e-9)


def test_attributions_of_odd_rows(spark, table):
    df, _, _ = table
    model = T.fixed_trees(df, [(("x0", 0.0), ("x1", 0.0)), (("x2", 0.0), ("x0", 0.5))], "label")
    odd = spark.createDataFrame([(None, None, None, None), (1, 0.1, None, 0.2), (1, 0.1, None, 0.2)], "id long, x0 double, x1 double, x2 double")
    rows = AT.attributions(odd, model, "id").collect()
    assert len(rows) == 3 and all(sum(r["values"]) == pytest.approx(r["margin"] - r["expected"]) for r in rows)
    assert AT.attributions(odd.limit(0), model, "id").collect() == []
    long = AT.long_form(AT.attributions(odd, model, "id"), model.features)
    assert long.count() == 9 and {r["feature"] for r in long.collect()} == {"x0", "x1", "x2"}


# ---------------------------------------------------------------- kernel, net, ranking, tuning
def test_kernel_machine_tells_rings_apart(spark):
    rng = np.random.default_rng(3)
    angle, outer = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    r = np.where(outer, 2.0, 1.0) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(i, float(r[i] * np.cos(angle[i])), float(r[i] * np.sin(angle[i])), float(outer[i])) for i in range(400)], "id long, a double, b double, label double")
    def accuracy(data):
        scored = ML.linear_svc(400, 59.0).fit(data).transform(data)
        return scored.filter("prediction = label").count() / 400
    mapping = K.fit_kernel_map(df, ["a", "b"], "id", gamma=1.0, landmarks=60)
    z = K.with_kernel_features(df, ["a", "b"], mapping, ["id", "label"]).cache()
    assert accuracy(z) > 0.95 > 0.7 > accuracy(ML.assemble(["a", "b"]).transform(df))
    points = mapping.landmarks
    apart = ((points[:, None] - points[None]) ** 2).sum(-1)
    assert np.allclose(mapping(points) @ mapping(points).T, np.exp(-apart), atol=1e-6)


def test_net_gradients_and_training(table):
    rng = np.random.default_rng(0)
    net = N.start([5, 7, 4, 1], np.zeros(5), np.ones(5), 1)
    x, y, w = rng.normal(size=(20, 5)), (rng.random(20) > 0.5).astype(float), rng.random(20)
    _, gradient = N.loss_and_gradient(net, x, y, w)
    for k, layer in enumerate(net.layers):
        for at in [(0, 0), (layer.shape[0] - 1, layer.shape[1] - 1), (1, 0)]:
            old = layer[at]
            layer[at] = old + 1e-6
            up = N.loss_and_gradient(net, x, y, w)[0]
            layer[at] = old - 1e-6
            down = N.loss_and_gradient(net, x, y, w)[0]
            layer[at] = old
            assert (up - down) / 2e-6 == pytest.approx(gradient[k][at], abs=1e-5)
    df, _, _ = table
    net, losses = N.fit(df, FEATURES, "label", (32, 16), steps=60, batches=1, rate=0.01)
    assert losses[-1] < 0.5 * losses[0]
    scored = N.score(df, net, FEATURES, ["id", "label"])
    assert scored.filter("prediction = label").count() > 200
    assert [w.shape for w in N.fit(df, FEATURES, "label", N.LAYERS, steps=1, batches=1)[0].layers] == [(6, 2500), (2501, 600), (601, 200), (201, 1)]
    assert N.fit(df.limit(0), FEATURES, "label", (3,), steps=2)[1] == []


def test_exact_area_under_the_curve(spark):
    rng = np.random.default_rng(9)
    rows = [("m", float(rng.integers(0, 20)) / 20, int(rng.integers(0, 2))) for _ in range(300)] + [("one", 0.5, 1), (None, 0.2, 0), (None, 0.9, 1), ("m", None, 1), ("m", 0.3, None)]
    found = {r["model"]: r for r in R.report(spark.createDataFrame(rows, "model string, score double, label int")).collect()}
    pos, neg = ([s for m, s, y in rows if m == "m" and s is not None and y == k] for k in (1, 0))
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert found["m"]["auc"] == pytest.approx(expected, abs=1e-12) and found["one"]["auc"] is None and found[None]["auc"] == 1.0
    assert R.report(spark.createDataFrame([], "model string, score double, label int")).collect() == []


def test_grid_by_weighted_score(table):
    df, _, _ = table
    import pyspark.sql.functions as F
    data = ML.assemble(FEATURES).transform(ML.with_fold(df, "label", F.col("id"), 3, seed=1))
    scores = G.grid_scores(ML.decision_tree(2), [{"maxDepth": 1}, {"maxDepth": 4}], data, "fold", 3)
    rows = scores.collect()
    assert len(rows) == 12
    for k in range(3):
        size = data.filter(F.col("fold") == k).count()
        assert {(r["side"], r["n"]) for r in rows if r["fold"] == k} == {("test", size), ("train", 240 - size)}
    best = G.best_point(scores).collect()
    assert sum(r["is_best"] for r in best) == 1 and max(best, key=lambda r: r["mean_test"])["is_best"]
    one = ML.decision_tree(4).fit(data).transform(data)
    assert G.WeightedScore().evaluate(one) > G.WeightedScore().evaluate(ML.decision_tree(1).fit(data).transform(data))


def test_total_sends_the_driver_one_sum(spark, monkeypatch):
    """Whatever the partitions, one sum reaches the driver; partitions without blocks add nothing."""
    from pyspark import RDD

    from domlens.operators import blocks as BL

    sizes, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sizes.append(found := collect(self)) or found)
    for rows, parts in ((40, 16), (3, 8), (5, 1), (2, 2), (0, 4)):
        rdd = spark.sparkContext.parallelize(range(rows), parts)
        got = BL.total(rdd, lambda v: [np.array([v, 1.0]), np.full((2, 2), v)])
        if rows:
            assert got[0].tolist() == [sum(range(rows)), rows] and (got[1] == sum(range(rows))).all()
        else:
            assert got is None
    assert [len(s) for s in sizes] == [1, 1, 1, 1, 0]
