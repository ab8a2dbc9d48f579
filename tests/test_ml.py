"""Splits, scalers, estimators and importance (K*, M*)."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from domlens.operators import ml as ML


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 7), float((i * 37) % 11), float(i % 7 > 3)) for i in range(400)]
    return spark.createDataFrame(rows, "k long, a double, b double, label double").cache()


def labelled(spark, sizes, base=0):
    return spark.createDataFrame([(base + c * 1_000_000 + i * 7, c) for c, n in enumerate(sizes) for i in range(n)], "k long, label int")


@pytest.mark.parametrize("base", [0, 5_000_000_000, -5_000_000_000, 2**62])
def test_split_is_stratified_for_any_key(spark, base):
    sizes = [1000, 60, 7, 1]
    train, test = ML.split(labelled(spark, sizes, base), "label", F.col("k"), 0.3, seed=1)
    part = {r["label"]: r["n"] for r in test.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert [part.get(c, 0) for c in range(4)] == [300, 18, 2, 0]
    assert train.count() + test.count() == sum(sizes) and train.join(test, "k").count() == 0
    again = ML.split(labelled(spark, sizes, base).repartition(5), "label", F.col("k"), 0.3, seed=1)[1]
    assert {r["k"] for r in again.collect()} == {r["k"] for r in test.collect()}


def test_folds_are_stratified(spark):
    folds = ML.with_fold(labelled(spark, [100, 50, 3]), "label", F.col("k"), 5, seed=2)
    n = {(r["label"], r["fold"]): r["n"] for r in folds.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(n[0, f] == 20 and n[1, f] == 10 for f in range(5)) and sum(v for (c, _), v in n.items() if c == 2) == 3


def test_sample_does_not_depend_on_partitions(spark):
    df = labelled(spark, [2000])
    a, b = (ML.sample_fraction(x, 0.2, F.col("k")) for x in (df, df.repartition(7)))
    assert {r["k"] for r in a.collect()} == {r["k"] for r in b.collect()} and 300 < a.count() < 500


@pytest.mark.parametrize("rows", [500, 5_000, 50_000])
def test_permutation_moves_nearly_all_rows(spark, rows):
    df = spark.range(rows).select(F.col("id").alias("k"), F.col("id").alias("v"))
    out = ML.permuted(df, ["v"], "k").select("k", F.col("_other.v").alias("o"))
    assert out.filter("k <> o").count() > 0.95 * rows
    assert out.select("o").distinct().count() == rows


def test_importance_finds_the_feature(data):
    model = Pipeline(stages=[ML.assemble(["a", "b"]), ML.decision_tree(4)]).fit(data)
    drop = {r["feature"]: r["f1_drop"] for r in ML.permutation_importance(model, data, ["a", "b"], "k").collect()}
    assert drop["a"] > 0.3 and abs(drop["b"]) < 0.05


ESTIMATORS = {
    "logistic": lambda: ML.logistic_regression(400), "svc": lambda: ML.linear_svc(400), "tree": lambda: ML.decision_tree(5), "forest": lambda: ML.random_forest(5, 4),
    "boosted": lambda: ML.boosted_trees(4, 2), "bayes": lambda: ML.gaussian_nb(), "mlp": lambda: ML.mlp([2, 4, 2], max_iter=20), "multiclass": lambda: ML.multiclass_trees(2),
}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_estimators_fit_and_score(data, name):
    model = Pipeline(stages=[ML.assemble(["a", "b"], "raw"), ML.standard_scaler("raw", "features"), ESTIMATORS[name]()]).fit(data)
    assert ML.evaluate(ML.score(model, data)).first()["accuracy"] > 0.8


def test_depth_is_refused_not_changed():
    with pytest.raises(ValueError):
        ML.decision_tree(31)
    with pytest.raises(ValueError):
        ML.random_forest(3, 31)


def test_class_weights(data):
    w = {r["label"]: r["weight"] for r in ML.class_weights(data).select("label", "weight").distinct().collect()}
    n = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    assert all(w[c] == pytest.approx(400 / (2 * n[c])) for c in n)


def test_forest_passes_keep_node_ids_and_grow_the_same_trees(spark, data):
    rows = ML.assemble(["a", "b"]).transform(data)
    for est in (ML.random_forest(5, 6), ML.decision_tree(6), ML.multiclass_trees(2)):
        assert est.getCacheNodeIds()
        plain = est.copy({est.cacheNodeIds: False})
        assert est.fit(rows).toDebugString.split("\n")[1:] == plain.fit(rows).toDebugString.split("\n")[1:]
    assert spark.sparkContext.getCheckpointDir()


def test_split_leaves_rows_where_they_are(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rows were many
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 2_000, 1, 6).select("id", (F.col("id") % 2).alias("label"))
        for part in ML.split(df, "label", F.col("id"), 0.3, seed=1):
            assert part.select(F.spark_partition_id().alias("p")).distinct().count() == 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
