"""Catalog: samples and splits (K*) and models (M*).

Splits have DuckDB twins (the hash is plain integer arithmetic on the key), and so have the scalers
and the ranking of features.  Queries that return a fitted model's scores have none -- fitting is
iterative -- and the driver records a rows-only check for them.
Binding: ``embeddings`` (all dimensions, 10 classes); binary tasks use label < 5.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import metrics as M
from ..operators import ml as ML
from ..operators.blocks import saved
from .bindings import table
from .catalog import query
from .catalog_metrics import SQL_MEAN_ABS, attributions


def sql_slot(key: str, seed: int) -> str:
    return f"((((({key}) % 1000003 + 1000003) % 1000003) * 2654435761 + {(seed + 1) * 40503}) % 1000003)"


def sql_histogram(rows: str, label: str, key: str, seed: int) -> str:
    """Rows with (label, slot, first: rows of the class in earlier slots, last: up to this one, n_class)."""
    return (f"SELECT *, sum(n) OVER (PARTITION BY label ORDER BY slot) AS last, sum(n) OVER (PARTITION BY label ORDER BY slot) - n AS first, "
            f"sum(n) OVER (PARTITION BY label) AS n_class FROM (SELECT {label} AS label, {sql_slot(key, seed)} AS slot, count(*) AS n FROM {rows} GROUP BY 1, 2)")


# ---------------------------------------------------------------- K1 - K4
@query("K1_sample", f"""
SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE {sql_slot('l_orderkey * 8 + l_linenumber', 42)} < 0.2 * 1000003 GROUP BY 1
""")
def sample(spark, sf_dir):
    """K1: seeded 20 % sample of lineitem by a hash of its key, rows per return flag."""
    li = table(spark, sf_dir, "lineitem")
    return ML.sample_fraction(li, 0.2, F.col("l_orderkey") * 8 + F.col("l_linenumber")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("K2_stratified_split", f"""
SELECT label AS quality, sum(CASE WHEN last <= round(n_class * 0.3) THEN n ELSE 0 END)::BIGINT AS n_test, any_value(n_class)::BIGINT AS n_class,
       sum(CASE WHEN last <= round(n_class * 0.3) THEN n ELSE 0 END)::DOUBLE / any_value(n_class) AS test_share
FROM ({sql_histogram('labels', 'quality', 'doc_id', 42)}) GROUP BY 1
""")
def stratified_split(spark, sf_dir):
    """K2: stratified 70/30 split of the labelled documents, share of each class in test."""
    train, test = ML.split(table(spark, sf_dir, "labels"), "quality", F.col("doc_id"), 0.3, seed=42)
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    out = both.groupBy("quality").agg(F.sum("t").cast("long").alias("n_test"), F.count(F.lit(1)).alias("n_class"))
    return out.withColumn("test_share", F.col("n_test") / F.col("n_class"))


SUB_SEEDS = (0, 1, 2)


@query("K3_stratified_subsplit", f"""
WITH train AS (SELECT doc_id, quality FROM labels l JOIN ({sql_histogram('labels', 'quality', 'doc_id', 42)}) h
               ON l.quality = h.label AND h.slot = {sql_slot('doc_id', 42)} WHERE h.last > round(h.n_class * 0.3))
""" + " UNION ALL ".join(f"SELECT {s} AS seed, label AS quality, sum(CASE WHEN last > round(n_class * 0.01) THEN n ELSE 0 END)::BIGINT AS n_train, any_value(n_class)::BIGINT AS n_class "
                         f"FROM ({sql_histogram('train', 'quality', 'doc_id', 1000 + s)}) GROUP BY label" for s in SUB_SEEDS))
def stratified_subsplit(spark, sf_dir):
    """K3: of the training part a stratified 99 % for each seed."""
    train, _ = ML.split(table(spark, sf_dir, "labels"), "quality", F.col("doc_id"), 0.3, seed=42)
    sizes, out = train.groupBy("quality").agg(F.count(F.lit(1)).alias("n_class")), None
    for seed in SUB_SEEDS:
        part, _ = ML.split(train, "quality", F.col("doc_id"), 0.01, seed=1000 + seed)
        part = part.groupBy("quality").agg(F.count(F.lit(1)).alias("n_train")).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out.join(sizes, "quality").select("seed", "quality", "n_train", "n_class")


@query("K4_kfold_assignment", f"""
SELECT label AS quality, floor(first * 5 / n_class)::INTEGER AS fold, sum(n)::BIGINT AS n
FROM ({sql_histogram('labels', 'quality', 'doc_id', 7)}) GROUP BY 1, 2
""")
def kfold_assignment(spark, sf_dir):
    """K4: stratified 5-fold assignment of the labelled documents, class sizes per fold."""
    return ML.with_fold(table(spark, sf_dir, "labels"), "quality", F.col("doc_id"), 5, seed=7).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- model inputs
def vectors(spark, sf_dir, binary: bool = True):
    """(vec_id, e0, e1, ..., label) with every dimension as a feature, and the features' names."""
    e = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]  # one number
    lab = (F.col("label") < 5).cast("double") if binary else F.col("label").cast("double")
    return e.select("vec_id", *[F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(n) for i, n in enumerate(names)], lab.alias("label")), names


def parts(df):
    return ML.split(df, "label", F.col("vec_id"), 0.3, seed=42)


def _fit_eval(df, features, estimator, name, scaler=None, binary=True):
    """Scores on the held-out part of a model fitted on the training part; ``estimator`` is made from
    the number of training rows."""
    train, test = parts(df)
    stages = [ML.assemble(features, "raw"), scaler("raw", "features")] if scaler else [ML.assemble(features)]
    model = Pipeline(stages=[*stages, estimator(train.count())]).fit(train)
    scored = ML.score(model, test)
    if binary:
        return ML.evaluate(scored).select(F.lit(name).alias("classifier"), *M.METRICS)
    return M.micro_scores(M.confusion(scored)).select(F.lit(name).alias("classifier"), "*")


SQL_VECTORS = f"""
WITH e AS (SELECT vec_id, label < 5 AS label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS dim FROM embeddings),
h AS ({sql_histogram('embeddings', '(label < 5)', 'vec_id', 42)}),
p AS (SELECT e.*, h.last <= round(h.n_class * 0.3) AS held_out FROM e JOIN h ON e.label = h.label AND h.slot = {sql_slot('vec_id', 42)})
"""


@query("M1_M2_scalers", f"""{SQL_VECTORS},
s AS (SELECT dim, avg(x) AS mean, stddev_samp(x) AS dev, min(x) AS least, max(x) AS most FROM p WHERE NOT held_out GROUP BY dim)
SELECT vec_id, dim, (x - mean) / dev AS standard, (x - least) / (most - least) AS minmax FROM p JOIN s USING (dim) WHERE held_out
""")
def scalers(spark, sf_dir):
    """M1 / M2: standard and min-max scaling of every dimension, fitted on the training part, applied to the held-out part."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    stages = [ML.assemble(features, "raw"), ML.standard_scaler("raw", "std"), ML.minmax_scaler("raw", "mm")]
    out = Pipeline(stages=stages).fit(train).transform(test)
    both = F.arrays_zip(vector_to_array("std").alias("standard"), vector_to_array("mm").alias("minmax"))
    return out.select("vec_id", F.posexplode(both).alias("dim", "s")).select("vec_id", "dim", "s.standard", "s.minmax")


SEEDS = (0, 1, 2)


def _seed_runs(spark, sf_dir, name, estimator, scaler=None):
    """Mean and variance of the metrics over seeded splits."""
    df, features = vectors(spark, sf_dir)
    n = int(df.count() * 0.7)
    prepare = [ML.assemble(features, "raw"), scaler("raw", "features")] if scaler else [ML.assemble(features)]
    return M.seed_summary(ML.multi_seed_runs(lambda s: estimator(n, s), df, "vec_id", features, seeds=SEEDS, classifier=name, prepare=prepare))


@query("M3_logistic_regression_seeds")
def logistic_seeds(spark, sf_dir):
    """M3 + A12: logistic regression (C = 30) on standardised features over three seeded splits."""
    return _seed_runs(spark, sf_dir, "logreg", lambda n, s: ML.logistic_regression(n), ML.standard_scaler)


@query("M4_linear_svc")
def svc(spark, sf_dir):
    """M4 + A12: linear SVM (C = 59) on min-max scaled features over three seeded splits."""
    return _seed_runs(spark, sf_dir, "svc", lambda n, s: ML.linear_svc(n), ML.minmax_scaler)


@query("M5_decision_tree")
def tree(spark, sf_dir):
    """M5 + A12: decision tree (depth 24) over three seeded splits."""
    return _seed_runs(spark, sf_dir, "tree", lambda n, s: ML.decision_tree(24, seed=s))


@query("M6_random_forest")
def forest(spark, sf_dir):
    """M6: entropy random forest (340 trees, depth 17) with class weights 1:2."""
    df, features = vectors(spark, sf_dir)
    return _fit_eval(ML.class_weights(df, positive_weight=2.0), features, lambda n: ML.random_forest(340, 17, weight="weight"), "forest")


@query("M7_boosted_trees")
def boosted(spark, sf_dir):
    """M7: gradient-boosted trees (320 rounds, depth 3) with a positive-class weight."""
    df, features = vectors(spark, sf_dir)
    return _fit_eval(ML.class_weights(df, positive_weight=4.5), features, lambda n: ML.boosted_trees(weight="weight"), "gbt")


@query("M8_multiclass")
def multiclass(spark, sf_dir):
    """M8: ten-class forest, micro-averaged scores."""
    df, features = vectors(spark, sf_dir, binary=False)
    return _fit_eval(df, features, lambda n: ML.multiclass_trees(10), "multiclass_forest", binary=False)


@query("M9_gaussian_nb")
def naive_bayes(spark, sf_dir):
    """M9: Gaussian naive Bayes."""
    df, features = vectors(spark, sf_dir)
    return _fit_eval(df, features, lambda n: ML.gaussian_nb(), "gaussian_nb")


@query("M10_mlp")
def network(spark, sf_dir):
    """Feed-forward network on standardised features, with the original's proportions of layers."""
    df, features = vectors(spark, sf_dir)
    d = len(features)
    return _fit_eval(df, features, lambda n: ML.mlp([d, 8 * d, 2 * d, d, 2]), "mlp", ML.standard_scaler)


@query("M11_grid_search")
def grid_search(spark, sf_dir):
    """Regularisation grid x 3 stratified folds: mean F1 on the folds left out and on the rows
    trained on, and the best grid point."""
    df, features = vectors(spark, sf_dir)
    df = ML.with_fold(df, "label", F.col("vec_id"), 3, seed=3)
    # kept once: the fits read a table in pieces by its size, not the folds' join with a task result a shuffle partition
    asm = saved(ML.assemble(features).transform(df).select("vec_id", "label", "fold", "features"), "grid")
    regs = [0.0001, 0.01, 1.0]
    lr = ML.logistic_regression(asm.count())
    cvm = ML.grid_search(lr, {"regParam": regs}, asm, "fold", parallelism=3)
    rows = []
    for i, (reg, mean) in enumerate(zip(regs, cvm.avgMetrics)):
        fitted = lr.copy({lr.regParam: reg}).fit(asm)
        trained = ML.evaluate(ML.score(fitted, asm)).first()["f1"]
        rows.append((float(reg), float(mean), float(trained), i == max(range(len(regs)), key=lambda k: cvm.avgMetrics[k])))
    return spark.createDataFrame(rows, "reg_param DOUBLE, mean_f1 DOUBLE, train_f1 DOUBLE, is_best BOOLEAN")


@query("M13_parameter_sweep")
def sweep(spark, sf_dir):
    """One-parameter sweep (tree depth), precision / recall / F1 / FPR per value."""
    df, features = vectors(spark, sf_dir)
    out = None
    for depth in (2, 4, 8):
        m = _fit_eval(df, features, lambda n, depth=depth: ML.decision_tree(depth), f"depth_{depth}")
        out = m if out is None else out.unionByName(m)
    return out


@query("M14_M15_scoring")
def scoring(spark, sf_dir):
    """M14 + M15: held-out predictions with positive-class probability; log loss / AUC / error."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    model = Pipeline(stages=[ML.assemble(features), ML.logistic_regression(train.count())]).fit(train)
    scored = ML.score(model, test).cache()
    q = ML.log_loss_auc(scored)
    return scored.select("vec_id", "label", "prediction", "p_positive",
                         F.lit(q["log_loss"]).alias("log_loss"), F.lit(q["auc"]).alias("auc"),
                         F.lit(q["error"]).alias("error"))


@query("M16_feature_importance")
def importance(spark, sf_dir):
    """M16 + T2 + A19: the 20 largest split-gain importances of a forest, ranked, min-max normalised."""
    df, features = vectors(spark, sf_dir)
    model = Pipeline(stages=[ML.assemble(features), ML.random_forest()]).fit(parts(df)[0])
    imp = spark.createDataFrame(ML.feature_importances(model, features), "feature STRING, mean_abs DOUBLE")
    return X.top_k(X.min_max_normalise(imp), 20)


@query("T2_ranked_features", f"SELECT row_number() OVER (ORDER BY mean_abs DESC, feature) AS place, feature, mean_abs FROM ({SQL_MEAN_ABS}) ORDER BY place LIMIT 20")
def ranked_features(spark, sf_dir):
    """The 20 features of the largest importance, with their places."""
    return X.ranked(attributions_importance(spark, sf_dir), 20)


def attributions_importance(spark, sf_dir):
    return X.mean_abs(attributions(spark, sf_dir))


@query("T4_sorted_events", "SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place, event_id, value FROM events WHERE event_type = 'purchase'")
def sorted_events(spark, sf_dir):
    """T4: extracted rows sorted by value, descending, nulls last; the place makes the order visible."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "value")
    return X.sorted_places(e, [F.col("value").desc_nulls_last(), F.col("event_id").asc()])


@query("M17_permutation_importance")
def permutation(spark, sf_dir):
    """F1 drop on held-out rows when each feature is permuted."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    model = Pipeline(stages=[ML.assemble(features), ML.random_forest(340, 17)]).fit(train)
    return ML.permutation_importance(model, test, features, "vec_id")
