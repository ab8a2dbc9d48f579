"""Sampling, splitting, scaling, training and evaluation on Spark ML.

Splits are stratified: each class is cut at its own quantile of a seeded hash, found from a
histogram of bounded size per class, so no class is sorted in one task.
Models are Spark ML estimators with the original parameters carried over where
Spark has an equivalent; metrics come from ``metrics.py`` (a confusion table
aggregated on the executors) so nothing but metric rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import metrics as M

# ---------------------------------------------------------------- K1-K4: sampling and splits


HASH_SLOTS = 1_000_003


def slot(key: Column, seed: int) -> Column:
    """Seeded pseudo-random slot in [0, HASH_SLOTS) of an integer key, in plain integer arithmetic
    (the key is reduced first, so no key overflows)."""
    return F.pmod(F.pmod(key, F.lit(HASH_SLOTS)) * F.lit(2654435761) + F.lit((seed + 1) * 40503), F.lit(HASH_SLOTS))


def sample_fraction(df: DataFrame, fraction: float, key: Column, seed: int = 42) -> DataFrame:
    """K1: seeded sample by a hash of the key; the same rows whatever the file splits."""
    return df.filter(slot(key, seed) < fraction * HASH_SLOTS)


def _class_histogram(df: DataFrame, label: str) -> DataFrame:
    """Rows (label, _slot, _until, _all): rows of the class up to each slot, and of the class.  A row
    for each slot in use, HASH_SLOTS per class at most, however many rows there are."""
    counts = df.groupBy(F.col(label).alias("_class"), "_slot").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_class")
    return counts.select("_class", "_slot", (F.sum("_n").over(own.orderBy("_slot"))).alias("_until"), F.sum("_n").over(own).alias("_all"), "_n")


def split(df: DataFrame, label: str, key: Column, test_fraction: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """K2 / K3: stratified (train, test).  Of every class the rows with the smallest hashes go to
    test, as many as round(test_fraction * class size) allows without parting equal hashes."""
    tagged = df.withColumn("_slot", slot(key, seed))
    cut = _class_histogram(tagged, label).groupBy("_class").agg(
        F.max(F.when(F.col("_until") <= F.round(F.col("_all") * test_fraction), F.col("_slot"))).alias("_cut"))
    # a row for each class; rows that are shuffled to it by their class end in as many tasks as there are classes, and
    # so does all that is fitted on them
    joined = tagged.join(F.broadcast(cut), tagged[label].eqNullSafe(cut["_class"]))
    in_test = F.col("_slot") <= F.coalesce("_cut", F.lit(-1))
    return joined.filter(~in_test).select(*df.columns), joined.filter(in_test).select(*df.columns)


def with_fold(df: DataFrame, label: str, key: Column, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """K4: stratified k-fold assignment (usable as ``CrossValidator(foldCol=...)``): of every class
    the fold of a row is the k-quantile that its hash lies in."""
    tagged = df.withColumn("_slot", slot(key, seed))
    h = _class_histogram(tagged, label)
    folds = h.select("_class", F.col("_slot").alias("_at"), F.floor((F.col("_until") - F.col("_n")) * k / F.col("_all")).cast("int").alias(name))
    joined = tagged.join(folds, tagged[label].eqNullSafe(folds["_class"]) & (tagged["_slot"] == folds["_at"]))
    return joined.select(*df.columns, name)


# ---------------------------------------------------------------- features

def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    """Feature columns -> one vector (the ML boundary); NULLs must be filled before."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def standard_scaler(inp: str = "features", out: str = "scaled") -> StandardScaler:
    """M1: zero mean / unit variance, fitted on the training split only (Spark uses the
    sample standard deviation, the original the population one)."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def minmax_scaler(inp: str = "features", out: str = "scaled") -> MinMaxScaler:
    """M2."""
    return MinMaxScaler(inputCol=inp, outputCol=out)


# ---------------------------------------------------------------- M3-M10: estimators

def logistic_regression(n_train: int, c: float = 30.0, features: str = "features", label: str = "label",
                        weight: str | None = None):
    """M3: L2 logistic regression; the original's C maps to regParam = 1 / (C * n)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(n_train, 1)),
                            elasticNetParam=0.0, maxIter=200)
    return lr.setWeightCol(weight) if weight else lr


def linear_svc(n_train: int, c: float = 59.0, features: str = "features", label: str = "label"):
    """M4: linear-kernel SVM (Spark has no RBF kernel), hinge loss, C -> regParam."""
    return LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(n_train, 1)), maxIter=200)


NODE_PASSES = 5  # passes over the rows from one checkpoint of their nodes to the next


def _check_depth(depth: int) -> None:
    if depth > 30:
        raise ValueError(f"Spark trees are at most 30 deep, not {depth}")


def _node_ids() -> dict:
    """Every row keeps the node of each tree that it is in. Otherwise each pass sends the trees grown so far to every task,
    which grows with rows, trees and passes at once. The same trees come out. The rows' nodes are checkpointed in the
    shared folder, so that the lineage of the passes ends."""
    checkpoint_root(SparkSession.active())
    return {"cacheNodeIds": True, "checkpointInterval": NODE_PASSES}


def decision_tree(max_depth: int = 24, features: str = "features", label: str = "label", seed: int = 42):
    """M5 (Spark trees are at most 30 deep; a deeper one is refused)."""
    _check_depth(max_depth)
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth, seed=seed, **_node_ids())


def random_forest(num_trees: int = 340, max_depth: int = 17, impurity: str = "entropy", features: str = "features",
                  label: str = "label", weight: str | None = None, seed: int = 42):
    """M6: entropy forest; class weights through a weight column (see ``class_weights``)."""
    _check_depth(max_depth)
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                impurity=impurity, seed=seed, **_node_ids())
    return rf.setWeightCol(weight) if weight else rf


def boosted_trees(max_iter: int = 320, max_depth: int = 3, step: float = 0.1, features: str = "features",
                  label: str = "label", weight: str | None = None, seed: int = 42):
    """M7: gradient-boosted trees for the boosted-ensemble family (binary)."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed)
    return gbt.setWeightCol(weight) if weight else gbt


def multiclass_trees(n_classes: int, features: str = "features", label: str = "label", boosted: bool = False,
                     seed: int = 42):
    """M8: many-class model -- a forest, or one-vs-rest boosted trees."""
    if boosted:
        return OneVsRest(classifier=boosted_trees(max_iter=50, features=features, label=label, seed=seed),
                         featuresCol=features, labelCol=label)
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=100, maxDepth=12, seed=seed, **_node_ids())


def gaussian_nb(features: str = "features", label: str = "label"):
    """M9."""
    return NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian")


def mlp(layers: list[int], features: str = "features", label: str = "label", seed: int = 42, max_iter: int = 200):
    """Feed-forward network (sigmoid hidden layers, softmax output in Spark)."""
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, seed=seed,
                                          maxIter=max_iter)


def class_weights(df: DataFrame, label: str = "label", positive_weight: float | None = None,
                  name: str = "weight") -> DataFrame:
    """Weight column: ``positive_weight`` for class 1 (as the original's 1:2 or
    scale_pos_weight), or inverse class frequency when not given (one small aggregate)."""
    if positive_weight is not None:
        return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)))
    # one pass: class sizes (one row per class) -> weights folded in as a literal map
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    total, n_cls = sum(sizes.values()), len(sizes)
    weights = F.create_map(*[x for k, c in sizes.items() for x in (F.lit(k), F.lit(total / (n_cls * c)))])
    return df.withColumn(name, F.element_at(weights, F.col(label)))


# ---------------------------------------------------------------- M11-M16: tuning, scoring, importance

def grid_search(estimator, grid: dict, train: DataFrame, fold_col: str, evaluator=None, parallelism: int = 4):
    """Grid x k-fold cross-validation (folds from ``with_fold``); returns the fitted
    CrossValidatorModel (``avgMetrics`` per grid point, best model)."""
    pg = ParamGridBuilder()
    for param, values in grid.items():
        pg = pg.addGrid(getattr(estimator, param), values)
    ev = evaluator or MulticlassClassificationEvaluator(metricName="f1", labelCol=estimator.getLabelCol())
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=pg.build(), evaluator=ev, foldCol=fold_col,
                        parallelism=parallelism, collectSubModels=False)
    return cv.fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Predictions and the positive-class probability (key columns pass through)."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("p_positive", vector_to_array("probability")[1])
    return out


def score_row(model, row: dict, df_schema: str | None = None) -> dict:
    """Prediction and positive-class probability of one row given as a dict of its features (one-row input)."""
    spark = SparkSession.active()
    df = spark.createDataFrame([row], df_schema) if df_schema else spark.createDataFrame([row])
    found = score(model, df).select("prediction", "p_positive").first()
    return {"prediction": found["prediction"], "p_positive": found["p_positive"]}


def evaluate(scored: DataFrame, label: str = "label", pred: str = "prediction", *group: str) -> DataFrame:
    """A7-A9 metrics of a scored table (binary)."""
    return M.binary_metrics(M.binary_counts(scored, label, pred, 1, *group))


def log_loss_auc(scored: DataFrame, label: str = "label") -> dict[str, float]:
    """Log loss, ROC AUC and error rate."""
    ll = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss").evaluate(scored)
    acc = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(scored)
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(scored)
    return {"log_loss": ll, "auc": auc, "error": 1.0 - acc}


def feature_importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Split-gain importances paired with feature names (driver-side: one value per feature)."""
    m = model.stages[-1] if hasattr(model, "stages") else model
    arr = m.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, arr)]


BUCKET_ROWS = 1_000


def permuted(df: DataFrame, columns: list[str], key: str, seed: int = 7, rows: int | None = None) -> DataFrame:
    """M17 helper: add ``_other``, a struct of ``columns`` of another row.  Rows are dealt to hash
    buckets of about BUCKET_ROWS rows (their number follows the rows, not a setting), and in a bucket
    each row gets the values of the next one in a seeded random order, the last those of the first:
    every row of a bucket of two or more moves."""
    rows = df.count() if rows is None else rows
    b = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(max(1, rows // BUCKET_ROWS)))
    base = df.withColumn("_b", b).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_own", F.struct(*columns))
    w = Window.partitionBy("_b").orderBy("_h", key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return base.withColumn("_other", F.coalesce(F.lead("_own").over(w), F.first("_own").over(whole))).drop("_b", "_h", "_own")


def permutation_importance(model, df: DataFrame, features: list[str], key: str, label: str = "label",
                           metric: str = "f1") -> DataFrame:
    """(feature, drop): how far ``metric`` of held-out rows falls when a feature is permuted
    (attribution re-aimed from the original's tree explainer).  ``model`` is a fitted pipeline that
    starts from the columns; all features are scored in one pass."""
    names = ["", *features]  # "": nothing permuted
    each = permuted(df, features, key).withColumn("_feature", F.explode(F.array(*map(F.lit, names))))
    each = each.withColumns({f: F.when(F.col("_feature") == f, F.col("_other")[f]).otherwise(F.col(f)) for f in features})
    found = evaluate(score(model, each.drop("_other")), label, "prediction", "_feature").select("_feature", metric)
    base = found.filter("_feature = ''").first()[metric]  # one number
    return found.filter("_feature <> ''").select(F.col("_feature").alias("feature"), (F.lit(base) - F.col(metric)).alias("f1_drop"))


def multi_seed_runs(make_estimator: Callable[[int], object], df: DataFrame, key: str, features: list[str],
                    seeds=(0, 1, 2), test_fraction: float = 0.3, label: str = "label",
                    classifier: str = "model", prepare: list | None = None) -> DataFrame:
    """A12 input: fit / score once per seed, metrics as a long table
    (classifier, seed, metric, value)."""
    spark = df.sparkSession
    rows = []
    for seed in seeds:
        train, test = split(df, label, F.col(key), test_fraction, seed)
        pipe = Pipeline(stages=[*(prepare or [assemble(features)]), make_estimator(seed)])
        model = pipe.fit(train)
        m = evaluate(score(model, test), label).collect()[0].asDict()
        for k in M.METRICS:
            rows.append((classifier, seed, k, float(m[k])))
    return spark.createDataFrame(rows, "classifier STRING, seed INT, metric STRING, value DOUBLE")
