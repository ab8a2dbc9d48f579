"""Grid search with train and test scores of each fold, chosen by the weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .blocks import saved


class WeightedScore(Evaluator):
    """The weighted score of a scored table, usable wherever Spark ML takes an evaluator. The overfit term
    needs the training accuracy, as ``train_accuracy``."""

    def __init__(self, label: str = "label", prediction: str = "prediction", weights=(0.1, 0.2, 0.6, 0.0, -0.1), train_accuracy: float | None = None):
        super().__init__()
        self.label, self.prediction, self.weights, self.train_accuracy = label, prediction, weights, train_accuracy

    def _evaluate(self, dataset: DataFrame) -> float:
        found = M.binary_metrics(M.binary_counts(dataset, self.label, self.prediction))
        if self.train_accuracy is not None:
            found = found.withColumn("_train", F.lit(float(self.train_accuracy)))
        row = M.weighted_score(found, "_train" if self.train_accuracy is not None else None, self.weights).first()
        return float(row["weighted_score"])

    def isLargerBetter(self) -> bool:
        return True


def grid_scores(estimator, points: list[dict], df: DataFrame, fold: str = "fold", folds: int = 5, label: str = "label") -> DataFrame:
    """(point, fold, side, n, tn, fp, fn, tp and their metrics): for each grid point and fold the model fitted on the other
    folds, scored on the fold (side test) and on the rows it was fitted on (side train).

    All rows are scored once by each model and tagged with their side; what is kept of them is a
    confusion row a side. The models are fitted one after the other, each by all executors.
    """
    data = saved(df, "grid")
    parts = []
    for p, params in enumerate(points):
        candidate = estimator.copy({getattr(estimator, k): v for k, v in params.items()})
        for k in range(folds):
            model = candidate.fit(data.filter(F.col(fold) != k))
            side = F.when(F.col(fold) == k, "test").otherwise("train")
            tagged = model.transform(data).select(F.lit(p).alias("point"), F.lit(k).alias("fold"), side.alias("side"), label, "prediction")
            parts.append(M.binary_counts(tagged, label, "prediction", 1, "point", "fold", "side"))
    found = saved(reduce(DataFrame.unionByName, parts), "grid_scores")
    return M.binary_metrics(found.withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def best_point(scores: DataFrame, weights=(0.1, 0.2, 0.6, 0.0, -0.1)) -> DataFrame:
    """(point, mean_test, mean_train, is_best): mean weighted score of the test sides, with the overfit term from the
    train side of the same fold; the largest is best, the first of equals. A row for each point."""
    train = scores.filter("side = 'train'").select(F.col("point").alias("_p"), F.col("fold").alias("_f"), F.col("accuracy").alias("_train"), F.col("f1").alias("_train_f1"))
    both = scores.filter("side = 'test'").join(train, (F.col("point") == F.col("_p")) & (F.col("fold") == F.col("_f")))
    means = M.weighted_score(both, "_train", weights).groupBy("point").agg(F.avg("weighted_score").alias("mean_test"), F.avg("_train_f1").alias("mean_train"))
    top = F.max(F.struct("mean_test", -F.col("point"))).over(Window.partitionBy())  # over a row for each point
    return means.select("point", "mean_test", "mean_train", (F.struct("mean_test", -F.col("point")) == top).alias("is_best"))
