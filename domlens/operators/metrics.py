"""Classifier evaluation as Spark aggregations.

Scored rows are reduced once to a confusion table -- ``groupBy(label, pred)``,
combined map-side, so its size is (#classes)^2 whatever the row count -- and
every metric is arithmetic over that small table.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(num: Column, den: Column, zero: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(zero)).otherwise(num.cast("double") / den)


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction", *group: str) -> DataFrame:
    """A7 (k x k): one row per (group..., label, prediction) with its count ``n``."""
    return df.groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def binary_counts(df: DataFrame, label: str = "label", pred: str = "prediction", positive=1,
                  *group: str) -> DataFrame:
    """A7 (binary): TN, FP, FN, TP per group (one aggregation, combined map-side)."""
    y, p = F.col(label) == positive, F.col(pred) == positive

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*group).agg(cnt(~y & ~p).alias("tn"), cnt(~y & p).alias("fp"),
                                  cnt(y & ~p).alias("fn"), cnt(y & p).alias("tp"))


def binary_metrics(counts: DataFrame, zero_division: float = 0.0) -> DataFrame:
    """A8 + A9 from TN/FP/FN/TP columns: accuracy, precision, recall (= TPR), F1, FPR,
    and the class-weighted accuracy (TPR*P + TNR*N) / total, which equals accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    precision = _div(tp, tp + fp, zero_division)
    recall = _div(tp, tp + fn)
    tnr = _div(tn, tn + fp)
    return counts.withColumns({
        "accuracy": _div(tp + tn, total),
        "precision": precision,
        "recall": recall,
        "f1": _div(2 * tp, 2 * tp + fp + fn),
        "fpr": _div(fp, fp + tn),
        "tpr": recall,
        "weighted_accuracy": _div(recall * (tp + fn) + tnr * (tn + fp), total),
    })


def per_class_report(conf: DataFrame) -> DataFrame:
    """A11 from a confusion table (label, prediction, n): per class precision / recall /
    f1 / support, then ``macro avg`` and ``weighted avg`` rows (classes with no
    prediction get precision 0, as the default zero_division does)."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    roles = F.array(F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
                    F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    cells = conf.select(F.explode(roles).alias("r")).select("r.*").filter("cls is not null")
    per = cells.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    per = per.select(
        F.col("cls").cast("string").alias("class"),
        _div(F.col("tp"), F.col("predicted")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )
    # every class is a row of its own and has a part in both averages: one small table, read once
    rows = per.select(F.explode(F.array(F.struct(F.col("class"), F.lit(1.0).alias("w")), F.struct(F.lit("macro avg").alias("class"), F.lit(1.0).alias("w")),
                                        F.struct(F.lit("weighted avg").alias("class"), F.col("support").cast("double").alias("w")))).alias("k"), "precision", "recall", "f1", "support")
    weight = F.col("k.w")
    return rows.groupBy(F.col("k.class").alias("class")).agg(
        *[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def micro_scores(conf: DataFrame) -> DataFrame:
    """A10: micro-averaged precision / recall / F1 over a confusion table (single-label:
    all three equal the share of correct predictions)."""
    agg = conf.agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("c"),
                   F.sum("n").alias("t"))
    v = _div(F.col("c"), F.col("t"))
    return agg.select(v.alias("micro_precision"), v.alias("micro_recall"), v.alias("micro_f1"))


METRICS = ("accuracy", "precision", "recall", "f1", "fpr")


def to_long(wide: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """Unpivot metric columns to (keys..., metric, value)."""
    return wide.unpivot(keys, list(metrics), "metric", "value")


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean and sample variance (ddof = 1) per (classifier, metric) over seeds."""
    return runs.groupBy("classifier", "metric").agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("variance"),
        F.count(F.lit(1)).alias("runs"))


def best_flags(summary: DataFrame) -> DataFrame:
    """Flag the best classifier per metric (max mean; min for FPR)."""
    w = Window.partitionBy("metric")  # over the small summary table (classifiers x metrics)
    best = F.when(F.col("metric") == "fpr", F.min("mean").over(w)).otherwise(F.max("mean").over(w))
    return summary.withColumn("is_best", F.col("mean") == best)


def weighted_score(m: DataFrame, train_accuracy: str | None = None,
                   weights=(0.1, 0.2, 0.6, 0.0, -0.1)) -> DataFrame:
    """Custom score = wP*P + wR*R + wF*F1 + wFPR*FPR + wO*(train - validation accuracy)."""
    wp, wr, wf, wfpr, wo = weights
    overfit = (F.col(train_accuracy) - F.col("accuracy")) if train_accuracy else F.lit(0.0)
    return m.withColumn("weighted_score", wp * F.col("precision") + wr * F.col("recall") + wf * F.col("f1")
                        + wfpr * F.col("fpr") + wo * overfit)
