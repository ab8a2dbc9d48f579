"""Exact ranking quality of scores (M15): the area under the curve as a rank sum, log loss and error, by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import saved

LEAST = 1e-15  # probabilities are kept this far from 0 and 1


def auc(scored: DataFrame, score: str = "score", label: str = "label", group: str = "model") -> DataFrame:
    """(group, n_pos, n_neg, auc): the share of (positive, negative) pairs in which the positive scores higher, half for ties.

    Rows are first counted by (group, score), so tied rows are one; these are dealt by range of both,
    and the negatives below a score are those before it in its range plus the totals of the ranges
    before. Null scores and labels take no part; a group without one of the two classes has a null area.
    """
    w = F.col(label).cast("double")
    each = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(score).alias("_s")).agg(
        F.sum(F.when(w == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(w == 1, 0).otherwise(1)).alias("_neg"))
    dealt = saved(each.repartitionByRange(F.col("_g"), F.col("_s")).withColumn("_range", F.spark_partition_id()), "scores")
    # a row for each (group, range)
    ends = dealt.groupBy("_g", "_range").agg(F.sum("_neg").alias("_n"))
    ends = ends.select(F.col("_g").alias("_g2"), F.col("_range").alias("_r2"), (F.sum("_n").over(Window.partitionBy("_g").orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum("_neg").over(Window.partitionBy("_g", "_range").orderBy("_s")) - F.col("_neg")
    placed = dealt.withColumn("_inside", inside).join(ends, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_range") == F.col("_r2")))
    wins = (F.col("_pos") * (2 * (F.col("_inside") + F.col("_before")) + F.col("_neg"))).cast("decimal(38,0)")
    out = placed.groupBy(F.col("_g").alias(group)).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(wins).cast("double").alias("_wins"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg") * 2
    return out.select(group, "n_pos", "n_neg", F.when(pairs > 0, F.col("_wins") / pairs).alias("auc"))


def log_loss(scored: DataFrame, score: str = "score", label: str = "label", group: str = "model", threshold: float = 0.5) -> DataFrame:
    """(group, log_loss, error) of probabilities; one pass, combined before the shuffle."""
    p = F.least(F.greatest(F.col(score), F.lit(LEAST)), F.lit(1 - LEAST))
    y = F.col(label).cast("double") == 1
    wrong = y != (F.col(score) > threshold)
    kept = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return kept.groupBy(group).agg(F.avg(-F.when(y, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"), F.avg(wrong.cast("double")).alias("error"))


def report(scored: DataFrame, score: str = "score", label: str = "label", group: str = "model") -> DataFrame:
    """(group, n_pos, n_neg, auc, log_loss, error); the scores are computed once."""
    kept = saved(scored.select(group, F.col(score).cast("double").alias(score), label), "scored")
    loss = log_loss(kept, score, label, group).withColumnRenamed(group, "_model")
    found = auc(kept, score, label, group)
    return found.join(loss, found[group].eqNullSafe(loss["_model"])).drop("_model")
