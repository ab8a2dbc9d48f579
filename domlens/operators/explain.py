"""Feature attribution and importance reports.

Input is a long table ``(sample_id, feature, value)``.  Every report is a
combinable aggregate (``avg``, ``max_by``, counts) plus top-k by
``orderBy(...).limit(k)``; per-feature groups are never collected -- the
"sample list" of a feature is returned exploded, one row per sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PREFIX_RE = "^[a-z]+_"


def mean_abs(attr: DataFrame) -> DataFrame:
    """Mean |attribution| per feature."""
    return attr.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))


def prefix_means(importance: DataFrame) -> DataFrame:
    """Mean of A14 per feature-family prefix (``lex_``, ``dns_`` ...)."""
    return importance.groupBy(F.regexp_extract("feature", PREFIX_RE, 0).alias("prefix")) \
        .agg(F.avg("mean_abs").alias("prefix_mean_abs"), F.count(F.lit(1)).alias("n_features"))


def top_k(importance: DataFrame, k: int, column: str = "mean_abs", ascending: bool = False) -> DataFrame:
    """The k most (or least) important features, ties by name."""
    order = F.asc(column) if ascending else F.desc(column)
    return importance.orderBy(order, F.asc("feature")).limit(k)


def ranked(importance: DataFrame, k: int, column: str = "mean_abs") -> DataFrame:
    """The k largest with their places from 1 (a window over k rows)."""
    return top_k(importance, k, column).withColumn("place", F.row_number().over(Window.orderBy(F.desc(column), F.asc("feature"))).cast("long"))


def sorted_places(df: DataFrame, order: list) -> DataFrame:
    """T4: rows in a global order, with their places from 1.  A range-partitioned sort, kept in the
    checkpoint folder; the places come from the sizes of the ranges before (one row per range) and
    the place inside the range."""
    own = Window.partitionBy("_range").orderBy(*order)
    dealt = cut_lineage(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    placed = dealt.withColumn("_at", F.row_number().over(own))
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn("place", F.col("_at") + F.col("_before")).select("place", *df.columns)


def top_k_per_prefix(importance: DataFrame, k: int) -> DataFrame:
    """How many of the top-k features each prefix has (prefixes with none kept at 0)."""
    prefixes = importance.select(F.regexp_extract("feature", PREFIX_RE, 0).alias("prefix")).distinct()
    top = top_k(importance, k).groupBy(F.regexp_extract("feature", PREFIX_RE, 0).alias("prefix")) \
        .agg(F.count(F.lit(1)).alias("n_top"))
    return prefixes.join(top, "prefix", "left").fillna(0, ["n_top"])


def strongest_feature(attr: DataFrame) -> DataFrame:
    """Per sample, the feature with the largest |attribution| (ties: larger name,
    then larger value) and its attribution.  ``max_by`` is combined map-side, so a sample with many
    rows never needs to sit in one task."""
    return attr.groupBy("sample_id").agg(
        F.max_by(F.struct("feature", "value"), F.struct(F.abs("value"), F.col("feature"), F.col("value"))).alias("_b")) \
        .select("sample_id", F.col("_b.feature").alias("feature"), F.col("_b.value").alias("value"))


def feature_summary(strongest: DataFrame, digits: int = 2) -> DataFrame:
    """Per feature, modal (rounded) value (ties: smallest) and how many samples
    name it, returned exploded -- one row per (feature, sample)."""
    r = strongest.withColumn("_v", F.round("value", digits))
    modes = r.groupBy("feature", "_v").agg(F.count(F.lit(1)).alias("_c")) \
        .groupBy("feature").agg(F.max_by("_v", F.struct("_c", -F.col("_v"))).alias("modal_value"),
                                F.sum("_c").alias("n_samples"))
    # one row per feature: Spark broadcasts it below its own size threshold, and else splits hot
    # features' partitions (AQE)
    return r.select("feature", "sample_id", "value").join(modes, "feature")


def min_max_normalise(importance: DataFrame, column: str = "mean_abs") -> DataFrame:
    """(x - min) / (max - min) over the whole vector (0 when all equal)."""
    # an importance vector has one row per feature (bounded by the feature count),
    # so a global window over it is a single small task
    w = Window.partitionBy()
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return importance.withColumn(
        "normalised", F.when(hi == lo, F.lit(0.0)).otherwise((F.col(column) - lo) / (hi - lo)))


def importances_table(names: list[str], values) -> list[tuple[str, float]]:
    """Pair a fitted model's ``featureImportances`` with the assembler's input names."""
    arr = values.toArray() if hasattr(values, "toArray") else list(values)
    return [(n, float(v)) for n, v in zip(names, arr)]
