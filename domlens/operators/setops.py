"""Keyed set operations on labelled domain tables.

Tables are keyed by ``domain_name``.  Key comparison is null-safe where the
original compared with ``isin`` (which matches a missing key to a missing key).
Nothing here collects a group: per-key decisions use map-side-combinable
aggregates (``min``, ``min_by``) and a join back, so a key holding a third of
all rows is pre-aggregated per task and its join partition is split by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "domain_name"
SPAN = 4_096  # copies of a row that one row stands for until they are made
TASK_COPIES = 4_000_000  # copies that a task makes


def _keys(df: DataFrame, key: str, alias: str = "_k") -> DataFrame:
    return df.select(F.col(key).alias(alias))


def semi_join(df1: DataFrame, df2: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of df1 whose key occurs in df2 (df1's duplicates kept)."""
    k2 = _keys(df2, key)
    return df1.join(k2, df1[key].eqNullSafe(k2["_k"]), "left_semi")


def anti_join(df1: DataFrame, df2: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of df1 whose key does not occur in df2."""
    k2 = _keys(df2, key)
    return df1.join(k2, df1[key].eqNullSafe(k2["_k"]), "left_anti")


def right_anti_join(df1: DataFrame, df2: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of df2 whose key does not occur in df1 (Arrow join: NULL keys never match)."""
    k1 = _keys(df1, key)
    return df2.join(k1, df2[key] == k1["_k"], "left_anti")


def keyed_union(df1: DataFrame, df2: DataFrame, key: str = KEY) -> DataFrame:
    """df1 plus the rows of df2 whose key is not in df1; columns aligned to df1.

    A column of df1 missing from df2 raises (``select`` fails), as in the original.
    """
    return df1.unionByName(anti_join(df2.select(*df1.columns), df1, key))


def keyed_union_fold(tables: list[DataFrame], key: str = KEY) -> DataFrame:
    """Fold of U1 over N tables -- an earlier table wins a key.

    One pass: tag each table with its rank, union all, take the minimum rank per
    key with a combinable aggregate, keep rows whose rank is that minimum.  Rows
    with a NULL key are all kept (a join on NULL never matches).
    """
    cols = tables[0].columns
    tagged = reduce(DataFrame.unionByName,
                    [t.select(*cols).withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)])
    best = tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_rank").alias("_rank"))
    best = best.select(F.col(key).alias("_key"), F.col("_rank").alias("_best"))
    joined = tagged.join(best, tagged[key] == best["_key"], "left")
    return joined.filter(F.col(key).isNull() | (F.col("_rank") == F.col("_best"))).select(*cols)


def concat_all(tables: list[DataFrame]) -> DataFrame:
    """U4: bag union after aligning every table to the first one's columns."""
    cols = tables[0].columns
    return reduce(DataFrame.unionByName, [t.select(*cols) for t in tables])


def merge_keep_first(old: DataFrame, new: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """Old rows win over new ones; within a side the lowest ``order`` wins.

    ``min_by`` over a struct is a map-side-combinable aggregate: one candidate per
    key per task crosses the shuffle, however hot the key.
    """
    cols = old.columns
    both = old.select(*cols).withColumn("_new", F.lit(0)).unionByName(
        new.select(*cols).withColumn("_new", F.lit(1)))
    picked = both.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct("_new", order)).alias("_row"))
    return picked.select("_row.*")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column."""
    return df.select(column).distinct()


def lookup_copy(names: DataFrame, table: DataFrame, key: str = KEY) -> DataFrame:
    """Every table row matching a listed name, once per listing (duplicates multiply).

    A name that is listed often is one row with its count, so that only the table's rows of a hot name
    meet. A row's copies are cut into spans, and the spans dealt to tasks in a number that follows all copies,
    so that no task makes all copies of a hot name."""
    listed = names.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_times"))
    met = table.join(listed, table[key] == listed["_key"]).drop("_key")
    copies = met.agg(F.sum("_times")).first()[0] or 0  # one number
    spans = met.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(SPAN).cast("long"))))
    if copies > TASK_COPIES:
        spans = spans.repartition(-(-copies // TASK_COPIES))
    last = F.least(F.col("_from") + SPAN, F.col("_times")) - 1
    return spans.withColumn("_copy", F.explode(F.sequence("_from", last))).drop("_times", "_from", "_copy")
