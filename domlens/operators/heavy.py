"""Exact top counts of a corpus too large to count every item: mergeable summaries, then a recount (A2).

Each task keeps a summary of bounded size for every group (Misra and Gries): counts that may be too low by at
most the summary's error. Summaries of all tasks add up, and so do their errors. Items that can be
among the first are recounted exactly; if an item outside all summaries could still be among them,
every item is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import saved

CAPACITY = 100_000  # items of one group's summary in a task


def _shrink(held: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """The ``capacity`` largest, each less by the next one's count, and that count."""
    if len(held) <= capacity:
        return held, 0
    less = sorted(held.values(), reverse=True)[capacity]
    return {k: v - less for k, v in held.items() if v > less}, less


def summaries(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(grp, item, low, error) from rows (grp, item, times): for each task and group the summary's
    counts, and one row without an item that has its error."""
    schema = pa.schema([("grp", pa.string()), ("item", pa.string()), ("low", pa.int64()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        error: dict[str, int] = {}
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["grp", "item"]).aggregate([("times", "sum")])
            for g, item, n in zip(*(sums.column(c).to_pylist() for c in ("grp", "item", "times_sum")), strict=True):
                own = held.setdefault(g, {})
                own[item] = own.get(item, 0) + n
            for g, own in held.items():
                if len(own) > 2 * capacity:
                    held[g], less = _shrink(own, capacity)
                    error[g] = error.get(g, 0) + less
        for g, own in held.items():
            own, less = _shrink(own, capacity)
            keys = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([g] * (len(keys) + 1), pa.string()), pa.array([*keys, None], pa.string()),
                                              pa.array([*own.values(), 0], pa.int64()), pa.array([0] * len(keys) + [error.get(g, 0) + less], pa.int64())], schema=schema)

    return items.select("grp", "item", "times").mapInArrow(run, "grp string, item string, low long, error long")


def _first(counts: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """(grp, item, cnt, rank): the ``k`` largest of each group, ties by item; ``most`` is the largest k."""
    own = Window.partitionBy("grp").orderBy(F.desc("cnt"), F.asc("item"))
    ranked = counts.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most)
    return ranked.join(limits, "grp").filter("rank <= k").drop("k")


def top_counts(items: DataFrame, limits: dict[str, int], capacity: int = CAPACITY) -> tuple[DataFrame, bool]:
    """((grp, item, cnt): the ``limits[grp]`` most frequent items of each group, ties by item; whether the summaries
    sufficed). ``items`` are rows (grp, item, times) without nulls; groups without a limit are left out. The rows are read
    twice, or three times when the summaries are too small for the data; the result is exact in either case.
    """
    spark = items.sparkSession
    most = max(limits.values(), default=0)
    bounds = spark.createDataFrame(list(limits.items()), "grp string, k int")
    items = items.join(F.broadcast(bounds.select("grp")), "grp", "left_semi")  # a row for each group
    found = saved(summaries(items, capacity), "summaries")
    error = found.groupBy("grp").agg(F.sum("error").alias("error"))
    low = found.filter("item is not null").groupBy("grp", "item").agg(F.sum("low").alias("cnt"))
    least = _first(low, bounds, most).groupBy("grp").agg(F.min("cnt").alias("least"), F.count(F.lit(1)).alias("n")).join(bounds, "grp")
    # fewer items than asked for: any item can be among them
    least = least.select("grp", F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(F.lit(0)).alias("least"))
    able = saved(low.join(least, "grp").join(error, "grp").filter(F.col("cnt") + F.col("error") >= F.col("least")).select("grp", "item"), "survivors")
    exact = items.join(able, ["grp", "item"], "left_semi").groupBy("grp", "item").agg(F.sum("times").alias("cnt"))
    first = saved(_first(exact, bounds, most), "first")
    # an item that no summary holds occurs at most ``error`` times
    last = bounds.join(first.groupBy("grp").agg(F.min("cnt").alias("last"), F.count(F.lit(1)).alias("n")), "grp", "left")
    short = last.join(error, "grp").filter("error > 0 and (coalesce(n, 0) < k or last <= error)")
    if not short.head(1):
        return first.select("grp", "item", "cnt"), True
    every = items.groupBy("grp", "item").agg(F.sum("times").alias("cnt"))
    return _first(every, bounds, most).select("grp", "item", "cnt"), False
