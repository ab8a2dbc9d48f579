"""Shared helpers: tables, shared scratch tables, UTF-8 batches, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of text that a task's Python code handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is unset and Spark runs in local mode (tests) is a temporary folder
    taken; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="domlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost
    executors and is read instead of being computed again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's JVM collects garbage, which
    it may not do for long; an operator of many jobs asks for it when large ones are done."""
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow batches of texts
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``limit`` bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While it lasts, tasks send Python ``rows`` rows at once: texts of a few KB then take a few MB on either
    side. For work that is carried out inside (written or collected), as the caller's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give Arrow's unused memory back when a task is done: its process stays for the next ones."""
    pa.default_memory_pool().release_unused()


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed, so that columns of other names can never clash."""
    return df.select(*[F.col(f"`{have}`").alias(want) for want, have in columns.items()])


# ---------------------------------------------------------------- prefix sums
def running_totals(df: DataFrame, order: list[Column], sums: list[str], group: str | None = None) -> DataFrame:
    """Add ``row`` (0-based place) and, for each column of ``sums``, ``before_<column>`` (sum of all
    rows placed earlier), in the given order, within ``group`` if one is named.

    ``df`` holds narrow rows. They are dealt out by range and written with the number of their
    range; each range is summed on its own, and the prefix sums of the ranges' totals (a row for
    each range and group) are added. Rows that are equal in every column may be dealt to several
    ranges, so that no repeated row makes a range large.
    """
    spark, parts = df.sparkSession, width(df.sparkSession)
    keys = [F.col(group).asc_nulls_last()] if group else []
    df = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
    dealt = written(df.repartitionByRange(parts, *keys, *order, F.col("_salt")).withColumn("_range", F.spark_partition_id()), "ranges")
    part = ["_range"] + ([group] if group else [])
    own = W.partitionBy(*part).orderBy(*order, F.col("_salt"))
    total = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    over = (W.partitionBy(group) if group else W.partitionBy()).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(F.col("_range").alias("_at"), *([F.col(group).alias("_group")] if group else []), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_rows"), *[F.coalesce(F.sum(f"_t_{c}").over(over), F.lit(0)).alias(f"_b_{c}") for c in sums])
    rows = dealt.withColumn("_row", F.row_number().over(own).cast("long") - 1)
    for c in sums:
        rows = rows.withColumn(f"_s_{c}", F.sum(c).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(c))
    on = rows["_range"] == total["_at"]
    if group:
        on = on & rows[group].eqNullSafe(total["_group"])
    out = rows.join(total, on, "left")
    keep = [rows[c] for c in df.columns if c != "_salt"]
    return out.select(*keep, (F.col("_row") + F.col("_rows")).alias("row"), *[(F.col(f"_s_{c}") + F.col(f"_b_{c}")).alias(f"before_{c}") for c in sums])
