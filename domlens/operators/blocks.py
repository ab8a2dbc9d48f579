"""Rows packed into blocks of arrays, for learners that sum over all rows again and again.

A block is one row of a table in the shared folder: up to BLOCK_ROWS feature rows, labels, weights and a
learner's state as bytes. Sums over blocks are added on the executors: arrays whose size follows the model,
never the data, of which the driver gets one a step.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .trees import matrix

BLOCK_ROWS = 8_192
DDL = "number long, n int, x binary, y binary, w binary, state binary"
_SCHEMA = pa.schema([("number", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("w", pa.binary()), ("state", pa.binary())])


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_blocks(df: DataFrame, features: list[str], label: str, weight: str | None = None,
               pack: Callable[[np.ndarray], np.ndarray] = lambda x: x, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``rows`` rows of ``df``; ``pack`` maps a block's features (float64, null is NaN) to the array
    that is kept. Rows with a null label take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                x = np.ascontiguousarray(pack(matrix(part, names)))
                y, w = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([len(y)], pa.int32()), *[pa.array([v], pa.binary()) for v in (x.tobytes(), y.tobytes(), w.tobytes(), b"")]], schema=_SCHEMA)

    names = [f"f{i}" for i in range(len(features))]
    given = df.filter(F.col(f"`{label}`").isNotNull()).select(
        *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)], F.col(f"`{label}`").cast("double").alias("y"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"))
    packed = given.mapInArrow(run, DDL).withColumn("number", F.monotonically_increasing_id())
    return saved(packed, "blocks")


Block = tuple[int, int, bytes, bytes, bytes, bytes]


def total(blocks: RDD, each: Callable[[Block], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Element-wise sum over all blocks of the arrays that ``each`` returns; None without blocks."""

    def part(found: Iterator[Block]) -> Iterator[list[np.ndarray]]:
        out: list[np.ndarray] | None = None
        for block in found:
            now = each(block)
            out = now if out is None else [a + b for a, b in zip(out, now, strict=True)]
        if out is not None:
            yield out

    # partitions without blocks have nothing to add; the rest is added up on the executors, at last in one task, so that
    # the driver gets a single sum however many partitions there are (treeAggregate sends it about their square root)
    n = blocks.getNumPartitions()
    few = math.ceil(math.sqrt(n))
    parts = blocks.mapPartitionsWithIndex(lambda i, found: ((i % few, sums) for sums in part(found)))
    if few > 2:
        parts = parts.reduceByKey(_plus, few)
    if n > 1:
        parts = parts.map(lambda p: (0, p[1])).reduceByKey(_plus, 1)
    found = parts.values().collect()
    return found[0] if found else None


def _plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]
