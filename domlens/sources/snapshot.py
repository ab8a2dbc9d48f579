"""A keyed table that batches are merged into, in hash buckets under versioned manifests (F4 + U5 + S4).

``root/data/<batch>/bucket=k`` holds the rows of the buckets that a batch touched, ``root/manifest/<version>``
one row a bucket: where its present rows lie, and which batch wrote them. A batch reads and rewrites
only the buckets that its keys fall into. What it wrote counts from the moment its manifest, a single
file, is in place; a batch that was cut off before that has changed nothing, and one that is retried
after it is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.setops import merge_keep_first
from .io import path_exists, table_path

MANIFEST_DDL = "version LONG, bucket INT, path STRING, batch STRING"
BUCKETS = 64


class KeyedSnapshot:
    """``order`` says which of a batch's rows of one key is first; rows that are there win over new ones."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root, key, order, buckets

    def _manifest(self) -> list:
        """Rows of the last version: one a bucket, and one (bucket -1) a batch that has been merged."""
        path = table_path(self.root, "manifest")
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.schema(MANIFEST_DDL).option("recursiveFileLookup", True).parquet(path)
        last = rows.agg(F.max("version")).first()[0]
        return rows.filter(F.col("version") == last).collect() if last is not None else []  # bounded by the buckets and batches

    def rows(self) -> DataFrame | None:
        """The present table; None before the first batch."""
        return self._read([r["path"] for r in self._manifest() if r["bucket"] >= 0])

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*sorted(set(paths))) if paths else None

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def new_keys(self, listed: DataFrame) -> DataFrame:
        """the rows of ``listed`` whose key has no result yet."""
        have = self.rows()
        return listed if have is None else listed.join(have.select(F.col(self.key).alias("_have")), F.col(self.key).eqNullSafe(F.col("_have")), "left_anti")

    def merge(self, batch: DataFrame, batch_id: str) -> bool:
        """Merge a batch, once; False if it has been merged before. An empty batch is noted, too."""
        manifest = self._manifest()
        if any(r["bucket"] < 0 and r["batch"] == batch_id for r in manifest):
            return False
        at = {r["bucket"]: r for r in manifest if r["bucket"] >= 0}
        folder = table_path(self.root, f"data/{batch_id}-{uuid.uuid4().hex[:8]}")
        fresh = table_path(folder, "batch")
        batch.withColumn("_bucket", self._bucket()).write.parquet(fresh)  # read twice below
        fresh = self.spark.read.parquet(fresh)
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # ``buckets`` numbers at most
        new = fresh.drop("_bucket")
        old = self._read([at[b]["path"] for b in touched if b in at])
        merged = merge_keep_first(old.select(*new.columns) if old is not None else new.limit(0), new, self.order, self.key)
        merged.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(table_path(folder, "rows"))
        version = 1 + max((r["version"] for r in manifest), default=0)
        rows = [(version, b, table_path(folder, f"rows/bucket={b}"), batch_id) for b in touched]
        rows += [(version, b, r["path"], r["batch"]) for b, r in at.items() if b not in touched]
        rows += [(version, -1, "", r["batch"]) for r in manifest if r["bucket"] < 0] + [(version, -1, "", batch_id)]
        self._commit(version, rows)
        return True

    def _commit(self, version: int, rows: list[tuple]) -> None:
        """One file in a folder of its own: a second writer of the same version fails."""
        self.spark.createDataFrame(rows, MANIFEST_DDL).coalesce(1).write.mode("errorifexists").parquet(table_path(self.root, f"manifest/{version:012d}"))
