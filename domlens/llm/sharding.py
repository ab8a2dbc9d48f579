"""Sharding by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, running_totals

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of near equal bytes, in ascending document order (DataFrame functions only).

    The rows (id, size, checksum; never the text) are dealt out by range of the id; per-partition
    totals give global prefix sums, and a row lies in the shard in whose equal share of all bytes
    its middle lies. Only a document larger than a share can make shards differ by more than the
    sizes of the documents at their ends.

    Null and empty texts have size 1, the record's end mark. Null ids come first. Repeated rows
    and ids are placed each on its own; equal rows are interchangeable. An empty table gives no
    rows; other columns are ignored. Every document is its own group: equal texts are spread like
    any other, as a large group of copies would unbalance shards otherwise.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = running_totals(rows, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], ["size"])
    total = placed.agg(F.max(F.col("before_size") + F.col("size"))).first()[0] or 1  # one number
    # decimal arithmetic: the middle times twice the shards exceeds a long from 2^58 bytes on
    middle = (F.col("before_size") * 2 + F.col("size")).cast("decimal(38,0)")
    cut = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(2 * total).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1)))
    first = cut.groupBy("shard").agg(F.min("row").alias("_first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

