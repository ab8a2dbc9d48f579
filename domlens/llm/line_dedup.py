"""Line deduplication over the whole corpus, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space is the space and the bytes 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (``lower`` where all is ASCII)."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _two_hashes(value: Column) -> list[Column]:
    """128 bits in two longs; the seeds come first, so that the two are independent."""
    return [F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value)]


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, text): the long lines (doc_id, row1, row2, place, key1, key2) and the keys in
    ``min_docs`` documents or more (key1, key2, first, null_first).

    Lines are combined to (key, document) and dealt by both, so that a line which a third of all
    documents hold is spread over all tasks; what is then summed by key is one row a task.
    """
    row1, row2 = _two_hashes(F.col("text"))
    lines = docs.select("doc_id", row1.alias("row1"), row2.alias("row2"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    key1, key2 = _two_hashes(F.col("key"))
    lines = lines.select("doc_id", "row1", "row2", "place", key1.alias("key1"), key2.alias("key2"))
    held = lines.groupBy("key1", "key2", "doc_id").agg(F.lit(1).alias("one"))
    keys = held.groupBy("key1", "key2").agg(F.count("one").alias("n_docs"), F.min("doc_id").alias("first"))
    return lines, keys.filter(F.col("n_docs") >= min_docs).select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "first")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every document: ``kept`` is the text without the lines whose
    key (``line_key``, ``min_chars`` code points or more) is in ``min_docs`` documents or more, except in
    the smallest document that holds it, which keeps all of them.

    Keys are compared by 128-bit hashes. What moves is (document, place, hash) of the long lines, the
    places to drop of each text, and, where Spark doesn't broadcast these, the texts, once. A text
    is reassembled from its own lines by place in time linear in their number.

    A null or empty text is one empty line and stays as it is, as a text that loses all lines becomes
    empty. Rows that repeat an id are one document for the counts, and each keeps a row of its
    own in the result; rows with a null id are one document that comes after all others. An empty
    table gives no rows; other columns are ignored.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines, keys = repeated_lines(rows, min_docs, min_chars)
    keys = written(keys, "line_keys")
    gone = lines.join(keys, (lines["key1"] == keys["k1"]) & (lines["key2"] == keys["k2"])).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    # a set for each text, combined before the shuffle: repeated rows add nothing, and it is as long as the text at most
    gone = gone.groupBy("doc_id", "row1", "row2").agg(F.collect_set("place").alias("places"))
    gone = written(gone.select(F.col("doc_id").alias("_id"), F.col("row1").alias("_row1"), F.col("row2").alias("_row2"), "places"), "line_places")
    row1, row2 = _two_hashes(F.col("text"))
    rows = rows.withColumns({"row1": row1, "row2": row2})
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["row1"] == gone["_row1"]) & (rows["row2"] == gone["_row2"]), "left")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = joined.withColumn("n_lines", n_lines)
    stay = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("places"))
    # the text is split once, outside the inner lambda
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n"))[0]
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
                         F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept"))
