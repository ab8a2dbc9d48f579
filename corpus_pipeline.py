"""Corpus pipeline: toxicity, exact duplicates, near duplicates, source mix, piece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
the columns of ``documents`` (the last one: pieces). Near duplicates are documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more; the smallest id of a class stays. The
mix repeats a row for each copy it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlens.llm import cuckoo_dedup, mixing, ngram_join, pieces, toxicity
from domlens.llm.common import small_batches, table, written
from domlens.llm.queries import tokenizer

#: SQL can't express the trained classifier, the random order and the piece model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores less than 0.7, whatever their ids, as do texts without words: scored
    and filtered where they are read, so that no text is shuffled."""
    with small_batches(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.clean_rows(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest id stays. Rows that repeat
    an id with the same text stay once; of rows with null ids and a text that no id has, one stays."""
    with small_batches(spark):
        verdict = written(cuckoo_dedup.exact_duplicates(docs), "verdict")
    if not verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").head(1):
        gone = written(verdict.filter("not kept").select("doc_id"), "gone")  # ids tell the rows apart
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    gone = written(verdict.filter("not kept").select("doc_id", "text_sha256"), "gone")
    again = written(verdict.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    rows = docs.withColumn("_sha", sha)
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_sha"] == gone["text_sha256"]), "left_anti")
    if again.head(1):  # nothing tells such rows apart: any one of them stays
        same = kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept["_sha"] == again["text_sha256"])
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_sha"]))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the text with the smallest id stays, null ids last; texts without a class stay. A
    verdict reaches the rows of its id and text: a text that only shares its id with a near copy stays."""
    with small_batches(spark):
        gone = written(ngram_join.near_copies(docs, n=5, threshold="0.8"), "gone")
    t1, t2 = ngram_join.text_hashes(F.col("text"))
    rows = docs.withColumns({"_t1": t1, "_t2": t2})
    on = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_t1"] == gone["t1"]) & (rows["_t2"] == gone["t2"])
    return rows.join(gone, on, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes. The copies follow from a row's source, id and size and
    small tables (a row for each source, and the large documents), so the texts aren't shuffled;
    rows that agree in these are taken alike."""
    small, large = mixing.cuts(written(mixing.mix_sources(docs), "mix"))
    small = written(small.select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), "scale", F.col("cut").alias("_cut")), "cuts")
    large = written(large.select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_size"), F.col("copies").alias("_copies")), "large")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.join(small, rows["source"].eqNullSafe(small["_source"]), "left")
    rows = rows.join(large, rows["doc_id"].eqNullSafe(large["_id"]) & rows["source"].eqNullSafe(large["_from"]) & (rows["size"] == large["_size"]), "left")
    more = F.coalesce((mixing.rank() <= F.col("_cut")).cast("long"), F.lit(0).cast("long"))
    copies = F.when(F.col("size") > 0, F.coalesce("_copies", F.col("_whole") + more, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_n", copies).filter("_n > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("d.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, also of rows that repeat an id or have none; null and empty
    texts have no ids. The stage's table in the shared folder has the whole of each row: its ids, the
    spans that they stand for and the decoded text."""
    with small_batches(spark):
        whole = written(pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"), output="compact", slice_bytes=1 << 20), "pieces")
    return whole.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
