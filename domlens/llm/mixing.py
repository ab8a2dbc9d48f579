"""Mixing sources to target weights by Pareto order sampling with inclusion by size.

A document's inclusion is ``min(1, c * size)``, with c of its source such that the expected words make
up what the source's target leaves beyond whole copies. Documents rank by the odds of a random
number divided by the odds of their inclusion, and the first ones up to the fixed size, counted in words, are taken."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import narrow, running_totals, written

WEIGHTS = (1, 2, 3)  # of the sources by code point, repeating
CAP = 3              # copies of a source, and so of a document, at most
LARGE = 256          # a document over 1/LARGE of its source is placed before the others
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares of all sizes by weight, none
    above ``cap`` times its source, the excess reshared by weight (one row per source throughout).

    In ascending order of cap * size / weight the capped sources come first; the level of the
    others is what the capped ones leave, shared by the remaining weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    names = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = totals.withColumn("weight", weight).withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("weight"))
    all_ = W.partitionBy()
    before = W.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("top").over(before), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")))
    level = F.min("open").over(all_)["level"]  # of the first source that isn't capped
    return s.select("source", "source_size", "largest", F.least(F.col("top").cast("double"), F.coalesce(F.col("weight") * level, F.col("top").cast("double"))).alias("target"))


def _uniform(seed: int) -> Column:
    """In (0, 1), from the document's id alone."""
    return ((F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11)).cast("double") + 0.5) / float(1 << 53)


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _settle(size: np.ndarray, want: float, least: float, most: float) -> np.ndarray:
    """Which of a source's large documents (in Pareto order) to take: those up to the fixed size
    ``want``; if their words then lie outside [least, most], which is what the small documents can
    make up for, documents are exchanged, in Pareto order, as long as that brings them closer."""

    def miss(words):
        return np.maximum(np.maximum(least - words, words - most), 0)

    fits, words = np.zeros(len(size), bool), 0
    for k, n in enumerate(size):  # in order, passing over what is too much
        if words + n <= want:
            fits[k], words = True, words + n
    starts = [np.cumsum(size) - size / 2 <= want, fits]
    settled = [_exchange(size, take.copy(), miss) for take in starts]
    return min(settled, key=lambda take: float(miss(size[take].sum())))  # of equals the first


def _exchange(size: np.ndarray, take: np.ndarray, miss) -> np.ndarray:
    for _ in range(4 * len(size)):
        have = size[take].sum()
        if miss(have) <= 0:
            break
        inside, outside = np.append(0, size[take]), np.append(0, size[~take])
        after = miss(have - inside[:, None] + outside[None, :])
        at = np.unravel_index(np.argmin(after), after.shape)
        if after[at] >= miss(have):
            break
        gone, new = np.flatnonzero(take), np.flatnonzero(~take)
        if at[0]:
            take[gone[at[0] - 1]] = False
        if at[1]:
            take[new[at[1] - 1]] = True
    return take


def _inclusion(size: np.ndarray, want: float) -> np.ndarray:
    """min(1, c * size) with c such that the expected words are ``want``: the largest documents are certain
    as long as their share of what is left is one or more."""
    order = np.argsort(-size, kind="stable")
    s = size[order].astype(float)
    before = np.cumsum(s) - s
    squares = (s * s).sum() - (np.cumsum(s * s) - s * s)
    c = (want - before) / np.maximum(squares, 1e-300)
    open_ = np.flatnonzero(c * s < 1)
    out = np.ones(len(s)) if not len(open_) else np.minimum(1.0, np.maximum(c[open_[0]], 0.0) * s)
    back = np.empty(len(s))
    back[order] = out
    return back


def _place_large(group: pd.DataFrame) -> pd.DataFrame:
    """Large documents of one source, fewer than LARGE."""
    first = group.iloc[0]
    size, u = group["size"].to_numpy(np.int64), group["u"].to_numpy()
    part = np.clip(_inclusion(size, first["part"] * size.sum()), 1e-12, 1.0)
    with np.errstate(divide="ignore"):
        group["q"] = np.where(part >= 1, 0.0, u / (1 - u) * (1 - part) / part)
    group = group.sort_values(["q", "doc_id", "size"], kind="stable")
    size = group["size"].to_numpy(np.int64)
    small = first["source_size"] - size.sum()
    group["taken_more"] = _settle(size, first["part"] * size.sum(), first["rest"] - small, first["rest"])
    return group[["doc_id", "source", "size", "source_size", "target", "whole", "rest", "part", "taken_more"]]


def _scales(small: DataFrame) -> DataFrame:
    """(_source, scale): c of each source, from rows (source, size, need) of its small documents. A row for each
    (source, size) is placed from the largest size down; c follows from the first size whose share is below one."""
    sizes = small.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    sizes = sizes.select("source", "size", "need", (F.col("n") * F.col("size")).alias("words"), (F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"))
    placed = written(running_totals(sizes, [F.col("size").desc()], ["words", "squares"], group="source"), "sizes_placed")
    all_ = placed.groupBy(F.col("source").alias("_s")).agg(F.sum("squares").alias("all_squares"))
    placed = placed.join(all_, F.col("source").eqNullSafe(F.col("_s")))
    c = (F.col("need") - F.col("before_words")) / F.greatest(F.col("all_squares") - F.col("before_squares"), F.col("squares"))
    placed = placed.withColumn("c", c)
    return placed.groupBy(F.col("source").alias("_source")).agg(F.coalesce(F.max_by("c", F.when(F.col("c") * F.col("size") < 1, F.col("size"))), F.lit(1.0)).alias("scale"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, whole, large, scale) of every document.

    A document's expected copies are target / source_size. Their whole part is certain for every
    document; the words that are left are drawn by Pareto order sampling with inclusion by size:
    min(1, c * size), where c makes the expected words the source's fixed size; documents of
    inclusion 1 come first, the others by the odds of a random number divided by the odds of their
    inclusion, and the first ones up to the fixed size, counted in words, get one copy more.
    Documents over 1/LARGE of their source (fewer than LARGE) are settled first, the others fill what
    these leave; the words taken miss the target by half a small document at most.

    Random numbers come from the id and the seed: reruns agree whatever the partitioning. Null
    texts and texts without words have size 0 and take nothing; a null source is a source and
    comes last; rows that repeat an id have the same random number and are ranked by size. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(narrow(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = written(source_targets(rows, weights, cap), "targets").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["_source"])).drop("_source", "largest")
    rows = rows.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = rows.withColumn("part", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    large = F.col("size") * LARGE > F.col("source_size")
    ranked = (rows.filter(large).withColumn("u", _uniform(seed))
              .groupBy("source").applyInPandas(_place_large, "doc_id long, source string, size long, source_size long, target double, whole long, rest double, part double, taken_more boolean"))
    ranked = written(ranked, "large")
    left = ranked.groupBy("source").agg(F.sum(F.when(F.col("taken_more"), F.col("size")).otherwise(0)).alias("_taken"), F.sum("size").alias("_large"))
    left = written(left.withColumnRenamed("source", "_source"), "left")
    small = rows.filter(~large).join(left, rows["source"].eqNullSafe(left["_source"]), "left").withColumn("need", F.col("rest") - F.coalesce(F.col("_taken"), F.lit(0)))
    scales = written(_scales(small), "scales").withColumnRenamed("_source", "_of")  # a row for each source
    small = small.drop("_source", "_taken", "_large").join(scales, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    small = small.withColumn("q", F.when(F.col("size") > 0, pareto(seed)).otherwise(F.lit(float("inf"))))
    placed = running_totals(small, [F.col("q"), F.col("doc_id"), F.col("size")], ["size"], group="source")
    placed = placed.withColumn("taken_more", F.col("before_size") + F.col("size") / 2 <= F.col("need"))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "taken_more", "large", "scale"]
    out = placed.withColumn("large", F.lit(False)).select(*columns).unionByName(ranked.withColumn("large", F.lit(True)).withColumn("scale", F.lit(None).cast("double")).select(*columns))
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("taken_more").cast("long"), F.lit(cap).cast("long"))).otherwise(F.lit(0).cast("long"))
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "whole", "large", "scale")


def pareto(seed: int = SEED) -> Column:
    """Odds of the random number over odds of the inclusion, of (doc_id, size, scale): 0 where it is certain."""
    part = F.greatest(F.col("scale") * F.col("size"), F.lit(1e-12))
    return F.when(part >= 1, F.lit(0.0)).otherwise(_odds(_uniform(seed)) / _odds(part))


def rank(seed: int = SEED) -> Column:
    """The order of a source's documents (doc_id, size, scale) that aren't large."""
    return F.struct(pareto(seed).alias("q"), "doc_id", "size")


def cuts(mix: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What tells the copies of any document without a row for each: (source, whole, scale, cut), where
    documents up to ``cut`` in ``rank`` have one copy more than ``whole``; and the large documents
    (doc_id, source, size, copies), fewer than LARGE for a source."""
    rows = mix.filter("size > 0")
    small = rows.filter("not large").groupBy("source").agg(F.max("whole").alias("whole"), F.max("scale").alias("scale"), F.max(F.when(F.col("copies") > F.col("whole"), rank(seed))).alias("cut"))
    return small, rows.filter("large").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
