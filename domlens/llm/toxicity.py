"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the document bears a label. A sentence scores
sigmoid(bias + sum of its features' weights); a document scores the noisy-or of its sentences, i.e.
1 - product(1 - sentence score). The weights are trained through the noisy-or from document labels
alone, so the sentences that make a document toxic can be told afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, release, slices, utf8, written
from .words import LOWER, hash_prefixes, hash_runs

SAMPLE = 20_000    # labelled documents that the classifier is fitted on at most, the first by a hash
FEATURES = 2_048   # words and beginnings of words with weights, the best by chi-square
LEAST, CHI = 5, 30.0  # documents of the sample that a feature must be in, and its least chi-square
PREFIXES = (4, 5, 6, 7, 8)  # bytes
SLICE = 1 << 20    # bytes of text hashed at once
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("'"), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of a batch of texts, each once for a sentence: (hashes, number of the sentence of
    each, first byte and text of each sentence). They are the words, and the first bytes of longer
    words, which inflected forms share. A sentence ends with one of ``. ! ?``, a line or the text;
    ones without words have no number."""
    low = LOWER[data]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    start, end, words = hash_runs(low, _WORD[low], cuts)
    if not len(words):
        none = np.zeros(0, np.int64)
        return words, none, none, none
    new = np.zeros(len(data), bool)
    new[_STOP[low]] = True
    new[cuts] = True
    _, first, sentence = np.unique(np.cumsum(new)[start], return_index=True, return_inverse=True)
    hashes, owner = [words], [sentence]
    for size in PREFIXES:
        long, prefix = hash_prefixes(low, start, end, size)
        hashes.append(prefix)
        owner.append(sentence[long])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    return hashes, owner, start[first], np.searchsorted(offsets, start[first], "right") - 1


def once(number: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Places of the first of each feature in a sentence."""
    if not len(number):
        return np.zeros(0, np.int64)
    return np.unique(sentence.astype(np.int64) * (int(number.max()) + 1) + number, return_index=True)[1]


def held_out(doc_id: Column) -> Column:
    """Whether the id's fold (crc32 of its decimal form) is kept from training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def training_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", limit: int = SAMPLE) -> dict[int, int]:
    """Labels of ``limit`` documents at most that aren't held out, the first by a hash of the id. Of
    several labels the largest counts; null ids and labels are left out."""
    rows = narrow(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()  # ``limit`` small rows
    return {r["doc_id"]: r["label"] for r in picked}


def _noisy_or_fit(y: np.ndarray, doc_of: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, rounds: int = 400, ridge: float = 2e-3) -> np.ndarray:
    """Weights and, last, the bias: maximum likelihood of the noisy-or with a small ridge, by Adam."""
    w = np.zeros(n_features + 1)
    rate = max(y.mean(), 1e-3) if len(y) else 0.5
    w[-1] = np.log(max(rate * len(y) / max(len(doc_of), 1), 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    # the rarer label weighs more, at most fivefold
    weight = np.where(y == 1, min(5.0, max(1.0, (1 - rate) / rate) ** 0.5), 1.0) / max(len(y), 1)
    for step in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, w[feature], len(doc_of))
        miss = np.bincount(doc_of, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        hit = np.maximum(-np.expm1(-miss), 1e-9)
        slope = weight * np.where(y == 1, -np.exp(-miss) / hit, 1.0)
        each = slope[doc_of] / (1 + np.exp(-z))
        g = np.append(np.bincount(feature, each[sentence], n_features), each.sum())
        g[:-1] += ridge * w[:-1] / max(1, n_features) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w


class Model:
    """Feature hashes in ascending order, their weights, and the bias of a sentence."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each feature; -1 if it has no weight."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its score, the first byte of its worst sentence (-1: none), and that one's score."""
        hashes, sentence, first, text = features(data, offsets)
        number = self.look_up(hashes)
        known = np.flatnonzero(number >= 0)
        known = known[once(number[known], sentence[known])]
        z = self.bias + np.bincount(sentence[known], self.weights[number[known]], len(first))
        score = -np.expm1(-np.bincount(text, np.logaddexp(0, z), len(offsets) - 1))
        worst, place = np.full(len(score), -1, np.int64), np.full(len(score), -np.inf)
        np.maximum.at(place, text, z)
        top = np.flatnonzero(z == place[text])[::-1]  # of equals the first stays
        worst[text[top]] = first[top] - offsets[text[top]]
        return np.clip(score, 0, 1), worst, 1 / (1 + np.exp(-place))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of the labelled ids that aren't held out: SAMPLE ids at most, one text each (of several
    the one with the smallest hash), however often an id occurs. Without any label of either kind, or from
    empty tables, the model has no features and scores by its bias alone."""
    spark = docs.sparkSession
    sample = training_sample(labels, label_col, id_col)
    if not sample:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    chosen = spark.createDataFrame(list(sample.items()), "doc_id long, label int")
    texts = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    # one text an id, however often it occurs; found once, and read twice
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = written(texts, "labelled")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in slices(batches, "text", SLICE):
            yield part.column("label").to_pylist(), *features(*utf8(part.column("text")))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, hashes, sentence, _, text in sampled(batches):
            order = np.lexsort((text[sentence], hashes))
            h, t = hashes[order], text[sentence][order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
            h, toxic = h[new], (np.array(label, np.int64) > 0).astype(np.int64)[t[new]]
            each, first = np.unique(h, return_index=True)
            n = np.diff(np.append(first, len(h)))
            ones = np.add.reduceat(toxic, first) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.int64)), pa.array(n), pa.array(ones)], names=["feature", "n", "ones"])

    all_, ones = len(sample), sum(v > 0 for v in sample.values())
    rate = ones / all_
    found = texts.mapInArrow(tally, "feature long, n long, ones long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).filter(F.col("n") >= LEAST)
    expected = F.col("n") * rate
    chi = F.pow(F.col("ones") - expected, 2) / (expected * (1 - rate) * (1 - F.col("n") / (all_ + 1)) + 1e-9)
    best = found.withColumn("chi", chi).filter(F.col("chi") > CHI).orderBy(F.col("chi").desc(), "feature").limit(FEATURES).select("feature").collect()
    hashes = np.sort(np.array([r[0] for r in best], np.int64).astype(np.uint64))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, hashes, sentence, _, text in sampled(batches):
            number = model.look_up(hashes)
            known = np.flatnonzero(number >= 0)
            known = known[once(number[known], sentence[known])]
            at, feature = sentence[known], number[known]
            hit, inside = np.unique(at, return_inverse=True)  # sentences without features are only counted
            count = np.bincount(text, minlength=len(label))
            owner = text[at] if len(at) else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(label) + 1))
            parts = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(v > 0) for v in label], pa.int64()), pa.array(count, pa.int64()),
                pa.array([inside[p].astype(np.int32) for p in parts], pa.list_(pa.int32())), pa.array([feature[p].astype(np.int32) for p in parts], pa.list_(pa.int32()))], names=["y", "sentences", "sentence", "feature"])

    rows = texts.mapInArrow(bags, "y long, sentences long, sentence array<int>, feature array<int>").collect()  # SAMPLE rows at most: numbers of the sentences that have features
    y, doc_of, sentence, feature = [], [], [], []
    for row in rows:
        local = {s: len(doc_of) + k for k, s in enumerate(dict.fromkeys(row["sentence"]))}
        sentence += [local[s] for s in row["sentence"]]
        feature += row["feature"]
        doc_of += [len(y)] * row["sentences"]
        y.append(row["y"])
    w = _noisy_or_fit(np.array(y), np.array(doc_of, np.int64), np.array(sentence, np.int64), np.array(feature, np.int64), len(hashes))
    return Model(hashes, w[:-1], float(w[-1]))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst_start", pa.int64()), ("worst_score", pa.float64())])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, worst_start: byte of the whole
    text at which the first word of its most toxic sentence starts, worst_score).

    Null and empty texts, and texts without words, have no sentence: score 0 and worst_start -1.
    Null ids aren't held out. Repeated rows each have their own row; other columns (label, language,
    source) are never read. Nothing is shuffled; a task holds a few MB of texts, or one longer text.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            score, worst, most = shared.value.score(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(worst), pa.array(np.where(worst < 0, 0, most))], schema=_SCORES)

    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, worst_start long, worst_score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_score")


def clean_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``threshold``. A row is
    judged by its own text, whatever its id; null texts are empty and stay. Only texts go to Python
    and only scores come back; nothing is shuffled. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            found = [shared.value.score(*utf8(part.column("text")))[0] for part in slices(iter([batch]), "text", SLICE)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]))
        release()

    return docs.filter(score(F.col(f"`{text_col}`")) < threshold)
