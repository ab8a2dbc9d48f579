"""Tree ensembles as plain arrays: read from fitted Spark models or grown by ``boosting``, scored over
Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root


@dataclass
class Tree:
    """Node 0 is the root. A row goes left where its feature is at most the threshold; a missing value
    (NaN) goes right. ``feature`` is -1 at leaves; ``value`` has a row for each node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            goes_left = x[open_, self.feature[node]] <= self.threshold[node]
            at[open_] = np.where(goes_left, self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at


@dataclass
class Ensemble:
    """The margin of a row is ``base`` and the weighted sum of its leaves' values, one for each output."""

    features: list[str]
    trees: list[Tree]
    weights: list[float]
    base: np.ndarray
    classes: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1)).astype(float)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out += weight * tree.value[tree.leaves_of(x)]
        return out


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """Rows x features as float64; null is NaN."""
    return np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]) if features else np.zeros((batch.num_rows, 0))


def from_spark(model, features: list[str]) -> Ensemble:
    """A fitted decision tree, random forest or boosted-trees model of Spark ML over the assembled ``features``.

    The model is saved to the shared folder and its node table read back: the public form of a
    tree. A classification tree's value is the class shares of a node (forests: their mean over the
    trees); a boosted model's margin is the weighted sum of its regression trees, Spark's raw prediction.
    Splits on categories are refused.
    """
    spark = _session()
    path = f"{checkpoint_root(spark)}/trees-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in nodes.columns
    nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData")) if single else nodes
    rows: dict[int, list] = {}
    for r in nodes.select("treeID", "nodeData.*").collect():  # a row for each node of the model
        rows.setdefault(r["treeID"], []).append(r)
    regression = not hasattr(model, "numClasses") or "GBT" in type(model).__name__
    given = [1.0] if single else list(model.treeWeights)
    total = 1.0 if regression else sum(given)
    trees = [_tree(sorted(rows[t], key=lambda r: r["id"]), regression) for t in sorted(rows)]
    k = trees[0].value.shape[1]
    return Ensemble(list(features), trees, [w / total for w in given], np.zeros(k))


def _tree(rows: list, regression: bool) -> Tree:
    def threshold(r):
        if r["split"]["numCategories"] > 0:
            raise ValueError("splits on categories are not supported")
        return r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else np.nan

    stats = np.array([r["impurityStats"] for r in rows], float)
    value = np.array([[r["prediction"]] for r in rows], float) if regression else stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)
    inner = np.array([r["leftChild"] >= 0 for r in rows])
    return Tree(np.where(inner, [r["split"]["featureIndex"] for r in rows], -1), np.array([threshold(r) for r in rows], float),
                np.array([r["leftChild"] for r in rows]), np.array([r["rightChild"] for r in rows]), np.array([r["rawCount"] for r in rows], float), value)


def _session():
    from pyspark.sql import SparkSession
    return SparkSession.active()


def fixed_trees(df: DataFrame, splits: list[tuple[tuple[str, float], tuple[str, float]]], label: str) -> Ensemble:
    """Trees of given splits: each asks for one feature, then for a second one in both branches. Covers
    and mean labels of the leaves come from one aggregate (four rows a tree); the ensemble is the mean of the trees.
    Empty leaves take the mean of all rows."""
    def side(f: str, at: float):
        return F.when(F.col(f"`{f}`") <= at, 0).otherwise(1)

    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), (side(*a) * 2 + side(*b)).alias("leaf")) for t, (a, b) in enumerate(splits)]))
    found = df.select(cells.alias("c"), F.col(label).cast("double").alias("y")).groupBy("c.tree", "c.leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    n, y = np.zeros((len(splits), 4)), np.zeros((len(splits), 4))
    for r in found:
        n[r["tree"], r["leaf"]], y[r["tree"], r["leaf"]] = r["n"], r["y"]
    names = list(dict.fromkeys(f for pair in splits for f, _ in pair))
    trees = []
    for t, ((fa, ta), (fb, tb)) in enumerate(splits):
        mean = y[t].sum() / max(n[t].sum(), 1)
        leaf = np.where(n[t] > 0, y[t] / np.maximum(n[t], 1), mean)
        a, b = names.index(fa), names.index(fb)
        cover = np.array([n[t].sum(), n[t][:2].sum(), n[t][2:].sum(), *n[t]])
        trees.append(Tree(np.array([a, b, b, -1, -1, -1, -1]), np.array([ta, tb, tb, np.nan, np.nan, np.nan, np.nan]),
                          np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), cover, np.array([[mean], [mean], [mean], *leaf[:, None]])))
    return Ensemble(names, trees, [1.0 / len(splits)] * len(splits), np.zeros(1))


def margins(df: DataFrame, ensemble: Ensemble, keep: list[str]) -> DataFrame:
    """(keep..., margin array<double>) of every row; the model is broadcast, rows go in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)
    names = ensemble.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.margin(matrix(batch, names))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(list(found), pa.list_(pa.float64()))], names=[*keep, "margin"])

    rows = df.select(*dict.fromkeys([*keep, *names]))
    shape = rows.select(*keep).withColumn("margin", F.array().cast("array<double>")).schema
    return rows.mapInArrow(run, shape)
