"""Exact Shapley values of tree ensembles, row by row (M17), for the reports of ``explain``.

The game of a row: a coalition of features is worth what the tree returns if splits on its features
follow the row and splits on other features take both branches in the shares of their covers. For
a leaf and the features on its path, the worth is a product over features: 1 or 0 for one that is
in the coalition (does the row reach the leaf as far as that feature goes?), the share of covers
for one that isn't. The path's weights are the coefficients of the polynomial of these factors,
extended feature by feature; a feature's own value comes from the polynomial with its factor unwound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Ensemble, Tree, matrix


@dataclass
class Path:
    """A leaf and what each feature on its path must satisfy: at most ``most``, not at most ``least``."""

    feature: np.ndarray
    most: np.ndarray     # inf: no left branch asks for it
    least: np.ndarray    # -inf: no right branch does
    share: np.ndarray
    value: np.ndarray


def paths(tree: Tree) -> list[Path]:
    out: list[Path] = []
    open_: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while open_:
        node, held = open_.pop()
        f = int(tree.feature[node])
        if f < 0:
            seen = sorted(held)
            out.append(Path(np.array(seen, np.int64), *(np.array([held[g][k] for g in seen], float) for k in range(3)), tree.value[node]))
            continue
        most, least, share = held.get(f, (np.inf, -np.inf, 1.0))
        at, cover = tree.threshold[node], max(tree.cover[node], 1e-300)
        open_.append((int(tree.left[node]), held | {f: (min(most, at), least, share * tree.cover[tree.left[node]] / cover)}))
        open_.append((int(tree.right[node]), held | {f: (most, max(least, at), share * tree.cover[tree.right[node]] / cover)}))
    return out


def _weights(hold: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley sums of each feature, (rows, features), for a leaf worth 1. ``hold``: whether the row
    satisfies the feature on this path; ``share``: what the feature counts when it is left out."""
    rows, k = hold.shape
    whole = np.zeros((rows, k + 1))
    whole[:, 0] = 1.0
    for j in range(k):  # extend by (share + hold * t)
        one = hold[:, j:j + 1]
        whole[:, 1:j + 2] = whole[:, 1:j + 2] * share[j] + whole[:, :j + 1] * one
        whole[:, 0] *= share[j]
    by_size = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
    out = np.zeros((rows, k))
    for j in range(k):  # unwind the feature's own factor
        z, one = share[j], hold[:, j]
        rest = np.zeros((rows, k))
        top = np.zeros(rows)
        for s in range(k - 1, -1, -1):
            top = whole[:, s + 1] - z * top
            rest[:, s] = top
        if z > 0:
            rest = np.where(one[:, None] > 0, rest, whole[:, :k] / z)
        else:  # no row of the training part went this way, and the row doesn't either: nothing is left of the product
            rest = np.where(one[:, None] > 0, rest, _without(hold, share, j))
        out[:, j] = (one - z) * (rest @ by_size)
    return out


def _without(hold: np.ndarray, share: np.ndarray, j: int) -> np.ndarray:
    rows, k = hold.shape
    out = np.zeros((rows, k))
    out[:, 0] = 1.0
    for n, i in enumerate(i for i in range(k) if i != j):
        out[:, 1:n + 2] = out[:, 1:n + 2] * share[i] + out[:, :n + 1] * hold[:, i:i + 1]
        out[:, 0] *= share[i]
    return out


def expectation(ensemble: Ensemble) -> np.ndarray:
    """What the empty coalition is worth, for each output."""
    out = ensemble.base.astype(float).copy()
    for tree, weight in zip(ensemble.trees, ensemble.weights, strict=True):
        for p in paths(tree):
            out += weight * p.share.prod() * p.value
    return out


def shapley(ensemble: Ensemble, x: np.ndarray, output: int = 0, known: list[list[Path]] | None = None) -> np.ndarray:
    """(rows, features) Shapley values of one output. Rows that agree in what they satisfy along a path
    share one computation."""
    out = np.zeros(x.shape)
    for tree, weight, found in zip(ensemble.trees, ensemble.weights, known or [paths(t) for t in ensemble.trees], strict=True):
        for p in found:
            worth = weight * p.value[output]
            if not len(p.feature) or worth == 0.0:
                continue
            part = x[:, p.feature]
            hold = ((part <= p.most) | (p.most == np.inf)) & ~((part <= p.least) & (p.least > -np.inf))
            code = hold @ (1 << np.arange(hold.shape[1], dtype=np.int64))
            _, first, same = np.unique(code, return_index=True, return_inverse=True)
            out[:, p.feature] += worth * _weights(hold[first].astype(float), p.share)[same]
    return out


def attributions(df: DataFrame, ensemble: Ensemble, key: str, output: int = 0) -> DataFrame:
    """(sample_id, expected, margin, values array<double>), one row a row of ``df``: the values follow
    ``ensemble.features`` and sum to margin - expected. The model is broadcast; nothing is shuffled.

    Null features are missing values (they go right, as in scoring). Null and repeated keys keep a
    row each; other columns are ignored; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast((ensemble, [paths(t) for t in ensemble.trees], float(expectation(ensemble)[output])))
    rows = df.select(F.col(f"`{key}`").alias("sample_id"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(ensemble.features)])
    names = [f"f{i}" for i in range(len(ensemble.features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, expected = shared.value
        for batch in batches:
            x = matrix(batch, names)
            values = shapley(model, x, output, known)
            yield pa.RecordBatch.from_arrays([
                batch.column("sample_id"), pa.array(np.full(len(x), expected)), pa.array(model.margin(x)[:, output]),
                pa.array(list(values), pa.list_(pa.float64()))], names=["sample_id", "expected", "margin", "values"])

    shape = rows.select("sample_id", F.lit(0.0).alias("expected"), F.lit(0.0).alias("margin"), F.array().cast("array<double>").alias("values")).schema
    return rows.mapInArrow(run, shape)


def long_form(attributed: DataFrame, features: list[str]) -> DataFrame:
    """(sample_id, feature, value), the input of the reports: made row by row, so that what is summed by
    feature is combined in the same task."""
    names = F.array(*[F.lit(f) for f in features])
    return attributed.select("sample_id", F.posexplode("values").alias("_at", "value")).select("sample_id", F.get(names, F.col("_at")).alias("feature"), "value")
