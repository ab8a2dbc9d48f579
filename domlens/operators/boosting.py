"""Boosted trees on shared histograms: AdaBoost by reweighted rows, and gradient boosting with a logistic or
softmax objective, one tree a class and round (M7, M8).

Features are binned once, by approximate quantiles, and kept as bytes in row blocks. A level of all trees
of a round is one pass: every block brings its rows' state (margins, or the logarithms of AdaBoost's row
weights) up to date with the trees grown since the state was last written, routes its rows through
the trees being grown and adds up histograms (tree, node, feature, bin, statistic). The driver sees
histograms, whose size follows the model, and picks the splits; the state is written anew to the
shared folder every CUT rounds, which also ends the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import DDL, Block, row_blocks, saved, total
from .trees import Ensemble, Tree

BINS = 32  # 256 at most: a bin is a byte
CUT = 10   # rounds


# ---------------------------------------------------------------- objectives
class Logistic:
    """One margin a row; gradient and curvature of the log loss."""

    outputs, trees, stats = 1, 1, 2

    def __init__(self, shrink: float = 0.1, ridge: float = 1.0):
        self.shrink, self.ridge = shrink, ridge

    def statistics(self, y: np.ndarray, w: np.ndarray, state: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-state[:, 0]))
        return np.stack([w * (p - y), w * p * (1 - p)])[None]

    def loss(self, y: np.ndarray, w: np.ndarray, state: np.ndarray) -> float:
        return float((w * (np.logaddexp(0, state[:, 0]) - y * state[:, 0])).sum())

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def score(s):
            return s[..., 0] ** 2 / (s[..., 1] + self.ridge)
        return score(left) + score(right) - score(left + right)

    def leaf(self, s: np.ndarray) -> np.ndarray:
        return -self.shrink * s[..., :1] / (s[..., 1:2] + self.ridge)

    def moved(self, y: np.ndarray, state: np.ndarray, found: list[np.ndarray], stage: float) -> np.ndarray:
        return state + np.concatenate(found, 1)


class Softmax(Logistic):
    """A margin and a tree a class."""

    def __init__(self, classes: int, shrink: float = 0.1, ridge: float = 1.0):
        super().__init__(shrink, ridge)
        self.outputs = self.trees = classes

    def _shares(self, state: np.ndarray) -> np.ndarray:
        e = np.exp(state - state.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def statistics(self, y, w, state):
        p = self._shares(state)
        g = p - (y[:, None] == np.arange(self.outputs))
        return np.stack([np.stack([w * g[:, k], w * p[:, k] * (1 - p[:, k])]) for k in range(self.outputs)])

    def loss(self, y, w, state):
        own = self._shares(state)[np.arange(len(y)), y.astype(int)] if len(y) else np.zeros(0)
        return float(-(w * np.log(np.maximum(own, 1e-300))).sum())


class AdaBoost:
    """Discrete multi-class boosting: the state is the logarithm of what rounds have multiplied a row's
    weight by; trees split by the weighted Gini impurity, and a round's stage weight comes from its weighted error."""

    outputs, trees = 1, 1

    def __init__(self, classes: int = 2, rate: float = 1.0):
        self.classes = self.stats = classes
        self.rate = rate

    def statistics(self, y, w, state):
        weight = w * np.exp(state[:, 0])
        return np.stack([np.where(y == c, weight, 0.0) for c in range(self.classes)])[None]

    def loss(self, y, w, state):
        return float((w * np.exp(state[:, 0])).sum())

    def gain(self, left, right):
        def impurity(s):
            all_ = s.sum(-1)
            return all_ - (s ** 2).sum(-1) / np.maximum(all_, 1e-300)
        return impurity(left + right) - impurity(left) - impurity(right)

    def leaf(self, s):
        return s.argmax(-1)[..., None].astype(float)

    def stage(self, leaves: np.ndarray) -> tuple[float, float]:
        """(weighted error, stage weight) from the leaves' class weights."""
        error = 1 - leaves.max(1).sum() / max(leaves.sum(), 1e-300)
        if error <= 1e-12:
            return 0.0, 1.0
        return float(error), float(self.rate * (np.log((1 - error) / error) + np.log(self.classes - 1)))

    def moved(self, y, state, found, stage):
        return state + stage * (found[0] != y[:, None])


# ---------------------------------------------------------------- growing
@dataclass
class _Growing:
    """A tree over bins: rows of bin <= ``cut`` go left. Open nodes are those of the present level."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    stats: list = field(default_factory=lambda: [None])  # statistics and, last, rows
    open_: list[int] = field(default_factory=lambda: [0])

    def route(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        rows = np.flatnonzero(feature[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
            rows = rows[feature[at[rows]] >= 0]
        return at

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray) -> list[int]:
        new = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *new
        for stats in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.stats.append(stats)
        return new


def _unpack(block: Block, n_features: int, outputs: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    _, n, x, y, w, state = block
    bins = np.frombuffer(x, np.uint8).reshape(n, n_features)
    start = np.frombuffer(state).reshape(n, outputs) if state else np.tile(base, (n, 1))
    return bins, np.frombuffer(y), np.frombuffer(w), start


def _advance(bins, y, state, rounds, objective) -> np.ndarray:
    for trees, values, stage in rounds:
        state = objective.moved(y, state, [v[t.route(bins)] for t, v in zip(trees, values, strict=True)], stage)
    return state


def _histograms(rdd, growing: list[_Growing], done: list, objective, n_features: int, bins: int, base: np.ndarray):
    """([trees x open nodes, feature, bin, statistics and rows], [loss, weight]) of the present level."""
    places = []
    for tree in growing:
        place = np.full(len(tree.feature), -1)
        place[tree.open_] = np.arange(len(tree.open_))
        places.append(place)
    sizes = [len(t.open_) for t in growing]

    def each(block: Block) -> list[np.ndarray]:
        x, y, w, state = _unpack(block, n_features, objective.outputs, base)
        state = _advance(x, y, state, done, objective)
        stats = objective.statistics(y, w, state)
        columns = np.arange(n_features) * bins
        out = []
        for tree, place, size, own in zip(growing, places, sizes, stats, strict=True):
            node = place[tree.route(x)]
            rows = np.flatnonzero(node >= 0)
            cell = (node[rows, None] * (n_features * bins) + columns + x[rows]).ravel()
            all_ = [np.bincount(cell, np.repeat(s[rows], n_features), size * n_features * bins) for s in own]
            all_.append(np.bincount(cell, minlength=size * n_features * bins).astype(float))
            out.append(np.stack(all_, -1).reshape(size, n_features, bins, len(own) + 1))
        return [np.concatenate(out), np.array([objective.loss(y, w, state), w.sum()])]

    return total(rdd, each)


def _grow_level(growing: list[_Growing], found: np.ndarray, objective, least_rows: int, split_rows: int, max_leaves: int | None) -> None:
    """Split the open nodes where that gains most; of equal gains the first feature and bin."""
    at = 0
    for tree in growing:
        own = found[at:at + len(tree.open_)]
        at += len(tree.open_)
        if not len(own):
            continue
        left = np.cumsum(own, axis=2)[:, :, :-1]
        all_ = own[:, :1].sum(2, keepdims=True)
        right = all_ - left
        gain = objective.gain(left[..., :-1], right[..., :-1])
        able = (left[..., -1] >= least_rows) & (right[..., -1] >= least_rows) & (all_[..., -1] >= split_rows)
        gain = np.round(np.where(able, gain, -np.inf), 12).reshape(len(own), -1)
        best = gain.argmax(1) if gain.shape[1] else np.zeros(len(own), int)
        order = sorted(range(len(own)), key=lambda k: -gain[k, best[k]] if gain.shape[1] else 0.0)
        leaves, new = sum(f < 0 for f in tree.feature), []
        for k, node in enumerate(tree.open_):
            tree.stats[node] = all_[k, 0, 0]
        for k in order:
            if not gain.shape[1] or gain[k, best[k]] <= 1e-12 or (max_leaves and leaves >= max_leaves):
                continue
            f, b = divmod(int(best[k]), left.shape[2])
            new += tree.split(tree.open_[k], f, b, left[k, f, b], right[k, f, b])
            leaves += 1
        tree.open_ = new


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS, error: float = 0.001) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges a feature, at its quantiles: one aggregate over all features."""
    asked = [k / bins for k in range(1, bins)]
    return [np.unique(np.array([v for v in q if v == v], float)) for q in df.approxQuantile(features, asked, error)]


@dataclass
class Boosted:
    ensemble: Ensemble
    losses: list[float]               # a row, before each round
    errors: list[float]               # AdaBoost: weighted error of each round
    stages: list[float]               # and its stage weight


def fit(df: DataFrame, features: list[str], label: str, objective, rounds: int, depth: int, weight: str | None = None,
        edges: list[np.ndarray] | None = None, least_rows: int = 1, split_rows: int = 2, max_leaves: int | None = None, bins: int = BINS) -> Boosted:
    """Fit ``rounds`` rounds of trees of ``depth`` levels. Labels are class numbers from 0.

    Null features are missing values and go right; rows with a null label take no part; without any
    row the model is its base alone. AdaBoost ends early when a tree makes no error, or is no better than chance.
    """
    edges = edges if edges is not None else bin_edges(df, features, bins)
    base = np.zeros(objective.outputs)

    def pack(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]).astype(np.uint8) if len(edges) else x

    blocks = row_blocks(df, features, label, weight, pack)
    rdd = blocks.rdd.map(tuple)
    adaboost = isinstance(objective, AdaBoost)
    grown: list = []
    done: list = []
    losses, errors, stages = [], [], []
    for r in range(rounds):
        growing = [_Growing() for _ in range(objective.trees)]
        for level in range(depth):
            if not any(t.open_ for t in growing):
                break
            found = _histograms(rdd, growing, done, objective, len(features), bins, base)
            if found is None:
                return Boosted(Ensemble(features, [], [], base), [], [], [])
            if level == 0:
                losses.append(float(found[1][0] / max(found[1][1], 1e-300)))
            _grow_level(growing, found[0], objective, least_rows, split_rows, max_leaves)
        leaf = [np.array([objective.leaf(s[:-1]) for s in t.stats]) for t in growing]
        stage = 1.0
        if adaboost:
            ends = np.array([s[:-1] for s, f in zip(growing[0].stats, growing[0].feature, strict=True) if f < 0])
            error, stage = objective.stage(ends)
            if error >= 1 - 1 / objective.classes:
                break
            errors.append(error)
            stages.append(stage)
        grown.append((growing, leaf, stage))
        done.append(grown[-1])
        if adaboost and error == 0.0:
            break
        if len(done) == CUT and r + 1 < rounds:
            blocks = saved(blocks.mapInArrow(_state_writer(done, objective, len(features), base), DDL), "boosted")
            rdd, done = blocks.rdd.map(tuple), []
    return Boosted(_ensemble(grown, features, edges, objective, adaboost), losses, errors, stages)


def _state_writer(done, objective, n_features: int, base: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("number", "n", "x", "y", "w", "state")), strict=True))
            new = []
            for block in rows:
                x, y, _, state = _unpack(block, n_features, objective.outputs, base)
                new.append(np.ascontiguousarray(_advance(x, y, state, done, objective)).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("number", "n", "x", "y", "w")], pa.array(new, pa.binary())], names=["number", "n", "x", "y", "w", "state"])
    return run


def _ensemble(grown: list, features: list[str], edges: list[np.ndarray], objective, adaboost: bool) -> Ensemble:
    """Grown trees as an ensemble over the features' own values: AdaBoost's outputs are its classes' votes."""
    trees, weights = [], []
    outputs = objective.classes if adaboost else objective.outputs
    for growing, leaf, stage in grown:
        for k, (tree, values) in enumerate(zip(growing, leaf, strict=True)):
            at = np.array([edges[f][c] if f >= 0 and c < len(edges[f]) else np.inf for f, c in zip(tree.feature, tree.cut, strict=True)])
            out = np.zeros((len(tree.feature), outputs))
            if adaboost:
                out[np.arange(len(out)), values[:, 0].astype(int)] = 1.0
            else:
                out[:, k] = values[:, 0]
            trees.append(Tree(np.array(tree.feature), at, np.array(tree.left), np.array(tree.right), np.array([s[-1] for s in tree.stats]), out))
            weights.append(stage)
    return Ensemble(list(features), trees, weights, np.zeros(outputs))
