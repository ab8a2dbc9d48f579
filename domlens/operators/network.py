"""Feed-forward network with ReLU layers and one sigmoid output (M10), trained by gradient sums of row blocks.

The weights are broadcast each step; blocks compute the gradient of their rows, and ``treeAggregate`` adds them
on the executors, so the driver sees one array of the model's size a step. A step takes the blocks of one
of ``batches`` turns; Adam moves the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, row_blocks, total
from .trees import matrix

LAYERS = (2500, 600, 200)  # hidden layers of the original
BLOCK = 512


@dataclass
class Net:
    """Weights (inputs + 1, outputs) of each layer, the bias last; features are standardised by mean and spread."""

    layers: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of all layers, the last one before the sigmoid."""
        out = [x]
        for k, w in enumerate(self.layers):
            z = out[-1] @ w[:-1] + w[-1]
            out.append(np.maximum(z, 0) if k + 1 < len(self.layers) else z)
        return out

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - self.mean) / self.spread)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(self.standard(x))[-1][:, 0]))


def loss_and_gradient(net: Net, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted sum of the log losses of standardised rows, and its gradient by layer."""
    a = net.forward(x)
    z = a[-1][:, 0]
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    slope = (w * (1 / (1 + np.exp(-z)) - y))[:, None]
    out: list[np.ndarray] = []
    for k in range(len(net.layers) - 1, -1, -1):
        out.append(np.vstack([a[k].T @ slope, slope.sum(0)]))
        if k:
            slope = (slope @ net.layers[k][:-1].T) * (a[k] > 0)
    return loss, out[::-1]


def start(sizes: list[int], mean: np.ndarray, spread: np.ndarray, seed: int = 0) -> Net:
    rng = np.random.default_rng(seed)
    return Net([np.vstack([rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], mean, spread)


def fit(df: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = LAYERS, steps: int = 30, batches: int = 4, rate: float = 1e-3,
        weight: str | None = None, seed: int = 0) -> tuple[Net, list[float]]:
    """(net, mean loss of each step's rows). Null features count as the mean; rows with a null label take no part;
    without any row the net is as it started."""
    agg = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([agg[f"m{i}"] or 0.0 for i in range(len(features))])
    spread = np.array([agg[f"s{i}"] or 1.0 for i in range(len(features))])
    net = start([len(features), *hidden, 1], mean, spread, seed)
    blocks = row_blocks(df, features, label, weight, lambda x: net_input(x, mean, spread), rows=BLOCK)
    turns = [blocks.filter(F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(batches)) == k).rdd.map(tuple) for k in range(batches)]
    m, v, losses, done = None, None, [], 0
    for step in range(steps):
        shared = df.sparkSession.sparkContext.broadcast(net)

        def each(block: Block, shared=shared) -> list[np.ndarray]:
            _, n, x, y, w, _ = block
            w = np.frombuffer(w)
            loss, gradient = loss_and_gradient(shared.value, np.frombuffer(x, np.float32).reshape(n, -1).astype(float), np.frombuffer(y), w)
            return [np.array([loss, w.sum()]), *gradient]

        found = total(turns[step % batches], each)
        shared.unpersist()
        if found is None:
            continue
        done += 1
        size = max(found[0][1], 1e-300)
        losses.append(float(found[0][0] / size))
        gradient = [g / size for g in found[1:]]
        m = gradient if m is None else [0.9 * a + 0.1 * g for a, g in zip(m, gradient, strict=True)]
        v = [g * g for g in gradient] if v is None else [0.999 * a + 0.001 * g * g for a, g in zip(v, gradient, strict=True)]
        net = Net([w - rate * a / (np.sqrt(b) + 1e-8) for w, a, b in zip(net.layers, m, v, strict=True)], mean, spread)
    return net, losses


def net_input(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.nan_to_num((x - mean) / spread).astype(np.float32)


def score(df: DataFrame, net: Net, features: list[str], keep: list[str], threshold: float = 0.5) -> DataFrame:
    """(keep..., p_positive, prediction) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    names = [f"_f{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(shared.value.probability(matrix(batch, names)))], names=[*keep, "p_positive"])

    rows = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    shape = rows.select(*keep).withColumn("p_positive", F.lit(0.0)).schema
    return rows.mapInArrow(run, shape).withColumn("prediction", (F.col("p_positive") > threshold).cast("double"))
