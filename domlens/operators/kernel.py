"""Kernel machine for the radial kernel (M4): landmarks with a whitened kernel block before a linear solver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import matrix

LANDMARKS = 256  # bound of what the driver collects and tasks hold


class KernelMap:
    """Features z(x) = K(landmarks, landmarks)^(-1/2) k(landmarks, x), so that z(x).z(y) is the kernel on the
    landmarks' span; k(x, y) = exp(-gamma |x - y|^2)."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(self._kernel(landmarks))
        keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        apart = (x ** 2).sum(1)[:, None] + (self.landmarks ** 2).sum(1)[None] - 2 * x @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(apart, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x) @ self.whiten


def fit_kernel_map(train: DataFrame, features: list[str], key: str, gamma: float = 0.1, landmarks: int = LANDMARKS) -> KernelMap:
    """Landmarks are the ``landmarks`` rows with the smallest hashes of their key: the same whatever the splits. Rows
    with null features aren't chosen."""
    rows = train.dropna(subset=features).select(F.xxhash64(F.col(key), F.lit(17)).alias("_h"), F.col(key).alias("_key"), *features)
    found = rows.orderBy("_h", "_key").limit(landmarks).collect()  # ``landmarks`` rows
    points = np.array([[float(r[f]) for f in features] for r in found]).reshape(-1, len(features))
    return KernelMap(np.unique(points, axis=0), gamma)


def with_kernel_features(df: DataFrame, features: list[str], mapping: KernelMap, keep: list[str], out: str = "features") -> DataFrame:
    """(keep..., out): the mapped features of every row as a vector; the map is broadcast, nothing is shuffled. A row
    with a null feature is as far from all landmarks as can be: a vector of zeros."""
    shared = df.sparkSession.sparkContext.broadcast(mapping)
    names = [f"_f{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.nan_to_num(shared.value(matrix(batch, names)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(list(z), pa.list_(pa.float64()))], names=[*keep, "_z"])

    rows = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    shape = rows.select(*keep).withColumn("_z", F.array().cast("array<double>")).schema
    return rows.mapInArrow(run, shape).withColumn(out, array_to_vector("_z")).drop("_z")
