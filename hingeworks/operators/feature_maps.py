"""Feature maps that approximate a kernel: random Fourier features and Nyström."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.kernels import Kernel, kernel_named
from hingeworks.functions.keyed import normal_array, uniform_array
from hingeworks.operators.kernel_ops import collect_anchors, kernel_row_table, vector_udf
from hingeworks.operators.parts import broadcast_parts
from hingeworks.operators.sampling import landmarks as sample_landmarks
from hingeworks.sources.scratch import written

# Singular values below this share of the largest count as zero.
SINGULAR_FLOOR = 1e-12
# Landmarks and their square matrix; the decomposition takes about three times as much.
MAP_BYTES = 1 << 30


def feature_width(points: DataFrame) -> int:
    row = points.select("features").first()
    if row is None:
        raise ValueError("cannot tell the number of features from an empty table")
    return len(row[0])


@dataclass(frozen=True)
class RandomFourierMap:
    """``sqrt(2/m) * cos(x W + b)`` with W ~ N(0,1) and b ~ U(0, 2 pi).

    Entry (j, k) of W is keyed by ``j*m + k`` under ``seed`` and entry k of b
    by ``k`` under ``seed + 1``.
    """

    weights: np.ndarray
    offsets: np.ndarray

    @classmethod
    def seeded(cls, width: int, components: int = 100, seed: int = 0) -> RandomFourierMap:
        keys = np.arange(width * components)
        offsets = 2.0 * math.pi * uniform_array(np.arange(components), seed + 1)
        return cls(normal_array(keys, seed).reshape(width, components), offsets)

    @classmethod
    def for_points(cls, points: DataFrame, components: int = 100,
                   seed: int = 0) -> RandomFourierMap:
        return cls.seeded(feature_width(points), components, seed)

    def block(self, cells: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / len(self.offsets)) * np.cos(cells @ self.weights + self.offsets)

    def transform(self, points: DataFrame) -> DataFrame:
        return points.withColumn("features", vector_udf(self.block)("features"))


@dataclass(frozen=True)
class NystromMap:
    """``[K(s_1, x) .. K(s_m, x)] N`` with N the inverse square root of the Gram matrix.

    The fit is dense algebra on one m x m matrix on the driver, so m is a choice
    of the caller that does not grow with the table: landmarks and matrix together
    have at most ``MAP_BYTES`` (11,000 landmarks of 1,000 features), more are refused.
    """

    landmarks: np.ndarray
    normalization: np.ndarray
    kernel: Kernel

    @classmethod
    def fit(cls, points: DataFrame, landmarks: int = 30, kernel: str | Kernel = "gaussian",
            seed: int = 0) -> NystromMap:
        kernel = kernel_named(kernel)
        chosen = collect_anchors(sample_landmarks(points, landmarks, seed), MAP_BYTES)
        rows, width = chosen.cells.shape
        if 8 * rows * (rows + width) > MAP_BYTES:
            raise ValueError(f"{rows} landmarks of {width} features exceed {MAP_BYTES} bytes")
        # Symmetric, so singular values are the eigenvalues' sizes.
        values, vectors = np.linalg.eigh(kernel.block(chosen.cells, chosen.cells))
        sizes = np.abs(values)
        kept = sizes > SINGULAR_FLOOR * sizes.max()
        root = np.sign(values[kept]) / np.sqrt(sizes[kept])
        return cls(chosen.cells, (vectors[:, kept] * root) @ vectors[:, kept].T, kernel)

    def block(self, cells: np.ndarray) -> np.ndarray:
        return self.kernel.block(cells, self.landmarks) @ self.normalization

    def transform(self, points: DataFrame) -> DataFrame:
        return points.withColumn("features", vector_udf(self.block)("features"))


def gram(points: DataFrame, size: int, kernel: str | Kernel, seed: int = 0) -> DataFrame:
    """``(id, kernel_row)`` of a landmark sample against itself, in ascending anchor id."""
    # Written once: the sample is both sides.
    chosen = written(sample_landmarks(points, size, seed).select("id", "label", "features"), "landmarks")
    return kernel_row_table(chosen, broadcast_parts(chosen), kernel)
