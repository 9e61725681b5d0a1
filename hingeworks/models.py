"""Model values and their table forms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hingeworks.functions.kernels import Kernel

LINEAR_MODEL_SCHEMA = "weights array<double>, intercept double, threshold double"
TRACE_SCHEMA = "iter int, elapsed_ms long, loss double"


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray
    intercept: float = 0.0
    threshold: float | None = 0.0

    def with_threshold(self, threshold: float) -> LinearModel:
        return replace(self, threshold=float(threshold))

    def without_threshold(self) -> LinearModel:
        return replace(self, threshold=None)

    def to_table(self, spark: SparkSession) -> DataFrame:
        row = ([float(v) for v in self.weights], float(self.intercept), self.threshold)
        return spark.createDataFrame([row], LINEAR_MODEL_SCHEMA)


@dataclass(frozen=True)
class KernelModel:
    """``support`` is a table ``(id, y, features, alpha)``; y is -1 / +1.

    ``scale`` divides the weighted kernel sum. With ``biased`` the support
    features already end in the constant 1.0 and scoring appends it too.
    ``size`` is the number of support rows and features, where known.
    """

    support: DataFrame
    kernel: Kernel
    scale: float
    biased: bool = False
    intercept: float = 0.0
    threshold: float | None = 0.0
    size: tuple[int, int] | None = None

    def with_threshold(self, threshold: float) -> KernelModel:
        return replace(self, threshold=float(threshold))

    def without_threshold(self) -> KernelModel:
        return replace(self, threshold=None)


@dataclass
class Trace:
    """Loss and cumulative milliseconds of each iteration that had a batch."""

    iterations: list[int] = field(default_factory=list)
    elapsed_ms: list[int] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def add(self, iteration: int, elapsed_ms: int, loss: float) -> None:
        self.iterations.append(iteration)
        self.elapsed_ms.append(elapsed_ms)
        self.losses.append(float(loss))

    def rows(self) -> list[tuple[int, int, float]]:
        return list(zip(self.iterations, self.elapsed_ms, self.losses))

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), TRACE_SCHEMA)


@dataclass(frozen=True)
class TrainingResult:
    model: LinearModel
    trace: Trace
