"""Keyed sampling and splitting: the same rows under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.keyed import uniform, uniform_array
from hingeworks.operators.ordering import rows_at, short_table

SEED = 42
# Buckets of the key range that draws are looked up in, however many draws there are.
MOST_BUCKETS = 2048


def minibatch(points: DataFrame, fraction: float, iteration: int, seed: int = SEED) -> DataFrame:
    """Bernoulli sample of iteration ``iteration`` (from 1), without replacement."""
    return points.where(uniform(F.col("id"), seed + iteration) < F.lit(float(fraction)))


def landmarks(points: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Uniform sample of exactly ``size`` rows (all rows if there are fewer)."""
    return points.orderBy(uniform(F.col("id"), seed), "id").limit(size)


def random_split(points: DataFrame, weights: Sequence[float] = (0.6, 0.4),
                 seed: int = 11) -> list[DataFrame]:
    """Disjoint parts that together are the whole table."""
    total = float(sum(weights))
    parts, low, reached = [], 0.0, 0.0
    u = uniform(F.col("id"), seed)
    for position, weight in enumerate(weights):
        reached += weight
        high = 1.0 if position == len(weights) - 1 else reached / total
        parts.append(points.where((u >= F.lit(low)) & (u < F.lit(high))))
        low = high
    return parts


def draw_positions(rows: int, iterations: int, seed: int = SEED) -> list[int]:
    """The row position, from 0, drawn in each iteration, from 1."""
    numbers = np.arange(1, iterations + 1)
    return (uniform_array(numbers, seed + numbers) * rows).astype(np.int64).tolist()


def draws(points: DataFrame, iterations: int, seed: int = SEED) -> DataFrame:
    """``(iter, idx, id)``: one uniformly drawn row per iteration, all at once."""
    spark = points.sparkSession
    chosen: list[int] = []

    def positions(rows: int) -> list[int]:
        if rows == 0:
            raise ValueError("cannot draw from an empty table")
        chosen.extend(draw_positions(rows, iterations, seed))
        return sorted(set(chosen))

    # More buckets than a few draws, so that most of the table is never ordered.
    found = rows_at(points.select("id"), positions, buckets=min(MOST_BUCKETS, max(64, 4 * iterations)))
    # One short row per iteration.
    table = spark.createDataFrame(list(enumerate(chosen, 1)), "iter int, idx long")
    return found.join(short_table(table, iterations), "idx").select("iter", "idx", "id")
