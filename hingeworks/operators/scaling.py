"""Division of each feature by its standard deviation, without centring."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.vectors import literal_vector
from hingeworks.operators.blocks import (
    BLOCK_COLUMNS,
    BlockTable,
    add_up,
    partial_sums,
    point_rows,
)

# Moments are merged on the cluster into this many vectors before the last merge.
MOMENT_SHARDS = 64


def column_deviations(points: DataFrame) -> np.ndarray:
    """Sample standard deviation of every feature, in one scan."""
    moments = (
        point_rows(points)
        .select(
            F.pmod(F.spark_partition_id(), F.lit(MOMENT_SHARDS)).alias("shard"),
            array_to_vector("features").alias("v"),
        )
        .groupBy("shard")
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("m"))
        .select("m.count", "m.mean", "m.variance")
        .collect()
    )
    if not moments:
        raise ValueError("no data to scale by")
    total, mean, spread = 0, 0.0, 0.0
    for count, part_mean, part_variance in moments:
        part_mean = part_mean.toArray()
        gap = part_mean - mean
        joined = total + count
        spread = spread + part_variance.toArray() * (count - 1)
        spread = spread + gap * gap * (total * count / joined)
        mean, total = mean + gap * (count / joined), joined
    return np.sqrt(spread / max(1, total - 1))


def block_deviations(blocks: BlockTable) -> np.ndarray:
    """Sample standard deviation of every feature of a packed table, without its source.

    Sums are those of the distances to one row, so far values lose no digits.
    """
    columns = blocks.frame.select(*BLOCK_COLUMNS)
    (_, _, some), *_ = blocks.reader(columns.limit(1).toArrow().to_batches())
    centre, width = some[0].copy(), some.shape[1]

    def fold(parts):
        state = None
        for _, _, cells in parts:
            gap = cells - centre
            own = np.concatenate([[len(gap)], gap.sum(axis=0), (gap * gap).sum(axis=0)])
            state = own if state is None else state + own
        return state

    total = add_up(partial_sums(columns, fold, blocks.reader), blocks.partitions, 2 * width + 1)
    rows, sums, squares = total[0], total[1: width + 1], total[width + 1:]
    return np.sqrt(np.maximum(squares - sums * sums / rows, 0.0) / max(1.0, rows - 1))


def inverse_deviations(points: DataFrame | BlockTable) -> np.ndarray:
    """``1 / deviation``, and 0 for a constant feature."""
    packed = isinstance(points, BlockTable)
    deviations = block_deviations(points) if packed else column_deviations(points)
    return np.divide(1.0, deviations, out=np.zeros_like(deviations), where=deviations != 0)


def scale_features(points: DataFrame) -> DataFrame:
    factors = literal_vector(inverse_deviations(points))
    return points.withColumn(
        "features", F.zip_with("features", factors, lambda x, f: x * f)
    )
