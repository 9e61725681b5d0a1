"""Decision surfaces: a model scored over a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hingeworks.models import KernelModel, LinearModel
from hingeworks.operators.predict import predict

# Grid steps per axis, spacing.
STEPS_2D, SPACING_2D = 200, 0.02
STEPS_3D, SPACING_3D = 100, 0.05


def _axis(position: Column, steps: int, spacing: float) -> Column:
    return position * F.lit(spacing) - F.lit(steps // 2 * spacing)


def grid(spark: SparkSession, axes: int, steps: int, spacing: float) -> DataFrame:
    """``(id, features)`` of the centred grid; the last axis varies fastest."""
    side = steps + 1
    digits = [
        F.floor(F.col("id") / F.lit(side ** (axes - 1 - a))) % F.lit(side) for a in range(axes)
    ]
    return spark.range(side**axes).select(
        "id", F.array(*[_axis(d, steps, spacing) for d in digits]).alias("features")
    )


def surface_2d(spark: SparkSession, model: LinearModel | KernelModel) -> DataFrame:
    """``(x, y, z)``: the raw score z of each cell."""
    cells = grid(spark, 2, STEPS_2D, SPACING_2D)
    scored = predict(cells, model.without_threshold(), "z")
    return scored.select(
        F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), "z"
    )


def surface_3d(spark: SparkSession, model: LinearModel | KernelModel) -> DataFrame:
    """``(x, y, z)``: per (x, y) the z whose score is nearest to zero, the lowest on ties."""
    cells = grid(spark, 3, STEPS_3D, SPACING_3D)
    scored = predict(cells, model.without_threshold(), "score").select(
        F.col("features")[0].alias("x"),
        F.col("features")[1].alias("y"),
        F.col("features")[2].alias("h"),
        "score",
    )
    nearest = F.min_by("h", F.struct(F.abs("score"), F.col("h")))
    return scored.groupBy("x", "y").agg(nearest.alias("z"))
