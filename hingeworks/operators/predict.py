"""Scores and labels of a table under a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hingeworks.functions.vectors import append_bias, linear_score, threshold_label
from hingeworks.models import KernelModel, LinearModel
from hingeworks.operators.kernel_ops import weighted_sum_udf
from hingeworks.operators.parts import broadcast_parts


def predict(points: DataFrame, model: LinearModel | KernelModel,
            output: str = "prediction") -> DataFrame:
    """Add the thresholded label, or the raw score of a model without threshold."""
    if isinstance(model, LinearModel):
        score = linear_score(F.col("features"), model.weights, model.intercept)
        return points.withColumn(output, threshold_label(score, model.threshold))
    return _predict_kernel(points, model, output)


def _predict_kernel(points: DataFrame, model: KernelModel, output: str) -> DataFrame:
    """The points are read once and written never, however many support rows there are."""
    weighted = model.support.select("id", (F.col("y") * F.col("alpha")).alias("label"), "features")
    parts = broadcast_parts(weighted)
    features = F.col("features").cast("array<double>")
    total = F.lit(0.0)
    if parts.held.rows:
        total = weighted_sum_udf(parts, model.kernel)(append_bias(features) if model.biased else features)
    score = total / F.lit(float(model.scale)) + F.lit(float(model.intercept))
    return points.withColumn(output, threshold_label(score, model.threshold))


def predict_vector(spark: SparkSession, model: LinearModel | KernelModel,
                   vector: Sequence[float]) -> float:
    """Label, or raw score of a model without threshold, of one vector."""
    row = spark.createDataFrame([(0, [float(v) for v in vector])], "id long, features array<double>")
    return predict(row, model).first()["prediction"]
