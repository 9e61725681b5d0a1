"""Objective value and area under the ROC curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.vectors import hinge_loss, signed_margin
from hingeworks.operators.ordering import running_sums
from hingeworks.sources.scratch import written


def objective(points: DataFrame, weights: Sequence[float], intercept: float = 0.0,
              reg: float = 0.0) -> DataFrame:
    """One row ``(objective)``: mean hinge loss plus ``reg/2 * |w|^2``."""
    penalty = 0.5 * reg * sum(float(v) * float(v) for v in weights)
    margin = signed_margin(F.col("label"), F.col("features"), weights, intercept)
    return points.agg((F.avg(hinge_loss(margin)) + F.lit(penalty)).alias("objective"))


def auroc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row ``(auroc)``; tied scores count half, null when a class is missing.

    Rows are first added up per distinct score, so a score shared by much of
    the table costs one row after the map side. The input is read once: these sums are
    written, and buckets, their totals and ranks are taken from them.
    """
    positive = F.when(F.col(label) > 0.5, 1.0).otherwise(0.0)
    rows = scored.select(
        F.col(score).cast("double").alias("s"), positive.alias("pos"), (1.0 - positive).alias("neg")
    )
    groups = written(rows.groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "score_sums")
    ranked = running_sums(groups, "s", {"neg_upto": "neg"})
    wins = F.col("pos") * (F.col("neg_upto") - F.lit(0.5) * F.col("neg"))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("auroc"))
