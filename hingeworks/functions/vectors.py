"""Column expressions over ``ARRAY<DOUBLE>`` features and {0,1} labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal_vector(values: Sequence[float]) -> Column:
    """A constant ``ARRAY<DOUBLE>``, folded into the plan as one literal.

    The text form keeps every bit of a double and costs one expression instead
    of one per element.
    """
    values = [float(v) for v in values]
    if not values:
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
    )


def signed_label(label: Column) -> Column:
    """{0,1} to {-1,+1}."""
    return label * F.lit(2.0) - F.lit(1.0)


def append_bias(features: Column) -> Column:
    return F.concat(features, F.array(F.lit(1.0)))


def split_bias(weights: Column) -> tuple[Column, Column]:
    """``(weights without the last entry, last entry)``."""
    return F.slice(weights, F.lit(1), F.size(weights) - F.lit(1)), F.element_at(weights, -1)


def linear_score(features: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    return dot(features, literal_vector(weights)) + F.lit(float(intercept))


def threshold_label(score: Column, threshold: float | None) -> Column:
    """1.0 where the score is strictly above the threshold; raw score for None."""
    if threshold is None:
        return score
    return F.when(score > F.lit(float(threshold)), F.lit(1.0)).otherwise(F.lit(0.0))


def signed_margin(label: Column, features: Column, weights: Sequence[float],
                  intercept: float = 0.0) -> Column:
    return signed_label(label) * linear_score(features, weights, intercept)


def hinge_loss(margin: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - margin)
