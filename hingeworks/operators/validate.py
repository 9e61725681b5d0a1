"""Checks of a points table, all in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bad_labels(label: str = "label") -> Column:
    """Number of labels that are neither 0 nor 1."""
    good = F.col(label).isin(0, 1)
    return F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_labels")


def preflight(points: DataFrame) -> DataFrame:
    """``(n_rows, min_width, max_width, bad_labels)``."""
    return points.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("features")).alias("min_width"),
        F.max(F.size("features")).alias("max_width"),
        bad_labels(),
    )


def accepted(points: DataFrame, validators: Sequence[Column]) -> bool:
    """Whether every validator aggregate is 0."""
    try:
        require(points, validators)
    except ValueError:
        return False
    return True


def require(points: DataFrame, validators: Sequence[Column] | None = None) -> None:
    """Raise unless every validator aggregate is 0; binary labels by default."""
    checks = [bad_labels()] if validators is None else list(validators)
    if not checks:
        return
    found = points.agg(*[c.alias(f"check_{i}") for i, c in enumerate(checks)]).first()
    failed = {f"check {i}": v for i, v in enumerate(found) if v}
    if failed:
        raise ValueError(f"input validation failed: {failed}")
