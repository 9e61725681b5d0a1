"""Update rules: ``(weights, mean gradient, step size, iteration, reg) -> (weights, penalty)``.

``penalty`` is the regularisation term of the returned weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

Updater = Callable[[np.ndarray, np.ndarray, float, int, float], tuple[np.ndarray, float]]


def penalty(weights: np.ndarray, reg: float) -> float:
    return 0.5 * reg * float(weights @ weights)


def require_reg(reg: float) -> None:
    if not reg > 0:
        raise ValueError("this step rule divides by the regularisation parameter; it must be > 0")


def _shrink_and_step(weights, gradient, rate, reg):
    weights = weights * (1.0 - rate * reg) - rate * gradient
    return weights, penalty(weights, reg)


def pegasos_rate(step: float, iteration: int, reg: float) -> float:
    require_reg(reg)
    return step / (iteration * reg)


def sqrt_rate(step: float, iteration: int, reg: float) -> float:
    return step / iteration**0.5


def pegasos_update(weights, gradient, step, iteration, reg):
    return _shrink_and_step(weights, gradient, pegasos_rate(step, iteration, reg), reg)


def sqrt_update(weights, gradient, step, iteration, reg):
    """Squared-L2 rule with a step that falls with the square root of the iteration."""
    return _shrink_and_step(weights, gradient, sqrt_rate(step, iteration, reg), reg)


def linear_pegasos_update(weights, gradient, step, iteration, reg):
    """Pegasos at unit step, whatever ``step`` says."""
    require_reg(reg)
    moved = weights - (reg * weights + gradient) / (reg * iteration)
    return moved, penalty(moved, reg)


def updated_weights(weights: Column, gradient_sum: Column, rows: Column, rate: float,
                    reg: float) -> Column:
    """One update of array columns, for weights and gradients kept in tables."""
    shrink = F.lit(1.0 - rate * reg)
    return F.zip_with(
        weights, gradient_sum, lambda w, g: w * shrink - F.lit(rate) * g / rows
    )
