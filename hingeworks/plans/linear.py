"""Trainers of linear models, also over mapped features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame

from hingeworks.functions.kernels import Kernel
from hingeworks.models import LinearModel, TrainingResult
from hingeworks.operators.blocks import BlockTable, pack_and_check
from hingeworks.operators.feature_maps import NystromMap, RandomFourierMap
from hingeworks.operators.gradients import RowGradient, hinge
from hingeworks.operators.scaling import inverse_deviations
from hingeworks.operators.updates import (
    Updater,
    linear_pegasos_update,
    pegasos_update,
    sqrt_update,
)
from hingeworks.operators.validate import require
from hingeworks.plans.descent import SEED, Descent, Setting, descend, wants_rows


def split_weights(weights: np.ndarray, bias: bool) -> tuple[np.ndarray, float]:
    return (weights[:-1], float(weights[-1])) if bias else (weights, 0.0)


def _result(weights: np.ndarray, bias: bool, trace) -> TrainingResult:
    slopes, intercept = split_weights(weights, bias)
    return TrainingResult(LinearModel(slopes, intercept), trace)


def _width(blocks: BlockTable) -> int:
    if blocks.width is None:
        blocks.release()
        raise ValueError("cannot tell the number of features from an empty table")
    return blocks.width


def train_linear_pegasos(points: DataFrame, *, iterations: int = 100, reg: float = 0.01,
                         fraction: float = 1.0, bias: bool = True, seed: int = SEED,
                         feature_map=None,
                         storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> TrainingResult:
    """Pegasos at unit step; the bias, if any, is regularised with the weights.

    Labels are mapped by ``2*label - 1`` without validation.
    """
    blocks = pack_and_check(points, feature_map, storage, wants_rows([Setting(fraction=fraction)]))
    try:
        start = np.zeros(_width(blocks) + bias)
        descent = Descent(iterations, reg, linear_pegasos_update, bias=bias,
                          penalty_after=True, seed=seed)
        weights, (trace,) = descend(blocks, start, descent, [Setting(fraction=fraction)])
    finally:
        blocks.release()
    return _result(weights[:, 0], bias, trace)


def train_with_rule(points: DataFrame, updater: Updater, *, iterations: int = 100,
                    step: float = 1.0, reg: float = 0.01, fraction: float = 1.0,
                    initial_weights: Sequence[float] | None = None, intercept: bool = False,
                    validate: bool = True, validators: Sequence[Column] = (),
                    scale: bool = False, gradient: RowGradient = hinge,
                    seed: int = SEED, feature_map=None,
                    storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> TrainingResult:
    """Mini-batch descent with any update rule and row gradient.

    With ``intercept`` the bias starts at 1.0 and is regularised. ``validate``
    checks that labels are 0 or 1 and that each aggregate in ``validators`` is
    0. ``scale`` trains on features divided by their standard deviation and
    maps the weights back. ``feature_map`` is a function of a matrix, such as the
    ``block`` of a feature map; scaling then is that of the mapped features.
    """
    if validate:
        require(points, validators)
    blocks = pack_and_check(points, feature_map, storage, wants_rows([Setting(fraction=fraction)]))
    try:
        if validate and blocks.bad_labels:
            raise ValueError(f"{blocks.bad_labels} labels are neither 0 nor 1")
        if initial_weights is None:
            initial_weights = np.zeros(0 if blocks.rows == 0 else _width(blocks))
        slopes = np.asarray(initial_weights, dtype=float)
        if blocks.width is not None and len(slopes) != blocks.width:
            raise ValueError(f"{len(slopes)} initial weights for {blocks.width} features")
        start = np.append(slopes, 1.0) if intercept else slopes
        inverse = inverse_deviations(blocks) if scale and blocks.rows else None
        weights, (trace,) = descend(
            blocks, start,
            Descent(iterations, reg, updater, gradient, bias=intercept, seed=seed),
            [Setting(step, fraction)], inverse,
        )
    finally:
        blocks.release()
    slopes, offset = split_weights(weights[:, 0], intercept)
    if inverse is not None:
        slopes = slopes * inverse
    return TrainingResult(LinearModel(slopes, offset), trace)


def train_pegasos(points: DataFrame, **options) -> TrainingResult:
    """``train_with_rule`` with the Pegasos step ``step / (i * reg)``."""
    return train_with_rule(points, pegasos_update, **options)


def train_svm_sgd(points: DataFrame, **options) -> TrainingResult:
    """``train_with_rule`` with the step ``step / sqrt(i)``."""
    return train_with_rule(points, sqrt_update, **options)


def train_rff(points: DataFrame, *, components: int = 40, map_seed: int = 0,
              **options) -> tuple[RandomFourierMap, TrainingResult]:
    """Random Fourier features, then linear Pegasos without bias."""
    mapping = RandomFourierMap.for_points(points, components, map_seed)
    return mapping, train_linear_pegasos(points, bias=False, feature_map=mapping.block, **options)


def train_nystrom(points: DataFrame, *, landmarks: int = 30, kernel: str | Kernel = "gaussian",
                  map_seed: int = 0, **options) -> tuple[NystromMap, TrainingResult]:
    """Nyström features, then linear Pegasos without bias."""
    mapping = NystromMap.fit(points, landmarks, kernel, map_seed)
    return mapping, train_linear_pegasos(points, bias=False, feature_map=mapping.block, **options)
