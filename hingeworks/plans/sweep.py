"""The same trainer under many settings."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from hingeworks.operators.blocks import pack_and_check
from hingeworks.operators.updates import Updater, pegasos_update, sqrt_update
from hingeworks.plans.descent import SEED, Descent, Setting, descend, wants_rows

# The published sweep settings; "svm" multiplies the steps by 30.
STEPS = (1.0, 2.0, 3.0, 4.0, 5.0)
SVM_STEP_FACTOR = 30.0
FRACTIONS = (1.0, 0.8, 0.6, 0.4, 0.2, 0.1, 0.05, 0.01)
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

RULES: dict[str, Updater] = {"pegasos": pegasos_update, "svm": sqrt_update}
SWEEP_SCHEMA = "trainer string, dimension string, value double, iter int, loss double"
TIMED_SCHEMA = "trainer string, dimension string, value double, seconds double"
# Weight vectors carried through one scan; more settings take further scans.
SETTINGS_PER_SCAN = 16


def step_settings(trainer: str, fraction: float = 0.1,
                  steps: Sequence[float] = STEPS) -> list[tuple[float, Setting]]:
    factor = SVM_STEP_FACTOR if trainer == "svm" else 1.0
    return [(s, Setting(step=s * factor, fraction=fraction)) for s in steps]


def batch_settings(step: float = 1.0,
                   fractions: Sequence[float] = FRACTIONS) -> list[tuple[float, Setting]]:
    return [(f, Setting(step=step, fraction=f)) for f in fractions]


def size_settings(step: float = 1.0, fraction: float = 1.0,
                  shares: Sequence[float] = SHARES) -> list[tuple[float, Setting]]:
    """Growing, nested shares of the table in place of a growing number of files."""
    return [(s, Setting(step=step, fraction=fraction, share=s)) for s in shares]


def _trainer_rule(trainer: str) -> Updater:
    try:
        return RULES[trainer]
    except KeyError:
        raise ValueError(f"unknown trainer {trainer!r}; known: {sorted(RULES)}") from None


def sweep(points: DataFrame, trainer: str, dimension: str,
          settings: Sequence[tuple[float, Setting]], *, iterations: int = 100,
          reg: float = 0.01, seed: int = SEED, feature_map=None) -> DataFrame:
    """``(trainer, dimension, value, iter, loss)`` of all settings.

    Each iteration scans the data once for up to ``SETTINGS_PER_SCAN`` settings.
    """
    descent = Descent(iterations, reg, _trainer_rule(trainer), seed=seed)
    blocks = pack_and_check(points, feature_map, by_row=wants_rows([s for _, s in settings]))
    rows = []
    try:
        if blocks.bad_labels:
            raise ValueError(f"{blocks.bad_labels} labels are neither 0 nor 1")
        start = np.zeros(blocks.width or 0)
        for first in range(0, len(settings), SETTINGS_PER_SCAN):
            group = settings[first : first + SETTINGS_PER_SCAN]
            _, traces = descend(blocks, start, descent, [s for _, s in group])
            rows += [
                (trainer, dimension, float(value), i, loss)
                for (value, _), trace in zip(group, traces)
                for i, _, loss in trace.rows()
            ]
    finally:
        blocks.release()
    return points.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def timed_sweep(points: DataFrame, trainer: str, dimension: str,
                settings: Sequence[tuple[float, Setting]], *, iterations: int = 100,
                reg: float = 0.01, seed: int = SEED, feature_map=None) -> DataFrame:
    """``(trainer, dimension, value, seconds)``, each setting trained on its own."""
    descent = Descent(iterations, reg, _trainer_rule(trainer), seed=seed)
    blocks = pack_and_check(points, feature_map, by_row=wants_rows([s for _, s in settings]))
    rows = []
    try:
        for value, setting in settings:
            began = time.monotonic()
            descend(blocks, np.zeros(blocks.width or 0), descent, [setting])
            rows.append((trainer, dimension, float(value), time.monotonic() - began))
    finally:
        blocks.release()
    return points.sparkSession.createDataFrame(rows, TIMED_SCHEMA)
