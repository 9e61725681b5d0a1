"""Sums a descent step needs: hinge sub-gradient, loss and row count.

The accumulated state is one flat vector, so any number of weight vectors
(settings of a sweep) are served by the same scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.keyed import uniform
from hingeworks.operators.blocks import (
    Block,
    partial_sums,
    point_batches,
    point_rows,
    sum_by_position,
)

# A gradient maps (matrix n x d, labels n, margins-before-sign n x k) to the
# per-row loss (n x k) and the per-row factor (n x k) by which the row enters
# the gradient sum.
RowGradient = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def hinge(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hinge loss and sub-gradient factor; a margin of exactly 1 is no violation."""
    sign = (labels * 2.0 - 1.0)[:, None]
    margins = sign * scores
    return np.maximum(0.0, 1.0 - margins), np.where(margins < 1.0, -sign, 0.0)


@dataclass(frozen=True)
class BatchRule:
    """Which rows setting j uses in one iteration.

    A row is in when ``uniform(id, seed) < fraction`` and, for a setting on a
    share of the data, ``uniform(id, share_seed) < share``. The uniform numbers come
    with the rows, one line for each of ``seeds``.
    """

    seed: int
    fractions: tuple[float, ...]
    shares: tuple[float, ...] | None = None
    share_seed: int = 0

    @property
    def seeds(self) -> tuple[int, ...]:
        limited = (self.seed,) if min(self.fractions) < 1.0 else ()
        return limited if self.shares is None else (*limited, self.share_seed)

    def mask(self, draws: np.ndarray) -> np.ndarray:
        limits = [self.fractions] if min(self.fractions) < 1.0 else []
        limits += [] if self.shares is None else [self.shares]
        keep = np.ones((draws.shape[1], len(self.fractions)), dtype=bool)
        for line, limit in zip(draws, limits):
            keep &= line[:, None] < np.array(limit)
        return keep


def gradient_fold(weights: np.ndarray, bias: bool, rule: BatchRule | None,
                  gradient: RowGradient = hinge,
                  ) -> Callable[[Iterable[Block]], np.ndarray | None]:
    """Fold blocks into ``[gradient (d [+1]) x k | loss k | count k]``.

    ``weights`` is ``(d [+1]) x k``; with ``bias`` its last row meets a constant
    1.0 that is never materialised.
    """
    weights = np.atleast_2d(weights.T).T
    length, settings = weights.shape
    slopes, offsets = (weights[:-1], weights[-1]) if bias else (weights, 0.0)

    def fold(blocks):
        state = None
        for draws, labels, cells in blocks:
            keep = None if rule is None else rule.mask(draws)
            if keep is not None:
                used = keep.any(axis=1)
                if not used.all():
                    if not used.any():
                        continue
                    keep, labels, cells = keep[used], labels[used], cells[used]
            loss, factor = gradient(cells @ slopes + offsets, labels)
            if keep is None:
                counts = np.full(settings, len(labels), dtype=float)
            else:
                loss, factor = np.where(keep, loss, 0.0), np.where(keep, factor, 0.0)
                counts = keep.sum(axis=0).astype(float)
            if state is None:
                state = np.zeros((length + 2, settings))
            state[: len(slopes)] += cells.T @ factor
            if bias:
                state[length - 1] += factor.sum(axis=0)
            state[length] += loss.sum(axis=0)
            state[length + 1] += counts
        return state

    return fold


def gradient_sums(points: DataFrame, weights: Sequence[float], intercept: float | None = None,
                  fraction: float = 1.0, seed: int = 43) -> DataFrame:
    """``(dim, gradient, loss_sum, batch_rows)`` of one batch, as one lazy plan.

    ``dim`` counts from 0; with an ``intercept`` the last one is the bias. The
    gradient is that of the hinge loss (minus the sum of y*x over violators).
    """
    w = np.array([*weights, *([] if intercept is None else [intercept])], dtype=float)
    fold = gradient_fold(w, intercept is not None, None)
    rows = point_rows(points)
    if fraction < 1.0:
        rows = rows.where(uniform(F.col("id"), seed) < F.lit(float(fraction)))
    total = sum_by_position(partial_sums(rows, fold, point_batches))
    sums = F.collect_list(F.struct("pos", "value"))
    # The vector is d + 2 long whatever the table holds.
    return (
        total.agg(F.array_sort(sums).alias("state"))
        .where(F.size("state") > 0)
        .select(
            F.posexplode(F.slice("state.value", 1, len(w))).alias("dim", "gradient"),
            F.element_at("state.value", len(w) + 1).alias("loss_sum"),
            F.element_at("state.value", len(w) + 2).cast("long").alias("batch_rows"),
        )
    )
