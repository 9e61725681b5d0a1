"""The mini-batch descent loop shared by all linear trainers.

Every iteration starts from the same cached block table, so plans never grow
and nothing needs a checkpoint: a lost executor's blocks are packed again from
the source, and keyed sampling picks the same rows again.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from hingeworks.models import Trace
from hingeworks.operators.blocks import (
    BLOCK_COLUMNS,
    BlockTable,
    add_up,
    extract_batches,
    in_row_layout,
    partial_sums,
    pick_rows,
    row_batches,
    small_transfers,
    with_draws,
)
from hingeworks.operators.gradients import BatchRule, RowGradient, gradient_fold, hinge
from hingeworks.operators.updates import Updater

log = logging.getLogger(__name__)

SEED = 42
# Below this fraction Spark takes a batch's rows out of cached blocks in row layout, so
# that only they go to Python.
PICK_BELOW = 0.75
# Below this one the batches of many iterations are taken out in one scan, as many as
# together hold about this share of the table.
EXTRACT_BELOW = 0.03
EXTRACT_SHARE = 0.3
MOST_PER_TASK = 16


@dataclass(frozen=True)
class Setting:
    """What may differ between the weight vectors trained in one loop."""

    step: float = 1.0
    fraction: float = 1.0
    share: float = 1.0


@dataclass(frozen=True)
class Descent:
    iterations: int
    reg: float
    updater: Updater
    gradient: RowGradient = hinge
    bias: bool = False
    # Whether a trace row's penalty is that of the weights after the update.
    penalty_after: bool = False
    seed: int = SEED
    share_seed: int = 0


def fold_tasks(partitions: int, share: float, slots: int) -> int:
    """How many tasks fold a cached table of which ``share`` is read.

    One task folds several cached partitions, which saves task starts and
    partial vectors; long scans get a few tasks per slot, so that a slow one
    can be evened out. No task reads more than ``MOST_PER_TASK`` partitions.
    """
    waves = max(1, min(3, int(partitions * share) // (8 * slots)))
    return min(partitions, max(slots * waves, -(-partitions // MOST_PER_TASK)))


def wants_rows(settings: Sequence[Setting]) -> bool:
    """Whether training these settings needs blocks in row layout."""
    return max(s.fraction for s in settings) < PICK_BELOW


class _Batches:
    """Hands out the rows of each iteration: whole blocks, picked rows, or rows extracted ahead."""

    def __init__(self, blocks: BlockTable, descent: Descent, settings: Sequence[Setting]):
        self._blocks = blocks
        self._descent = descent
        self._fractions = tuple(s.fraction for s in settings)
        self._largest = max(self._fractions)
        shares = tuple(s.share for s in settings)
        self._shares = shares if min(shares) < 1.0 else None
        # Picked rows need no further choice where all settings take the same ones.
        self._alike = min(self._fractions) == self._largest and self._shares is None
        self._extracted: DataFrame | None = None
        self._until = 0
        slots = blocks.spark.sparkContext.defaultParallelism
        share = self._largest if self._largest < EXTRACT_BELOW else 1.0
        self._tasks = fold_tasks(blocks.partitions, share, slots)
        # Blocks in the other layout are laid out anew once, not in every iteration.
        self._laid_out: DataFrame | None = None
        if wants_rows(settings) and not blocks.by_row:
            self._laid_out = in_row_layout(blocks.frame).persist(StorageLevel.MEMORY_AND_DISK)
        self._frame = blocks.frame if self._laid_out is None else self._laid_out
        self._whole = self._fewer(self._frame)

    def _fewer(self, frame: DataFrame) -> DataFrame:
        return frame.coalesce(self._tasks) if self._tasks < self._blocks.partitions else frame

    def _rule(self, iteration: int) -> BatchRule:
        descent = self._descent
        return BatchRule(descent.seed + iteration, self._fractions, self._shares, descent.share_seed)

    def at(self, iteration: int) -> tuple[DataFrame, Callable, BatchRule | None, int]:
        """The rows that hold the batch, their reader, which of them count, and the task number."""
        rule = self._rule(iteration)
        if self._largest >= PICK_BELOW:
            reader = self._blocks.reader
            if not rule.seeds:
                return self._whole.select(*BLOCK_COLUMNS), reader, None, self._tasks
            return with_draws(self._whole, rule.seeds), reader, rule, self._tasks
        own = None if self._alike else rule
        if self._largest >= EXTRACT_BELOW:
            frame = pick_rows(self._whole, self._largest, rule.seed, () if self._alike else rule.seeds)
            return frame, row_batches, own, self._tasks
        if iteration > self._until:
            self._extract(iteration)
        return self._fewer(self._extracted.where(F.col("iter") == iteration)), row_batches, own, self._tasks

    def _extract(self, first: int) -> None:
        self._release_extracted()
        ahead = self._descent.iterations
        if self._largest > 0:
            ahead = max(1, round(EXTRACT_SHARE / self._largest))
        self._until = min(self._descent.iterations, first + ahead - 1)

        def seeds(iteration):  # those of the iteration's rule, as columns
            own = [F.lit(self._descent.seed) + iteration]
            return own if self._shares is None else [*own, F.lit(self._descent.share_seed)]

        self._extracted = extract_batches(
            self._frame, range(first, self._until + 1), self._largest, self._descent.seed,
            None if self._alike else seeds,
        ).persist(StorageLevel.MEMORY_AND_DISK)

    def _release_extracted(self) -> None:
        if self._extracted is not None:
            self._extracted.unpersist()
            self._extracted = None

    def release(self) -> None:
        self._release_extracted()
        if self._laid_out is not None:
            self._laid_out.unpersist()


def descend(blocks: BlockTable, start: np.ndarray, descent: Descent,
            settings: Sequence[Setting] = (Setting(),),
            inverse_scale: np.ndarray | None = None) -> tuple[np.ndarray, list[Trace]]:
    """Run the loop for all settings at once.

    ``start`` is the first weight vector, with the bias last when used. Returns
    the ``len(start) x len(settings)`` weights and one trace per setting. A
    setting whose batch is empty keeps its weights and gets no trace row.
    ``inverse_scale`` trains in the space of divided features: since only dot
    products with the data occur, it is applied to the vectors, not the table.
    """
    count = len(settings)
    weights = np.repeat(np.asarray(start, dtype=float)[:, None], count, axis=1)
    traces = [Trace() for _ in settings]
    if blocks.rows == 0:
        log.warning("no data: returning the initial weights")
        return weights, traces
    for setting in settings:
        if blocks.rows * setting.fraction < 1:
            log.warning("fraction %s is too small for %s rows", setting.fraction, blocks.rows)
    scale = np.ones(len(weights))
    if inverse_scale is not None:
        scale[: len(inverse_scale)] = inverse_scale
    idle = np.zeros(len(weights))
    penalties = [descent.updater(weights[:, j], idle, 0.0, 1, descent.reg)[1]
                 for j in range(count)]

    batches = _Batches(blocks, descent, settings)
    began = time.monotonic()
    try:
        with small_transfers(blocks.spark):
            for iteration in range(1, descent.iterations + 1):
                frame, reader, rule, tasks = batches.at(iteration)
                fold = gradient_fold(weights * scale[:, None], descent.bias, rule,
                                     descent.gradient)
                state = add_up(partial_sums(frame, fold, reader), tasks,
                               (len(weights) + 2) * count)
                if state is None:
                    log.warning("iteration %d has an empty batch", iteration)
                    continue
                state = state.reshape(-1, count)
                sums, losses, rows = state[:-2] * scale[:, None], state[-2], state[-1]
                for j, setting in enumerate(settings):
                    if rows[j] == 0:
                        log.warning("iteration %d, setting %d has an empty batch", iteration, j)
                        continue
                    before = penalties[j]
                    weights[:, j], penalties[j] = descent.updater(
                        weights[:, j], sums[:, j] / rows[j], setting.step, iteration, descent.reg
                    )
                    loss = losses[j] / rows[j]
                    loss += penalties[j] if descent.penalty_after else before
                    traces[j].add(iteration, int((time.monotonic() - began) * 1000), loss)
    finally:
        batches.release()
    return weights, traces
