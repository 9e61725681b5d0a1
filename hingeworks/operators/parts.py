"""A table of points as parts of bounded size, which tasks use one after another.

The points are written once as packed blocks. The driver reads them back block by
block and hands every full part to Spark as a broadcast variable, so it holds one
part at a time, and so does a task: it keeps a batch of its own rows and takes the
parts in turn. A part is fetched by an executor once and lies on its disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from hingeworks.operators.blocks import BLOCK_COLUMNS, Block, pack, packed_batches
from hingeworks.sources.scratch import written

PART_BYTES = 128 * 1024 * 1024
# A task holds about this much of its own rows while the parts pass, and of values
# against a part.
HELD_BYTES = 32 * 1024 * 1024
VALUE_BYTES = 64 * 1024 * 1024


def row_slices(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose values against so many columns stay within ``VALUE_BYTES``."""
    step = max(1, VALUE_BYTES // (8 * max(1, columns)))
    return (slice(first, first + step) for first in range(0, rows, step))


@dataclass(frozen=True)
class Held:
    """What goes to the tasks: the parts, each ``(ids, labels, matrix)``, and where each starts."""

    parts: list[Broadcast]
    starts: list[int]
    rows: int

    def turn(self) -> Iterator[tuple[int, Block]]:
        """Each part with the position of its first row; no more than one is in memory."""
        for start, part in zip(self.starts, self.parts):
            yield start, part.value
            if len(self.parts) > 1:
                # A worker keeps what it has read of a broadcast; the next turn reads it again.
                vars(part).pop("_value", None)


@dataclass(frozen=True)
class PointParts:
    ids: np.ndarray
    labels: np.ndarray
    held: Held


def _blocks_of(packed: DataFrame) -> Iterator[tuple[np.ndarray, Block]]:
    """``(ids, block)`` one at a time, in any order."""
    for row in packed.select("ids", *BLOCK_COLUMNS).toLocalIterator():
        columns = {n: [row[n]] for n in BLOCK_COLUMNS}
        for block in packed_batches([pa.RecordBatch.from_pydict(columns)]):
            yield np.array(row["ids"], np.int64), block


def broadcast_parts(points: DataFrame) -> PointParts:
    """All rows of ``points (id, label, features)``, however many, in parts of ``PART_BYTES``."""
    packed = written(pack(points), "parts")
    context = points.sparkSession.sparkContext
    parts, starts, ids, labels = [], [], [], []
    waiting, size, width = [], 0, None

    def hand_over():
        own = tuple(np.concatenate(x) for x in zip(*waiting))
        starts.append(sum(map(len, ids)))
        ids.append(own[0])
        labels.append(own[1])
        parts.append(context.broadcast(own))

    for own_ids, (_, own_labels, cells) in _blocks_of(packed):
        if width not in (None, cells.shape[1]):
            raise ValueError("points differ in their number of features")
        width = cells.shape[1]
        if waiting and size + cells.nbytes > PART_BYTES:
            hand_over()
            waiting, size = [], 0
        waiting.append((own_ids, own_labels, cells))
        size += cells.nbytes
    if waiting:
        hand_over()
    rows = sum(map(len, ids))
    return PointParts(np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*labels, np.zeros(0)]),
                      Held(parts, starts, rows))
