"""Kernel evaluations of a table against a set of anchor rows.

A short set travels to the tasks as one matrix of at most about ``ANCHOR_BYTES``,
any other in parts that a task takes in turn; the table is scanned where it is, once
and without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.kernels import Kernel, kernel_named
from hingeworks.functions.vectors import append_bias, signed_label
from hingeworks.operators.blocks import (
    Block,
    matrices,
    partial_sums,
    point_batches,
    point_rows,
    sum_by_position,
)
from hingeworks.operators.ordering import short_table
from hingeworks.operators.parts import HELD_BYTES, PointParts, broadcast_parts, row_slices

ANCHOR_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray


def collect_anchors(points: DataFrame, most_bytes: int = ANCHOR_BYTES) -> Anchors:
    """Ids, labels and features of a small table, ordered by id; its size is checked first."""
    rows = point_rows(points)
    size = rows.agg(F.sum(F.size("features") + 2)).first()[0] or 0
    if size * 8 > most_bytes:
        raise ValueError(f"the anchor rows exceed {most_bytes} bytes")
    table = rows.toArrow().combine_chunks()
    if table.num_rows == 0:
        return Anchors(np.empty(0, np.int64), np.empty(0), np.empty((0, 0)))
    (_, cells), *others = matrices(table.column("features").combine_chunks())
    if others:
        raise ValueError("anchor rows differ in width")
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return Anchors(ids[order], table.column("label").to_numpy()[order], cells[order])


def vector_udf(block: Callable[[np.ndarray], np.ndarray]):
    """``ARRAY<DOUBLE>`` to ``ARRAY<DOUBLE>``, a matrix at a time."""

    def apply(features: pa.Array) -> pa.Array:
        if len(features) == 0:
            return pa.array([], pa.list_(pa.float64()))
        mapped = np.ascontiguousarray(block(next(matrices_in_order(features))[1]))
        steps = np.arange(0, mapped.size + 1, mapped.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(steps), pa.array(mapped.ravel()))

    return F.arrow_udf(apply, "array<double>")


def kernel_rows(points: DataFrame, anchors: Anchors, kernel: str | Kernel) -> DataFrame:
    """``(id, kernel_row)``: each row's kernel values, in ascending anchor id."""
    rows = kernel_udf(anchors, kernel_named(kernel))(F.col("features"))
    return point_rows(points).select("id", rows.alias("kernel_row"))


def kernel_udf(anchors: Anchors, kernel: Kernel):
    """``ARRAY<DOUBLE>`` to the kernel values against the anchors."""
    block, cells = kernel.block, anchors.cells
    return vector_udf(lambda x: block(x, cells))


def kernel_row_table(points: DataFrame, parts: PointParts, kernel: str | Kernel,
                     keys: Sequence[str] = ("id",)) -> DataFrame:
    """``(*keys, kernel_row)``: each row's kernel values against all parts, in ascending anchor id.

    A task assembles whole rows, so nothing is written or shuffled to put them together.
    """
    held, block = parts.held, kernel_named(kernel).block
    order = np.argsort(parts.ids, kind="stable")
    names = [*keys, "kernel_row"]

    def run(batches):
        for batch in batches:
            for _, cells in matrices_in_order(batch.column("features")):
                for rows in row_slices(len(cells), held.rows):
                    own = cells[rows]
                    values = np.empty((len(own), held.rows))
                    for start, (_, _, anchors) in held.turn():
                        for few in row_slices(len(own), len(anchors)):
                            values[few, start: start + len(anchors)] = block(own[few], anchors)
                    values = np.ascontiguousarray(values[:, order])
                    steps = np.arange(0, values.size + 1, max(1, held.rows), dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(steps[: len(own) + 1]), pa.array(values.ravel()))
                    kept = [batch.column(k).slice(rows.start, len(own)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=names)

    rows = points.select(*keys, F.col("features").cast("array<double>").alias("features"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, kernel_row array<double>")


def matrices_in_order(features: pa.ListArray) -> Iterator[tuple[slice, np.ndarray]]:
    """The one matrix of a batch; rows of different widths are refused."""
    found = list(matrices(features))
    if len(found) > 1:
        raise ValueError("points differ in their number of features")
    return iter(found)


def kernel_scores(weighted: DataFrame, targets: DataFrame, kernel: str | Kernel) -> DataFrame:
    """``(id, score)`` per target: the sum of ``y * alpha * K(x, target)`` over
    all rows of ``weighted (id, y, features, alpha)`` except the target itself.

    Rows of weight 0 are left out before the kernel is evaluated. ``weighted`` is read
    once: a task keeps a batch of its rows while the parts of the targets pass, and
    emits one number a target.
    """
    block, parts = kernel_named(kernel).block, broadcast_parts(targets)
    held = parts.held
    spark = weighted.sparkSession

    def fold(blocks):
        total = None
        for ids, factors, cells in gathered(blocks):
            total = np.zeros(held.rows) if total is None else total
            for start, (names, _, anchors) in held.turn():
                for rows in row_slices(len(cells), len(anchors)):
                    values = block(cells[rows], anchors)
                    values[ids[rows][:, None] == names[None, :]] = 0.0
                    total[start: start + len(anchors)] += factors[rows] @ values
        return total

    rows = weighted.where(F.col("alpha") != 0).select("id", (F.col("y") * F.col("alpha")).alias("label"), "features")
    sums = sum_by_position(partial_sums(point_rows(rows), fold, point_batches))
    names = pa.table({"pos": pa.array(np.arange(held.rows), pa.int32()), "id": pa.array(parts.ids)})
    return spark.createDataFrame(names).join(sums, "pos").select("id", F.col("value").alias("score"))


def gathered(blocks: Iterable[Block]) -> Iterator[Block]:
    """Blocks put together to about ``HELD_BYTES``, so that parts pass once for many rows."""
    waiting, size = [], 0
    for own in blocks:
        if waiting and own[2].shape[1] != waiting[0][2].shape[1]:
            raise ValueError("points differ in their number of features")
        waiting.append(own)
        size += own[2].nbytes
        if size >= HELD_BYTES:
            yield tuple(np.concatenate(x) for x in zip(*waiting))
            waiting, size = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def weighted_sum_udf(parts: PointParts, kernel: Kernel):
    """``ARRAY<DOUBLE>`` to the sum of ``label * K(x, anchor)`` over all parts.

    A task keeps a batch of rows while the parts pass; rows go through once, in order.
    """
    held, block = parts.held, kernel.block

    def totals(waiting: list[pa.Array]) -> Iterator[pa.Array]:
        sizes = [len(x) for x in waiting]
        cells = [m for x in waiting for _, m in matrices_in_order(x)]
        total = np.zeros(sum(sizes))
        if cells:
            cells = np.concatenate(cells)
            for _, (_, weights, anchors) in held.turn():
                for rows in row_slices(len(cells), len(anchors)):
                    total[rows] += block(cells[rows], anchors) @ weights
        cuts = np.cumsum([0, *sizes])
        return (pa.array(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        waiting, size = [], 0
        for features in batches:
            waiting.append(features)
            size += features.nbytes
            if size >= HELD_BYTES:
                yield from totals(waiting)
                waiting, size = [], 0
        yield from totals(waiting)

    return F.arrow_udf(run, "double")


def support_vectors(points: DataFrame, alphas: DataFrame, biased: bool = False,
                    most_rows: int | None = None) -> DataFrame:
    """``(id, y, features, alpha)`` of the rows with ``alpha > 0``.

    ``most_rows`` bounds the ``(id, alpha)`` table, where a bound is known.
    """
    used = alphas.where(F.col("alpha") > 0).select("id", "alpha")
    rows = point_rows(points)
    features = append_bias(F.col("features")) if biased else F.col("features")
    if most_rows is not None:
        used = short_table(used, most_rows)
    return rows.join(used, "id").select(
        "id", signed_label(F.col("label")).alias("y"), features.alias("features"), "alpha"
    )
