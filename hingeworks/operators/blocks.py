"""Points packed into blocks, and vector sums over them.

A training pass is a scan of the cached table by vectorised Python tasks.
Rows are therefore packed once into binary blocks of about ``BLOCK_BYTES``:
a block crosses into Python as one buffer and is used there without copying.
Each task folds its blocks into one flat vector of partial sums; the partial
vectors are added up by position and in two steps, so no task ever receives
all of them.

A block's labels and features are one buffer each, or lists of one item a row
(``by_row``). Ids stay on Spark's side: keyed sampling is an expression over a
block's ids, and out of a block in row layout the rows that it picks are taken before
anything goes to Python.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from hingeworks.functions.keyed import uniform

log = logging.getLogger(__name__)

# Measured: blocks and transfers that stay inside the core's cache are about
# twice as fast as multi-megabyte ones.
BLOCK_BYTES = 128 * 1024
TRANSFER_BYTES = 1024 * 1024
# A table in fewer partitions than there are slots is spread anew when its fullest
# partition has more than this many blocks.
FULL_BLOCKS = 32
# Partial vectors of up to this many bytes together are added on the driver; more
# are first added on the cluster, in chunks of so many elements.
DIRECT_BYTES = 32 * 1024 * 1024
CHUNK = 4096
BLOCK_COLUMNS = ("rows", "width", "labels", "cells")
_COUNTS = "bad_labels int, rows int, width int, ids array<bigint>"
BLOCK_SCHEMA = f"{_COUNTS}, labels binary, cells binary"
ROW_SCHEMA = f"{_COUNTS}, labels array<double>, cells array<binary>"
PARTIAL_SCHEMA = "chunk int, state array<double>"

# What identifies or chooses rows, if anything does, their labels and their features.
Block = tuple[np.ndarray | None, np.ndarray, np.ndarray]


@contextmanager
def small_transfers(spark: SparkSession):
    """Bound the bytes per Arrow transfer while a training loop runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(TRANSFER_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def point_rows(points: DataFrame) -> DataFrame:
    return points.select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("double").alias("label"),
        F.col("features").cast("array<double>").alias("features"),
    )


def matrices(features: pa.ListArray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """``(row selection, matrix)`` for each width that occurs in the batch."""
    if len(features) == 0:
        return
    values = features.flatten()
    if features.null_count or values.null_count:
        raise ValueError("features must not be null")
    widths = np.diff(features.offsets.to_numpy())
    flat = values.to_numpy()
    if (widths == widths[0]).all():
        yield slice(None), flat.reshape(len(features), widths[0])
        return
    starts = np.concatenate(([0], np.cumsum(widths)[:-1]))
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        yield chosen, flat[starts[chosen][:, None] + np.arange(width)]


def point_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """``(ids, labels, matrix)`` from batches of point rows."""
    for batch in batches:
        if batch.column("id").null_count or batch.column("label").null_count:
            raise ValueError("id and label must not be null")
        ids = batch.column("id").to_numpy()
        labels = batch.column("label").to_numpy()
        for chosen, cells in matrices(batch.column("features")):
            yield ids[chosen], labels[chosen], cells


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    """``settings x rows`` numbers of one block: a list of lists."""
    return np.array(column[row].as_py(), dtype=np.float64)


def packed_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """``(draws, labels, matrix)`` from batches of packed blocks, without copies.

    ``draws`` are the rows' uniform numbers, one line a seed, where the table has them.
    """
    for batch in batches:
        shapes = zip(batch.column("rows").to_pylist(), batch.column("width").to_pylist())
        columns = [batch.column(name) for name in ("labels", "cells")]
        drawn = batch.column("draws") if "draws" in batch.schema.names else None
        for i, shape in enumerate(shapes):
            labels, cells = (c[i].as_buffer() for c in columns)
            narrow = cells.size < 8 * shape[0] * shape[1]
            flat = np.frombuffer(cells, np.float32 if narrow else np.float64)
            matrix = flat.reshape(shape).astype(np.float64, copy=False)
            draws = None if drawn is None else _numbers(drawn, i)
            yield draws, np.frombuffer(labels, np.float64), matrix


def _joined(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and where each row starts."""
    values = rows.flatten()
    if len(values) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    starts = np.frombuffer(values.buffers()[1], np.int32)[values.offset: values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]: starts[-1]], starts - starts[0]


def row_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """``(draws, labels, matrix)`` from batches in row layout: one matrix a batch, without copies."""
    for batch in batches:
        labels = batch.column("labels").flatten().to_numpy()
        if len(labels) == 0:
            continue
        width = batch.column("width")[0].as_py()
        data, starts = _joined(batch.column("cells"))
        draws = None
        if "draws" in batch.schema.names:
            draws = np.concatenate([_numbers(batch.column("draws"), i) for i in range(batch.num_rows)], axis=1)
        # Rows of blocks in single and in double precision may follow one another.
        sizes = np.diff(starts)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            kind = np.float32 if sizes[a] < 8 * width else np.float64
            flat = data[starts[a]: starts[b]].view(kind).reshape(b - a, width)
            yield None if draws is None else draws[:, a:b], labels[a:b], flat.astype(np.float64, copy=False)


def _narrowed(cells: np.ndarray) -> np.ndarray:
    """The matrix in single precision where that loses nothing."""
    for part in (cells[:4], cells):
        narrow = part.astype(np.float32)
        if not np.array_equal(narrow, part):
            return cells
    return narrow


def _pieces(rows: int, width: int) -> np.ndarray:
    """Row numbers at which blocks start, and the number of rows."""
    step = max(1, BLOCK_BYTES // (8 * max(1, width)))
    return np.append(np.arange(0, rows, step), rows)


def _sliced(array: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values over one buffer: the rows between consecutive cuts."""
    array = np.ascontiguousarray(array)
    offsets = (cuts * (array.nbytes // max(1, len(array)))).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(array)]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def _row_lists(cuts: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> dict[str, pa.Array]:
    """Lists of the labels and of the rows' bytes between consecutive cuts."""
    steps = pa.array(cuts, pa.int32())
    return {"labels": pa.ListArray.from_arrays(steps, pa.array(labels, pa.float64())),
            "cells": pa.ListArray.from_arrays(steps, _sliced(cells, np.arange(len(cells) + 1)))}


def _block_columns(block: Block, by_row: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where the blocks of a matrix start, and their columns."""
    ids, labels, cells = block
    cuts = _pieces(len(ids), cells.shape[1])
    cells = _narrowed(cells)
    columns = {
        "rows": pa.array(np.diff(cuts), pa.int32()),
        "width": pa.array(np.full(len(cuts) - 1, cells.shape[1]), pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int64())),
    }
    if by_row:
        return cuts, columns | _row_lists(cuts, labels, cells)
    return cuts, columns | {"labels": _sliced(labels, cuts), "cells": _sliced(cells, cuts)}


def _pack_task(feature_map: Callable[[np.ndarray], np.ndarray] | None, by_row: bool):
    def task(batches):
        for ids, labels, cells in point_batches(batches):
            if feature_map is not None:
                cells = feature_map(cells)
            cuts, columns = _block_columns((ids, labels, cells), by_row)
            bad = (labels != 0.0) & (labels != 1.0)
            bad = pa.array(np.add.reduceat(bad, cuts[:-1], dtype=int), pa.int32())
            yield pa.RecordBatch.from_pydict({"bad_labels": bad, **columns})

    return task


@dataclass(frozen=True)
class BlockTable:
    """A cached block table with what its one filling pass counted."""

    frame: DataFrame
    rows: int
    width: int | None
    bad_labels: int
    partitions: int
    by_row: bool = False

    @property
    def reader(self) -> Callable[[Iterable[pa.RecordBatch]], Iterator[Block]]:
        return row_batches if self.by_row else packed_batches

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def release(self) -> None:
        self.frame.unpersist()


def pack(points: DataFrame, feature_map: Callable[[np.ndarray], np.ndarray] | None = None,
         by_row: bool = False) -> DataFrame:
    """The block form of ``points``, optionally with mapped features."""
    return point_rows(points).mapInArrow(_pack_task(feature_map, by_row), ROW_SCHEMA if by_row else BLOCK_SCHEMA)


def in_row_layout(blocks: DataFrame) -> DataFrame:
    """A block table with the same blocks in row layout."""

    def task(batches):
        for batch in batches:
            for i, (_, labels, _) in enumerate(packed_batches([batch])):
                one, data = batch.slice(i, 1), batch.column("cells")[i].as_buffer()
                cells = np.frombuffer(data, np.uint8).reshape(len(labels), -1)
                lists = _row_lists(np.array([0, len(labels)]), labels, cells)
                yield pa.RecordBatch.from_pydict(
                    {n: lists[n] if n in lists else one.column(n) for n in batch.schema.names})

    return blocks.mapInArrow(task, ROW_SCHEMA)


def pack_and_check(points: DataFrame,
                   feature_map: Callable[[np.ndarray], np.ndarray] | None = None,
                   storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
                   by_row: bool = False) -> BlockTable:
    """Pack, cache and validate in a single pass over the source."""
    _advise_cached(points)
    frame = pack(points, feature_map, by_row).persist(storage)
    try:
        seen = _seen(_partition_counts(frame))
    except Exception:
        frame.unpersist()
        raise

    if seen["low"] != seen["high"]:
        frame.unpersist()
        raise ValueError(f"points have between {seen['low']} and {seen['high']} features")
    partitions = seen["partitions"]
    # Input that could not be split (one large compressed file, say) is spread once.
    slots = frame.sparkSession.sparkContext.defaultParallelism
    wanted = max(partitions, min(slots, seen["blocks"]))
    if partitions < wanted and seen["most"] > FULL_BLOCKS:
        even = frame.repartition(wanted).persist(storage)
        even.count()
        frame.unpersist()
        frame, partitions = even, wanted
    return BlockTable(frame, seen["rows"], seen["low"], seen["bad"], partitions, by_row)


def _seen(parts: DataFrame) -> Row:
    return parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.max("part") + 1, F.lit(0)).alias("partitions"),
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"),
        F.coalesce(F.max("blocks"), F.lit(0)).alias("most"),
    ).first()


def _advise_cached(points: DataFrame) -> None:
    """Validators read the source again, so say where it is not cached."""
    level = points.storageLevel
    if not (level.useMemory or level.useDisk):
        log.warning("the input is not cached; validators scan it again")


def _partition_counts(frame: DataFrame) -> DataFrame:
    parts = frame.select("rows", "width", "bad_labels", F.spark_partition_id().alias("part"))
    return parts.groupBy("part").agg(
        F.sum("rows").alias("rows"),
        F.min("width").alias("low"),
        F.max("width").alias("high"),
        F.sum("bad_labels").alias("bad"),
        F.count(F.lit(1)).alias("blocks"),
    )


def _rows_of(part: str, picked: Column) -> Column:
    """The picked rows' items out of a block's ``labels`` or ``cells``."""
    return F.transform(picked, lambda row: F.get(part, row))


def _picked(fraction: float, seed: Column) -> Column:
    """Places, from 0, of the rows that a keyed sample takes out of a block."""
    places = F.sequence(F.lit(0), F.col("rows") - 1)
    return F.filter(places, lambda row: uniform(F.get("ids", row), seed) < F.lit(float(fraction)))


def _draw_lines(places: Column, seeds: Sequence[int | Column]) -> Column:
    """The uniform numbers of the rows at some places of a block, one line a seed."""

    def line(seed: int | Column) -> Column:
        return F.transform(places, lambda row: uniform(F.get("ids", row), seed))

    return F.array(*(line(seed) for seed in seeds))


def with_draws(blocks: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Whole blocks, in either layout, with every row's uniform number under each seed."""
    places = F.sequence(F.lit(0), F.col("rows") - 1)
    return blocks.select(*BLOCK_COLUMNS, _draw_lines(places, seeds).alias("draws"))


def pick_rows(blocks: DataFrame, fraction: float, seed: int, draw_seeds: Sequence[int] = ()) -> DataFrame:
    """The rows of one keyed mini-batch out of blocks in row layout, as lists of labels and of features.

    Row ``id`` is in when ``uniform(id, seed) < fraction``. A row that is not in is
    never copied, and never leaves Spark.
    """
    placed = blocks.withColumn("picked", _picked(fraction, F.lit(seed)))
    lines = [_draw_lines(F.col("picked"), draw_seeds).alias("draws")] if draw_seeds else []
    return placed.select(
        "width", _rows_of("labels", F.col("picked")).alias("labels"), _rows_of("cells", F.col("picked")).alias("cells"),
        *lines)


def extract_batches(blocks: DataFrame, iterations: range, fraction: float, seed: int,
                    draw_seeds: Callable[[Column], Sequence[Column]] | None = None) -> DataFrame:
    """The keyed mini-batches of all given iterations, out of one scan, as ``iter`` and picked rows.

    Iteration i takes the rows with ``uniform(id, seed + i) < fraction``, which
    does not depend on the model, so many iterations share the scan. Rows are
    ordered by iteration inside each partition: once cached, an iteration reads
    its own rows and the column statistics skip the rest.
    """
    numbers = F.sequence(F.lit(iterations[0]), F.lit(iterations[-1]))
    lots = F.transform(numbers, lambda i: F.struct(
        i.alias("iter"), _picked(fraction, F.lit(seed) + i).alias("picked")))
    placed = blocks.withColumn("lots", F.filter(lots, lambda lot: F.size(lot["picked"]) > 0))

    def cut(lot: Column) -> Column:
        lines = [_draw_lines(lot["picked"], draw_seeds(lot["iter"])).alias("draws")] if draw_seeds else []
        return F.struct(
            lot["iter"].alias("iter"), F.col("width").alias("width"),
            _rows_of("labels", lot["picked"]).alias("labels"), _rows_of("cells", lot["picked"]).alias("cells"), *lines)

    return placed.select(F.inline(F.transform("lots", cut))).sortWithinPartitions("iter")


def partial_sums(frame: DataFrame, fold: Callable[[Iterable[Block]], np.ndarray | None],
                 reader: Callable[[Iterable[pa.RecordBatch]], Iterator[Block]]) -> DataFrame:
    """``(chunk, state)``: the flat vector ``fold`` makes of each partition, cut into chunks."""

    def task(batches):
        state = fold(reader(batches))
        if state is not None:
            flat = np.asarray(state, dtype=np.float64).ravel()
            cuts = np.append(np.arange(0, len(flat), CHUNK), len(flat))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(cuts) - 1), pa.int32()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
            ], names=["chunk", "state"])

    return frame.mapInArrow(task, PARTIAL_SCHEMA)


def _add_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the vectors of one chunk as they stream by; keys go through."""
    total = first = None
    for batch in batches:
        first = batch if first is None else first
        for state in batch.column("state"):
            own = state.values.to_numpy()
            if total is None:
                total = own.copy()
            else:
                total += own
    columns = [pa.array([total], pa.list_(pa.float64())) if name == "state" else first.column(name).slice(0, 1)
               for name in first.schema.names]
    yield pa.RecordBatch.from_arrays(columns, names=first.schema.names)


def add_chunks(partials: DataFrame) -> DataFrame:
    """``(chunk, state)`` with one row per chunk: partial vectors added on the cluster, in two steps.

    Of n tasks, those with ``floor(sqrt(task)) = g`` are one group: at most ``2 sqrt(n)``
    vectors in the first step and ``sqrt(n)`` sums in the second, without n being known.
    """
    group = F.floor(F.sqrt(F.spark_partition_id().cast("double"))).cast("int")
    grouped = partials.withColumn("group", group).select("chunk", "group", "state").groupBy("chunk", "group")
    first = grouped.applyInArrow(_add_group, "chunk int, group int, state array<double>")
    return first.select("chunk", "state").groupBy("chunk").applyInArrow(_add_group, PARTIAL_SCHEMA)


def sum_by_position(partials: DataFrame) -> DataFrame:
    """``(pos, value)``: partial vectors added on the cluster, chunk by chunk."""
    return add_chunks(partials).select("chunk", F.posexplode("state").alias("at", "value")).select(
        (F.col("chunk") * CHUNK + F.col("at")).alias("pos"), "value")


def add_up(partials: DataFrame, partitions: int, length: int) -> np.ndarray | None:
    """The total of the partial vectors; the driver receives ``DIRECT_BYTES`` or one vector."""
    if 8 * partitions * length > DIRECT_BYTES:
        partials = add_chunks(partials)
    table = partials.toArrow()
    if table.num_rows == 0:
        return None
    total = np.zeros(length)
    for chunk, state in zip(table.column("chunk").to_pylist(), table.column("state")):
        own = state.values.to_numpy()
        total[chunk * CHUNK: chunk * CHUNK + len(own)] += own
    return total
