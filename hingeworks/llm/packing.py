"""Vector best-fit packing of token pieces into sequences (operator 6).

A document's ids, with an end id, are cut into pieces of at most ``tokens``.
Pieces are packed by best fit in decreasing order under three capacities:
tokens, pieces and attention cost (sum of squared piece lengths). Of the
sequences where every capacity holds, the rule takes

* ``norm``: the smallest weighted norm of what stays free, or
* ``dot``: the largest weighted dot product of the piece and what is free.

Pieces are dealt to groups of about ``GROUP_PIECES`` by a hash, and each group is
packed on its own: a group wastes at most its last sequences, and no task holds
more than its group.

Defined results: a null text is empty and is one piece with the end id; so every
row has at least one piece. Equal rows are packed one by one. A piece above the
cost capacity alone is an error of the parameters. Other columns of the input
are ignored; an empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.encoder import encoder
from hingeworks.llm.tables import written
from hingeworks.llm.token_files import texts_of

GROUP_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and the weights of the three dimensions in the rule."""

    tokens: int = 4096
    pieces: int = 4096
    cost: float = 4096.0 ** 2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def cut_rows(path: str, byte_level: bool, end_id: int, size: int):
    def run(batches):
        for batch in batches:
            for first, last, texts in texts_of(batch.column("text")):
                got = encoder(path, byte_level).encode(texts)
                lengths = np.diff(got.offsets) + 1
                pieces = -(-lengths // size)
                owner = np.repeat(np.arange(len(texts)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * size
                length = np.minimum(size, lengths[owner] - start)
                ids = np.insert(got.ids, got.offsets[1:], end_id).astype("<u4")
                at = (got.offsets[:-1] + np.arange(len(texts)))[owner] + start
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a: 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first).take(pa.array(owner)),
                    pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(sums, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    limits = np.array([capacity.tokens, capacity.pieces, capacity.cost], float)
    demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / limits[:, None]
    if len(lengths) and demands.max() > 1:
        raise ValueError("a piece exceeds a capacity")
    weights = np.array(capacity.weights)[:, None]
    slack = 1e-12
    free = np.zeros((3, 1024))  # of open sequences, in no order
    names = np.zeros(1024, np.int64)
    opened = total = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    filled = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = demands[:, order[-1]] if len(order) else None
    for i in order.tolist():
        need = demands[:, i: i + 1]
        rest = free[:, :opened] - need
        fits = (rest >= -slack).all(axis=0)
        place = -1
        if fits.any():
            if capacity.rule == "norm":
                value = np.where(fits, (weights * rest * rest).sum(axis=0), np.inf)
                place = int(value.argmin())
            else:
                value = np.where(fits, (weights * need * free[:, :opened]).sum(axis=0), -np.inf)
                place = int(value.argmax())
        if place < 0:
            if opened == free.shape[1]:
                free = np.concatenate([free, np.zeros_like(free)], axis=1)
                names = np.concatenate([names, np.zeros_like(names)])
            place = opened
            free[:, place], names[place] = 1.0, total
            opened, total = opened + 1, total + 1
        free[:, place] -= need[:, 0]
        name = names[place]
        sequence[i], offset[i] = name, filled[name]
        filled[name] += lengths[i]
        if (free[:, place] < least - slack).any():  # nothing fits any more
            opened -= 1
            free[:, place], names[place] = free[:, opened], names[opened]
    return sequence, offset


def _pack_group(capacity: Capacity):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        sequence, offset = best_fit(table.column("length").to_numpy(), capacity)
        kept = table.drop_columns(["pack_group"])
        return kept.append_column("sequence_id", pa.array((group << 32) + sequence)).append_column(
            "offset", pa.array(offset))

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int,
                  byte_level: bool = False) -> DataFrame:
    """One row per piece: id, number, start in the document, length, crc32 of its ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut_rows(tokenizer, byte_level, end_id, size), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: Capacity = Capacity(),
         byte_level: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    pieces = written(cut_documents(docs, tokenizer, end_id, capacity.tokens, byte_level), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("pack_group", key).groupBy("pack_group").applyInArrow(
        _pack_group(capacity), PACKED)
