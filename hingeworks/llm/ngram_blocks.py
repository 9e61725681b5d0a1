"""N-gram counts of a whole corpus, brought back to the blocks of text that ask for them.

Documents are gathered to blocks of about ``BLOCK_BYTES``. A block lists its
distinct keys in ascending order with its own counts; the key range is cut into
buckets, each bucket adds up what all blocks say, and answers every block in the
block's own order. So a block never holds more than its own keys, a bucket never
more than its share of all keys, a frequent key counts once per block, and the
driver sees none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.text import Segment, cuts, give_back, heavy_state, utf8

BLOCK_BYTES = 4 << 20
BLOCKS = "block long, doc_ids array<long>, flags array<boolean>, offsets array<long>, data binary"
REQUESTS = "bucket long, kind int, block long, size int, keys binary, counts binary"
ANSWERS = "kind int, bucket long, block long, totals binary, known long, sum long"


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as bytes: planes of equal byte position, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unsqueeze(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def _gather(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, bytes_held = [], 0

        def block() -> pa.RecordBatch:
            column = pa.concat_arrays([b.column("text") for b in held])
            data, offsets = utf8(column)
            packed = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            ids = pa.concat_arrays([b.column("doc_id") for b in held]).to_pylist()
            flags = pa.concat_arrays([b.column("flag") for b in held]).to_pylist()
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([flags], pa.list_(pa.bool_())), pa.array([offsets.tolist()], pa.list_(pa.int64())),
                pa.array([packed], pa.binary())], names=["block", "doc_ids", "flags", "offsets", "data"])

        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for first, last in cuts(offsets, size):
                bytes_here = int(offsets[last] - offsets[first])
                if held and bytes_held + bytes_here > size:
                    yield block()
                    number, held, bytes_held = number + 1, [], 0
                held.append(batch.slice(first, last - first))
                bytes_held += bytes_here
        if held:
            yield block()

    return run


def text_blocks(docs: DataFrame, flag, size: int = BLOCK_BYTES) -> DataFrame:
    """One row per block; ``flag`` is a Column that comes along for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), flag.alias("flag"))
    return rows.mapInArrow(_gather(size), BLOCKS)


@dataclass
class Block:
    number: int
    doc_ids: list
    flags: np.ndarray
    segment: Segment


def unpacked(row: dict) -> Block:
    data = zstandard.ZstdDecompressor().decompress(row["data"])
    segment = Segment(np.frombuffer(data, np.uint8), np.array(row["offsets"], np.int64))
    return Block(row["block"], row["doc_ids"], np.array(row["flags"], bool), segment)


# A function of a block: for each kind its distinct keys, ascending, and the block's counts.
Keys = Callable[[Block], list[tuple[np.ndarray, np.ndarray]]]


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin; buckets are equal parts of the key range."""
    edges = np.array([((1 << 64) * b // buckets) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _ask(keys_of: Keys, buckets: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, counts) in enumerate(keys_of(unpacked(row))):
                    bounds = bucket_bounds(keys, buckets)
                    parts = [(b, s, e) for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])) if e > s]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b for b, _, _ in parts], pa.int64()),
                        pa.array([kind] * len(parts), pa.int32()),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([int(e - s) for _, s, e in parts], pa.int32()),
                        pa.array([squeeze_sorted(keys[s:e]) for _, s, e in parts], pa.binary()),
                        pa.array([squeeze(counts[s:e].astype(np.uint32)) for _, s, e in parts], pa.binary()),
                    ], names=["bucket", "kind", "block", "size", "keys", "counts"])
                give_back()

    return run


def bucket_totals(table: pa.Table) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind: its rows, distinct keys, totals, and each row entry's place among the keys."""
    for kind in sorted(set(table.column("kind").to_pylist())):
        rows = table.filter(pa.compute.equal(table.column("kind"), kind))
        keys = np.concatenate([unsqueeze_sorted(k) for k in rows.column("keys").to_pylist()])
        counts = np.concatenate([unsqueeze(c, np.uint32) for c in rows.column("counts").to_pylist()])
        distinct, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        yield kind, rows, distinct, totals, inverse


def _answer(table: pa.Table) -> pa.Table:
    heavy_state("counts", "none", dict)
    bucket = table.column("bucket")[0].as_py()
    out = {name: [] for name in ("kind", "bucket", "block", "totals", "known", "sum")}
    for kind, rows, distinct, totals, inverse in bucket_totals(table):
        ends = np.cumsum(rows.column("size").to_numpy())
        parts = np.split(totals[inverse], ends[:-1])
        blocks = rows.column("block").to_pylist()
        for n, (block, part) in enumerate(zip(blocks, parts)):
            out["kind"].append(kind)
            out["bucket"].append(bucket)
            out["block"].append(block)
            out["totals"].append(squeeze(part))
            out["known"].append(int((totals > 0).sum()) if n == 0 else 0)
            out["sum"].append(int(totals.sum()) if n == 0 else 0)
    give_back()
    types = {"kind": pa.int32(), "totals": pa.binary()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def requests(blocks: DataFrame, keys_of: Keys, buckets: int) -> DataFrame:
    columns = [F.col(name) for name in ("block", "doc_ids", "flags", "offsets", "data")]
    return blocks.select(*columns).mapInArrow(_ask(keys_of, buckets), REQUESTS)


def answers(asked: DataFrame) -> DataFrame:
    """For each block and kind its keys' totals, bucket by bucket; ``known`` and ``sum`` add
    up to the number of keys that were counted and to all counts of a kind."""
    return asked.groupBy("bucket").applyInArrow(_answer, ANSWERS)


def totals_of(table: pa.Table, kind: int) -> np.ndarray:
    """A block's totals of one kind, in the order of its keys."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("bucket")
    parts = [unsqueeze(t, np.uint64) for t in rows.column("totals").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
