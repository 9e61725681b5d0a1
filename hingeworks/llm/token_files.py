"""Token ids as Parquet list columns (operator 8).

``write_token_files`` range-partitions documents by id, encodes them and writes
one row per document in ascending id order: ``part`` (file number in that
order), ``doc_id``, ``local_start`` (ids of earlier documents in the part),
``n_tokens`` and ``ids``. Token ids are dictionary-encoded (a vocabulary fits
one dictionary page), the metadata columns delta-encoded; row groups and pages
have fixed sizes, and Parquet's page indexes let a reader with a ``doc_id``
filter, or without the ``ids`` column, skip the rest.

Defined results: a null text is empty, so its row holds the end id alone. A null
id sorts first. Rows of equal id are ordered by the hash of their text; equal
rows stay as often as they come. Other columns of the input are ignored. An
empty table gives an empty file set. A text of any length is one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from hingeworks.llm.encoder import encoder
from hingeworks.llm.text import cuts, give_back, utf8

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DELTA_COLUMNS = ("part", "doc_id", "local_start", "n_tokens")


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of about half a megabyte of texts, nulls as empty."""
    _, offsets = utf8(column)
    for first, last in cuts(offsets):
        yield first, last, [t or "" for t in column.slice(first, last - first).to_pylist()]
    give_back()


def encode_rows(path: str, byte_level: bool, end_id: int):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, texts in texts_of(batch.column("text")):
                got = encoder(path, byte_level).encode(texts)
                ends = got.offsets[1:]
                ids = np.insert(got.ids, ends, end_id).astype(np.int32)
                offsets = got.offsets + np.arange(len(texts) + 1)
                lengths = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(texts), part, np.int32)),
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(start + offsets[:-1]),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                ], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                start += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      byte_level: bool = False, row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    writer = ordered.mapInArrow(encode_rows(tokenizer, byte_level, end_id), SCHEMA).write.options(**{
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": "true",
    })
    for name in DELTA_COLUMNS:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written columns and ``start``: ids of all earlier documents of the set."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per part; parts are as many as the writer had tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "part").withColumn(
        "start", F.col("base") + F.col("local_start")).drop("base")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
    view, found, first = memoryview(flat).cast("B"), [], 0
    for end in ends.tolist():
        found.append(zlib.crc32(view[4 * first: 4 * end]))
        first = end
    return pa.array(found, pa.int64())
