"""Positions and running sums in the order of a key, without a single-task sort.

The key range is cut at approximate quantiles into buckets; each bucket is
ordered on its own and starts from the total of the buckets before it. Where
the cuts fall changes only the balance, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from hingeworks.functions.vectors import literal_vector

# A table of at most this many short rows is offered for broadcasting.
BROADCAST_ROWS = 100_000

# Several buckets per shuffle partition even out their hashing.
BUCKETS_PER_PARTITION = 4

_KEY, _BUCKET = "__order_key", "__order_bucket"


def _splits(frame: DataFrame, key: str, buckets: int | None) -> list[float]:
    if not buckets:
        partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = BUCKETS_PER_PARTITION * partitions
    shares = [i / buckets for i in range(1, buckets)]
    cuts = frame.select(
        F.percentile_approx(F.col(key).cast("double"), shares or [0.5], max(10000, 20 * buckets))
    ).first()[0]
    # A table without keys still needs three cuts.
    return [-np.inf, *(sorted(set(cuts or [])) or [0.0]), np.inf]


def _bucketed(frame: DataFrame, key: str, splits: list[float]) -> DataFrame:
    keyed = frame.withColumn(_KEY, F.col(key).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol=_KEY, outputCol=_BUCKET)
    return bucketizer.transform(keyed).withColumn(_BUCKET, F.col(_BUCKET).cast("int"))


def _starts(frame: DataFrame, values: Sequence) -> list[np.ndarray]:
    """Per value, the exclusive running total at the start of every bucket."""
    totals = frame.groupBy(_BUCKET).agg(
        *[F.sum(v).cast("double").alias(f"v{j}") for j, v in enumerate(values)]
    ).collect()  # one short row per bucket
    length = 1 + max((r[0] for r in totals), default=0)
    sums = np.zeros((len(values), length))
    for row in totals:
        sums[:, row[0]] = row[1:]
    return list(np.cumsum(sums, axis=1) - sums)


def _starts_and_rows(cut: DataFrame) -> tuple[list[np.ndarray], int]:
    totals = dict(cut.groupBy(_BUCKET).count().collect())  # one short row per bucket
    counts = np.zeros(1 + max(totals, default=0), np.int64)
    for bucket, rows in totals.items():
        counts[bucket] = rows
    return [np.cumsum(counts) - counts], int(counts.sum())


def running_sums(frame: DataFrame, key: str, sums: dict[str, str],
                 buckets: int | None = None) -> DataFrame:
    """Add ``name = inclusive running sum of column`` in ascending ``key`` order.

    ``key`` must be unique, so that no bucket can be filled by one value.
    """
    splits = _splits(frame, key, buckets)
    starts = _starts(_bucketed(frame, key, splits), [F.col(c) for c in sums.values()])
    cut = _bucketed(frame, key, splits)
    ordered = Window.partitionBy(_BUCKET).orderBy(key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for (name, column), start in zip(sums.items(), starts):
        offset = F.get(literal_vector(start), F.col(_BUCKET))
        cut = cut.withColumn(name, F.sum(column).over(ordered) + offset)
    return cut.drop(_KEY, _BUCKET)


def row_index(frame: DataFrame, key: str = "id", name: str = "idx",
              buckets: int | None = None) -> DataFrame:
    """Dense index 0..n-1 in the order of the unique ``key``."""
    cut = _bucketed(frame, key, _splits(frame, key, buckets))
    return _indexed(cut, key, name, _starts(cut, [F.lit(1)])[0]).drop(_KEY, _BUCKET)


def _indexed(cut: DataFrame, key: str, name: str, start: np.ndarray) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(key)) - F.lit(1)
    offset = F.get(literal_vector(start), F.col(_BUCKET)).cast("long")
    return cut.withColumn(name, rank + offset)


def rows_at(frame: DataFrame, positions: Sequence[int] | Callable[[int], Sequence[int]],
            key: str = "id", name: str = "idx", buckets: int | None = None) -> DataFrame:
    """The rows at the given positions; only buckets that hold one are ordered.

    Positions may be a function of the number of rows, which is known from the buckets.
    """
    cut = _bucketed(frame, key, _splits(frame, key, buckets))
    (start,), rows = _starts_and_rows(cut)
    positions = positions(rows) if callable(positions) else positions
    touched = np.unique(np.searchsorted(start, np.asarray(positions), side="right") - 1)
    spark = frame.sparkSession
    held = spark.createDataFrame([(int(b),) for b in touched], f"{_BUCKET} int")
    # One number a bucket.
    wanted = cut.join(short_table(held, len(touched)), _BUCKET, "left_semi")
    indexed = _indexed(wanted, key, name, start).drop(_KEY, _BUCKET)
    places = spark.createDataFrame([(int(p),) for p in positions], f"{name} long")
    return indexed.join(short_table(places, len(positions)), name, "left_semi")


def short_table(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` of a known number of short rows, to be broadcast if that is small."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame
