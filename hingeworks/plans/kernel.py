"""Kernel Pegasos.

Which row each iteration draws does not depend on the model, and only drawn
rows can get a weight. So all rows are drawn first and the kernel is evaluated
among the distinct drawn rows alone; the recurrence over those values gives
what a full scan per iteration would give, since rows of weight 0 add nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.kernels import Kernel, kernel_named
from hingeworks.functions.vectors import append_bias
from hingeworks.models import KernelModel
from hingeworks.operators.kernel_ops import kernel_row_table, support_vectors
from hingeworks.operators.ordering import short_table
from hingeworks.operators.parts import PointParts, broadcast_parts
from hingeworks.operators.sampling import SEED, draws
from hingeworks.operators.updates import require_reg
from hingeworks.sources.scratch import fresh_path, written

# The driver holds at most about this much of the kernel matrix at a time.
GRAM_BYTES = 64 * 1024 * 1024


def _bands(drawn: DataFrame, order: list[int], parts: PointParts, kernel: Kernel, block: int) -> DataFrame:
    """``(band, id, kernel_row)``: the kernel rows that each block of iterations needs, one band a block."""
    spark = drawn.sparkSession
    pairs = sorted({(i // block, drawn_id) for i, drawn_id in enumerate(order)})
    # At most one short row per iteration.
    wanted = short_table(spark.createDataFrame(pairs, "band int, id long"), len(pairs))
    rows = drawn.join(wanted, "id").select("band", "id", "features")
    # Features are dealt by band, so that a band is a file or few; kernel rows are not moved.
    count = pairs[-1][0] + 1
    if count == 1:  # read once, so not written
        return kernel_row_table(rows, parts, kernel, ("band", "id"))
    made = kernel_row_table(rows.repartition(count, "band"), parts, kernel, ("band", "id"))
    path = fresh_path(spark, "kernel_bands")
    made.write.partitionBy("band").parquet(path)
    return spark.read.schema("id long, kernel_row array<double>, band int").parquet(path)


def pegasos_alphas(points: DataFrame, iterations: int, reg: float, biased: bool,
                   kernel: str | Kernel, seed: int = SEED) -> tuple[DataFrame, dict[int, int]]:
    """The drawn rows, and ``id -> number of violations`` after the given number of draws.

    The driver holds one number an iteration and one band of the kernel matrix of the
    drawn rows, never the rows.
    """
    require_reg(reg)
    kernel = kernel_named(kernel)
    # One (iteration, id) pair per iteration.
    order = [r["id"] for r in draws(points, iterations, seed).orderBy("iter").collect()]
    distinct = sorted(set(order))
    spark = points.sparkSession
    names = spark.createDataFrame([(i,) for i in distinct], "id long")
    features = append_bias(F.col("features")) if biased else F.col("features")
    # At most one row per iteration, written once: nothing later scans the points.
    drawn = written(
        points.join(short_table(names, len(distinct)), "id")
        .select("id", "label", features.cast("array<double>").alias("features"))
        .repartition(spark.sparkContext.defaultParallelism, "id"),
        "drawn",
    )
    parts = broadcast_parts(drawn)
    by_id = np.argsort(parts.ids, kind="stable")  # the order of a kernel row
    place = {int(i): j for j, i in enumerate(parts.ids[by_id])}
    sign = parts.labels[by_id] * 2.0 - 1.0
    alpha = np.zeros(len(sign))
    block = max(1, GRAM_BYTES // (8 * len(sign)))
    bands = _bands(drawn, order, parts, kernel, block)
    for start in range(0, iterations, block):
        band = bands.where(F.col("band") == start // block).toArrow().combine_chunks()
        rows = band.column("kernel_row").combine_chunks().flatten().to_numpy().reshape(band.num_rows, -1)
        row_of = {i: row for i, row in zip(band.column("id").to_pylist(), rows)}
        for iteration, i in enumerate(order[start: start + block], start + 1):
            own = place[i]
            terms = sign * alpha
            terms[own] = 0.0
            score = sign[own] * (terms @ row_of[i]) / (reg * iteration)
            if score < 1.0:
                alpha[own] += 1.0
    return drawn, {i: int(alpha[j]) for i, j in place.items() if alpha[j] > 0}


def train_kernel_pegasos(points: DataFrame, *, iterations: int = 100, reg: float = 0.01,
                         biased: bool = False, kernel: str | Kernel = "linear",
                         seed: int = SEED) -> KernelModel:
    drawn, alphas = pegasos_alphas(points, iterations, reg, biased, kernel, seed)
    spark = points.sparkSession
    table = spark.createDataFrame(
        [(i, float(a)) for i, a in alphas.items()], "id long, alpha double"
    )
    support = support_vectors(drawn, table, most_rows=len(alphas))
    width = support.agg(F.coalesce(F.max(F.size("features")), F.lit(0))).first()[0]
    size = (len(alphas), width)
    return KernelModel(support, kernel_named(kernel), reg * iterations, biased, size=size)
