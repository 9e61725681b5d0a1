"""Labelled test data with known shape, keyed by row number.

Row ``k`` of seed ``s`` is the same wherever and whenever it is made. Use
``ordinals(spark, n)`` for a new table, or any ``(idx)`` column of yours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hingeworks.functions.keyed import normal, uniform


def ordinals(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, rows, 1, partitions).withColumnRenamed("id", "idx")


def gaussian_classes(indices: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Alternating classes, 1.0 ~ N(+1, 1) and 0.0 ~ N(-1, 1), in ``width`` dimensions."""
    idx = F.col("idx").cast("long")
    label = F.lit(1.0) - F.pmod(idx, F.lit(2))
    axes = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    cells = F.transform(axes, lambda axis: normal(idx * width + axis, seed) + (label * 2.0 - 1.0))
    return indices.select(idx.alias("id"), label.cast("double").alias("label"), cells.alias("features"))


class _Draw:
    """Numbered random streams of the row in column ``idx``."""

    def __init__(self, seed: int):
        self.key, self.seed = F.col("idx").cast("long"), seed * 16

    def normal(self, stream: int) -> Column:
        return normal(self.key, self.seed + stream)

    def uniform(self, stream: int) -> Column:
        return uniform(self.key, self.seed + stream)


def _part(rows: int, parts: int) -> Column:
    """Which of ``parts`` equal parts of the rows a row is in; every row is in one."""
    return F.floor(F.col("idx") * parts / F.lit(max(1, rows)))


def _linear(d: _Draw, rows: int, sigma: Column, axes: int):
    first = _part(rows, 2) == 0
    shift = F.when(first, 1.0).otherwise(-1.0)
    return first, [sigma * d.normal(a) + shift for a in range(axes)]


def _circle(d: _Draw, rows: int, sigma: Column):
    # The ring's radii, 1 to 1.5.
    first = _part(rows, 2) == 0
    radius, angle = d.uniform(2) * 0.5 + 1.0, d.normal(3) * (2.0 * math.pi)
    ring = [F.cos(angle) * radius, F.sin(angle) * radius]
    ball = [sigma * d.normal(a) for a in range(2)]
    return first, [F.when(first, b).otherwise(r) for b, r in zip(ball, ring)]


def _mixture(d: _Draw, rows: int, sigma: Column):
    # The three centres; the middle one is class 0.
    centres = [(0.3, 0.5), (-0.3, -0.5), (-1.0, -1.0)]
    part = _part(rows, 3)
    axes = []
    for a in range(2):
        centre = F.when(part == 0, centres[0][a]).when(part == 1, centres[1][a])
        axes.append(sigma * d.normal(a) + centre.otherwise(centres[2][a]))
    return part != 1, axes


def _checkers(d: _Draw, rows: int, sigma: Column):
    # A board of 4 by 4 unit cells around the origin.
    cell = _part(rows, 16)
    row, column = F.floor(cell / 4), cell % 4
    odd = (row + column) % 2 == 1
    return odd, [row - 2 + d.uniform(0), column - 2 + d.uniform(1)]


def _clowns(d: _Draw, rows: int, sigma: Column):
    # The parabola's range, -3 to 3, and the other class's shift of 6.
    first = _part(rows, 2) == 0
    x = d.uniform(2) * 6.0 - 3.0
    smile = [x, x * x + d.normal(3)]
    blob = [sigma * d.normal(0), sigma * d.normal(1) + 6.0]
    return first, [F.when(first, s).otherwise(b) for s, b in zip(smile, blob)]


def _ball(d: _Draw, rows: int, sigma: Column):
    # The paraboloid's base, -1.5 to 1.5 on both axes. Its grid is
    # square; rows beyond a full square take its first cells again.
    side = max(1, math.isqrt(rows // 2))
    first = _part(rows, 2) == 0
    cell = F.col("idx") - F.lit((rows + 1) // 2)

    def at(step: Column) -> Column:
        return step * (3.0 / max(1, side - 1)) - 1.5

    x, y = at(cell % side), at(F.floor(cell / side) % side)
    bowl = [x, y, F.lit(1.5**2) - x * x - y * y]
    ball = [sigma * d.normal(a) for a in range(3)]
    return first, [F.when(first, b).otherwise(s) for b, s in zip(ball, bowl)]


_SHAPES = {
    ("linear", 2): lambda d, n, s: _linear(d, n, s, 2),
    ("linear", 3): lambda d, n, s: _linear(d, n, s, 3),
    ("circle", 2): _circle,
    ("mixture", 2): _mixture,
    ("checkers", 2): _checkers,
    ("clowns", 2): _clowns,
    ("ball", 3): _ball,
}


def shape(indices: DataFrame, rows: int, name: str, axes: int = 2, sigma: float = 1.0,
          seed: int = 0) -> DataFrame:
    """Points of a named shape for ``idx`` in 0..rows-1.

    Class sizes are equal parts of ``rows``, as equal as whole rows allow; every
    row makes a point.
    """
    try:
        make = _SHAPES[(name.lower(), axes)]
    except KeyError:
        raise ValueError(f"no shape {name!r} in {axes} dimensions; known: {sorted(_SHAPES)}") from None
    positive, cells = make(_Draw(seed), rows, F.lit(float(sigma)))
    points = indices.select(
        F.col("idx").cast("long").alias("id"),
        F.when(positive, 1.0).otherwise(0.0).alias("label"),
        F.array(*[c.cast("double") for c in cells]).alias("features"),
    )
    return _standardised(points) if name.lower() == "clowns" else points


def _standardised(points: DataFrame) -> DataFrame:
    """Centred and divided by the population deviation, two columns."""
    x = [F.col("features")[a] for a in range(2)]
    row = points.agg(*[f(c) for c in x for f in (F.avg, F.stddev_pop)]).first()
    moved = [(c - F.lit(row[2 * a])) / F.lit(row[2 * a + 1]) for a, c in enumerate(x)]
    return points.withColumn("features", F.array(*moved))
