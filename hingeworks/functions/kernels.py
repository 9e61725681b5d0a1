"""Kernels, each as a Column expression and as a matrix-block function.

``column(a, b)`` compares two array columns row by row. ``block(X, A)`` gives
the ``len(X) x len(A)`` kernel matrix inside a vectorised task. A kernel of
your own is another ``Kernel`` value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from hingeworks.functions.vectors import dot, squared_distance


# Gaussian blocks: rounding of a squared distance that is let pass, the squared
# distance from which the kernel is 0 to all digits that matter, and how many
# differences are held at a time.
EXACT, FAR, PAIR_CELLS = 1e-11, 100.0, 1 << 20


@dataclass(frozen=True)
class Kernel:
    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _gaussian_block(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    # The expanded square is fast but rounds by about this share of the squares.
    squares = (x * x).sum(axis=1)[:, None] + (anchors * anchors).sum(axis=1)[None, :]
    gap = squares - 2.0 * (x @ anchors.T)
    np.maximum(gap, 0.0, out=gap)
    rounding = squares * (4.0 * (x.shape[1] + 4) * np.finfo(float).eps)
    # Pairs near enough to count are subtracted first where that could be seen.
    row, column = np.nonzero((rounding > EXACT) & (gap - rounding < FAR))
    step = max(1, PAIR_CELLS // max(1, x.shape[1]))
    for first in range(0, len(row), step):
        r, c = row[first: first + step], column[first: first + step]
        gap[r, c] = ((x[r] - anchors[c]) ** 2).sum(axis=1)
    return np.exp(-0.5 * gap)


LINEAR = Kernel("linear", dot, lambda x, anchors: x @ anchors.T)
GAUSSIAN = Kernel(
    "gaussian", lambda a, b: F.exp(F.lit(-0.5) * squared_distance(a, b)), _gaussian_block
)
POLYNOMIAL = Kernel(
    "polynomial",
    lambda a, b: F.pow(dot(a, b) + F.lit(1.0), F.lit(2.0)),
    lambda x, anchors: (x @ anchors.T + 1.0) ** 2,
)

_BY_NAME = {k.name: k for k in (LINEAR, GAUSSIAN, POLYNOMIAL)}


def kernel_named(kernel: str | Kernel) -> Kernel:
    if isinstance(kernel, Kernel):
        return kernel
    try:
        return _BY_NAME[kernel]
    except KeyError:
        raise ValueError(f"unknown kernel {kernel!r}; known: {sorted(_BY_NAME)}") from None
