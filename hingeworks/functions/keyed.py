"""Random numbers computed from a key and a seed.

The value depends only on ``(key, seed)``: it is the same under any
partitioning and after a lost executor is recomputed. Numbers are made by Spark
expressions alone; the array functions evaluate them for keys that the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

_UNIT = 2.0**-53


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def uniform(key: Column, seed: int | Column) -> Column:
    """Uniform double in [0, 1) for each ``(key, seed)``."""
    h = F.xxhash64(_long(key), _long(seed))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(_UNIT)


def normal(key: Column, seed: int | Column) -> Column:
    """Standard normal double (Box-Muller over two keyed uniforms)."""
    k = _long(key) * F.lit(2).cast("long")
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(k, seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(k + F.lit(1).cast("long"), seed))


def _evaluated(keys, seed, make: Callable[[Column, Column], Column]) -> np.ndarray:
    """The numbers of short arrays of keys and of seeds, made by the active session."""
    keys, seeds = np.broadcast_arrays(np.atleast_1d(np.asarray(keys, np.int64)), np.asarray(seed, np.int64))
    table = pa.table({"at": np.arange(keys.size), "key": keys.ravel(), "seed": seeds.ravel()})
    made = SparkSession.active().createDataFrame(table).select(
        "at", make(F.col("key"), F.col("seed")).alias("value")).toArrow()
    found = np.empty(keys.size)
    found[made.column("at").to_numpy()] = made.column("value").to_numpy()
    return found.reshape(keys.shape)


def uniform_array(keys, seed) -> np.ndarray:
    return _evaluated(keys, seed, uniform)


def normal_array(keys, seed) -> np.ndarray:
    return _evaluated(keys, seed, normal)
