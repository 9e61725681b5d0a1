import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    def make(rows, partitions=1):
        table = [(int(i), float(y), [float(v) for v in x]) for i, y, x in rows]
        frame = spark.createDataFrame(table, "id long, label double, features array<double>")
        return frame.repartition(partitions, "id")

    return make


@pytest.fixture(scope="session")
def blob():
    """Two overlapping classes: ids, labels, matrix."""
    rng = np.random.default_rng(3)
    labels = (rng.random(200) < 0.5).astype(float)
    cells = rng.normal(size=(200, 5)) + (labels * 2 - 1)[:, None] * 0.4
    return np.arange(200) * 3 + 1, labels, cells


@pytest.fixture(scope="session")
def blob_points(make_points, blob):
    return make_points(zip(*blob), 4)
