"""The shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors can reach.

    Where it is unset and Spark is local, a folder of this run in the warehouse,
    removed when the process ends.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {_SETTING} to a folder all executors can reach")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    folder = os.path.join(warehouse, f"scratch-{spark.sparkContext.applicationId}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: its lineage ends here."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
