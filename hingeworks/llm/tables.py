"""Reading the document tables and keeping written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hingeworks.sources.scratch import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(frame: DataFrame, name: str, **options) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: its lineage ends here."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.options(**{"compression": "zstd", **options}).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
