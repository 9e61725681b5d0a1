"""Inputs of the registered queries: points tables derived from the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hingeworks.functions.vectors import dot, literal_vector

WIDTH = 64
REG = 0.01
REFERENCE_WEIGHTS = [math.sin(j) for j in range(1, WIDTH + 1)]
REFERENCE_INTERCEPT = 0.25
LINEITEM_WEIGHTS = [0.02, -0.00001, 3.0, -2.0]
LINEITEM_INTERCEPT = 0.1
ALPHA_DRAWS = 200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def projection(axes: int) -> list[list[float]]:
    """Weights of a fixed map of all dimensions to ``axes``: dimension j goes to axis j % axes."""
    return [[w if j % axes == a else 0.0 for j, w in enumerate(REFERENCE_WEIGHTS)] for a in range(axes)]


def narrow_points(spark: SparkSession, folder: str, axes: int) -> DataFrame:
    """Embedding points, all dimensions mapped to ``axes``."""
    points = embedding_points(spark, folder)
    mapped = F.array(*[dot(F.col("features"), literal_vector(w)) for w in projection(axes)])
    return points.withColumn("features", mapped)


def lineitem_points(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric columns of every line item.

    Order key and line number repeat, so the id also has the row's place among
    its repeats, in the order of the numbers that make the point.
    """
    cells = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    repeat = F.row_number().over(
        Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*cells, "l_returnflag"))
    key = (F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 4096 + repeat
    return table(spark, folder, "lineitem").select(
        key.cast("long").alias("id"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("label"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
    )


def order_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
