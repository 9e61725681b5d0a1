"""Labelled points as text: ``label f1 f2 ... fd``, separated by single spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: number format of written features.
FEATURE_FORMAT = "%.4f"

# Room for the lines of one file in an id, and the most splits whose table is broadcast.
LINE_BITS = 40
MOST_SPLITS = 4_000_000


def _line_shifts(lines: DataFrame) -> DataFrame:
    """``(key, shift)`` of each split: what makes a row's number in the scan its number of the file.

    The driver gets three numbers a split. Lines are numbered through their file, and
    files in the order of their names.
    """
    splits = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")).select(
            "file", "block", "first", "rows", _split_key().alias("key")).collect()
    shifts, rank, before, last = [], -1, 0, None
    for split in sorted(splits, key=lambda s: (s["file"], s["block"])):
        if split["file"] != last:
            rank, before, last = rank + 1, 0, split["file"]
        shifts.append((split["key"], (rank << LINE_BITS) + before - split["first"]))
        before += split["rows"]
    if len({key for key, _ in shifts}) < len(shifts):
        raise ValueError("two splits have one key")
    table = lines.sparkSession.createDataFrame(shifts, "key long, shift long")
    # Two numbers a split of the input.
    return F.broadcast(table) if len(shifts) <= MOST_SPLITS else table


def _split_key() -> Column:
    return F.xxhash64("file", "block")


def read_labeled_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points from files, folders or globs.

    A token that is no number fails the job. ``id`` is the line's number, from 0, in its
    file plus ``2**40`` for each file whose name comes before: unique, and the same however
    the files are split. A first pass counts the lines of each split; no line is shuffled.
    Files that change, or are split otherwise, between the two passes fail the job.
    """
    tokens = F.split(F.rtrim("value"), " ")
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    checked = F.when(
        F.exists(numbers, lambda v: v.isNull()),
        F.raise_error(F.concat(F.lit("not a labelled point: "), F.col("value"))),
    ).otherwise(numbers)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    shift = F.coalesce("shift", F.raise_error(F.lit("the files were split otherwise when their lines were counted")))
    return (
        lines.withColumn("key", _split_key())
        .join(_line_shifts(lines), "key", "left")
        .select((F.col("at") + shift.cast("long")).alias("id"), checked.alias("numbers"))
        .select(
            "id",
            F.col("numbers")[0].alias("label"),
            F.slice("numbers", F.lit(2), F.size("numbers") - 1).alias("features"),
        )
    )


def write_labeled_text(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    features = F.transform("features", lambda x: F.format_string(FEATURE_FORMAT, x))
    points.select(
        F.concat_ws(" ", F.col("label").cast("double").cast("string"), features)
    ).write.mode(mode).text(path)


def write_support(support: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Support vectors as ``y f1 ... fd``, y being -1.0 or 1.0, at full precision."""
    support.select(
        F.concat_ws(" ", F.col("y").cast("double").cast("string"),
                    F.col("features").cast("array<string>"))
    ).write.mode(mode).text(path)


def write_surface(surface: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Triples ``x y z`` with six decimals."""
    surface.select(F.format_string("%f %f %f", "x", "y", "z")).write.mode(mode).text(path)
