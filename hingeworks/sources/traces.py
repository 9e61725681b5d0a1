"""Training traces and sweep results as text files.

A trace file holds the whole seconds, a line ``###``, then ``ms loss`` per
iteration, and is named ``dimension#value#trainer.txt``. A sweep file holds
sections ``# dimension<TAB>time`` of rows ``value<TAB>seconds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Separator line, warm-up iterations left out of comparisons.
SEPARATOR = "###"
WARM_UP = 30

_NAME = r"([^/#]+)#([^/#]+)#([^/#]+?)\.txt"


def trace_name(dimension: str, value, trainer: str) -> str:
    return f"{dimension}#{value}#{trainer}.txt"


def write_trace(trace: DataFrame, path: str, seconds: int, mode: str = "errorifexists") -> None:
    """One file; a trace has one short row per iteration."""
    lines = trace.select(
        F.col("iter").alias("n"), F.concat_ws(" ", "elapsed_ms", "loss").alias("value")
    )
    head = trace.sparkSession.createDataFrame(
        [(-1, str(int(seconds))), (0, SEPARATOR)], "n int, value string"
    )
    head.union(lines).coalesce(1).sortWithinPartitions("n").select("value").write.mode(mode).text(
        path
    )


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # '#' arrives percent-encoded in the file path.
    name = F.regexp_replace(F.input_file_name(), "%23", "#")
    return spark.read.text(path, wholetext=True).select(name.alias("file"), "value")


def _words(line: Column) -> Column:
    return F.split(F.trim(F.translate(line, "\t\r", "  ")), " +")


def read_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(dimension, setting, trainer, iter, elapsed_ms, loss)`` of all trace files.

    Lines that start with '#' or have fewer than two words are skipped.
    """
    lines = F.filter(
        F.split("value", "\n"),
        lambda s: ~s.startswith("#") & (F.size(_words(s)) >= 2),
    )
    rows = _whole_files(spark, path).select("file", F.posexplode(lines).alias("n", "line"))
    words = _words(F.col("line"))
    return rows.select(
        *[
            F.regexp_extract("file", _NAME, g).alias(name)
            for g, name in enumerate(("dimension", "setting", "trainer"), 1)
        ],
        (F.col("n") + 1).alias("iter"),
        words[0].cast("long").alias("elapsed_ms"),
        words[1].cast("double").alias("loss"),
    )


def trace_tail(traces: DataFrame, skip: int = WARM_UP) -> DataFrame:
    return traces.where(F.col("iter") > skip)


def trace_summary(traces: DataFrame) -> DataFrame:
    """One row per (dimension, trainer, setting): iterations, last and least loss, time."""
    return traces.groupBy("dimension", "trainer", "setting").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.max_by("loss", "iter").alias("last_loss"),
        F.min("loss").alias("least_loss"),
        F.max("elapsed_ms").alias("total_ms"),
    )


def write_sweep(timed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sections of ``(dimension, value, seconds)``; one short row per setting."""
    rows = timed.select(
        "dimension", F.col("value").alias("v"),
        F.concat_ws("\t", "value", F.col("seconds").cast("long")).alias("value"),
    )
    heads = timed.select("dimension").distinct().select(
        "dimension", F.lit(None).cast("double").alias("v"),
        F.concat(F.lit("# "), "dimension", F.lit("\ttime")).alias("value"),
    )
    lines = heads.union(rows).coalesce(1).sortWithinPartitions("dimension", F.asc_nulls_first("v"))
    lines.select("value").write.mode(mode).text(path)


def read_sweep(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(dimension, value, seconds)`` of sweep files; ``##`` lines are ignored."""
    sections = F.filter(
        F.split("value", r"(?m)^#(?!#)"), lambda s: F.length(F.trim(s)) > 0
    )
    named = _whole_files(spark, path).select(F.explode(sections).alias("section"))
    lines = F.split("section", "\n")
    rows = named.select(
        _words(lines[0])[0].alias("dimension"),
        F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"),
    ).where(~F.col("line").startswith("#") & (F.size(_words(F.col("line"))) >= 2))
    words = _words(F.col("line"))
    return rows.select(
        "dimension", words[0].cast("double").alias("value"), words[1].cast("double").alias("seconds")
    )
