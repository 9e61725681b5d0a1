"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.text import id_remainder


def training_labels(labels: DataFrame, label: str, training: bool = True) -> DataFrame:
    """``(doc_id, label)`` of the labelled ids, without those whose crc32 remainder is 0 if ``training``.

    Null ids and labels are left out; of an id with several labels the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col(label).cast("int").alias("label")).dropna()
    if training:
        known = known.where(id_remainder(F.col("doc_id")) != 0)
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def sampled(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of the first ``rows`` ids of ``known`` in the order of their hash."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    # At most ``rows`` pairs of numbers.
    return texts.join(F.broadcast(chosen), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    training: bool = False) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled documents, the same under any partitioning."""
    return sampled(docs, training_labels(labels, label, training), rows)
