"""Token totals kept by signed deltas (operator 7).

A store is a Parquet folder partitioned by ``batch_id``. ``commit`` turns a batch
of changes into signed rows, adds them up by source, language and tokenizer
version, and replaces that batch's partition only: committing a batch again, or
after a failure half way, gives the same store. ``totals`` adds the batches up.

Changes have ``op`` (``insert``, ``delete`` or ``revise``), ``source``, ``lang``,
``tokenizer``, ``n_tokens`` and, for ``revise``, the same four as they were before
in ``old_source`` and so on. Null sources and languages are groups of their own.
A null count is 0 tokens. An unknown ``op`` is an error. Deletes may come before
their inserts: totals are sums. Groups whose documents and tokens add up to 0
are left out. A batch without changes is a batch of its own and replaces an earlier
one of its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hingeworks.llm.encoder import encoder
from hingeworks.llm.token_files import texts_of

KEYS = ("source", "lang", "tokenizer")
CHANGES = ("op string, source string, lang string, tokenizer string, n_tokens long, "
           "old_source string, old_lang string, old_tokenizer string, old_n_tokens long")
STORE = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch_id long"


def _signed(sign: int, prefix: str = "") -> Column:
    return F.struct(
        *(F.col(prefix + key).alias(key) for key in KEYS),
        F.lit(sign).cast("long").alias("n_docs"),
        (F.lit(sign) * F.coalesce(F.col(f"{prefix}n_tokens"), F.lit(0))).cast("long").alias("n_tokens"),
    )


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of one batch, one row per group."""
    op = F.col("op")
    rows = (
        F.when(op == "insert", F.array(_signed(1)))
        .when(op == "delete", F.array(_signed(-1)))
        .when(op == "revise", F.array(_signed(-1, "old_"), _signed(1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))))
    )
    signed = changes.select(F.inline(rows))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def commit(changes: DataFrame, store: str, batch_id: int) -> None:
    # A row of zeros marks the batch, so that one without changes replaces what it had before.
    mark = changes.sparkSession.range(1).select(
        *(F.lit(None).cast("string").alias(k) for k in KEYS), *(F.lit(0).cast("long").alias(n) for n in ("n_docs", "n_tokens")))
    (deltas(changes).unionByName(mark).withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(store))


def totals(spark: SparkSession, store: str) -> DataFrame:
    kept = spark.read.schema(STORE).parquet(store)
    summed = kept.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs != 0 or n_tokens != 0")


def _count_rows(tokenizers: list[tuple[str, str, bool]]):
    def run(batches):
        for batch in batches:
            for first, last, texts in texts_of(batch.column("text")):
                own = batch.select(["doc_id", "source", "lang"]).slice(first, last - first)
                for name, path, byte_level in tokenizers:
                    counts = np.diff(encoder(path, byte_level).encode(texts).offsets)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array([name] * len(texts)), pa.array(counts)],
                        names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizers: list[tuple[str, str, bool]]) -> DataFrame:
    """Per document and tokenizer ``(name, file, byte_level)`` its number of ids; null text: 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _count_rows(tokenizers), "doc_id long, source string, lang string, tokenizer string, n_tokens long")
