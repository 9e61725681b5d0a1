"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` are ``(name, function)`` pairs; a function takes ``(spark, docs, sf_dir)``.
All but the last return the columns of their input. Null and repeated rows,
empty tables and extra columns go through as their operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hingeworks.llm import near_dup, packing, quality, secrets, toxicity
from hingeworks.llm.queries import WORD_BPE
from hingeworks.llm.tables import table, written

# Shingle sets from this similarity on are near copies.
NEAR_PERCENT = 80


def _own_column() -> str:
    """A name that no column of the input has."""
    return f"own_{uuid.uuid4().hex}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    name = _own_column()
    scored = docs.withColumn(name, toxicity.toxicity(model, F.col("text").cast("string")))
    return scored.where(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = _own_column()
    judged = quality.with_verdict(docs, rules, name)
    return judged.where(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, from 0.8 similarity.

    Of several rows with that id one stays, that with the smallest text (nulls last); of
    equal texts the smallest hash of the row decides. Rows with a null id stay.
    """
    found = near_dup.near_duplicates(docs, percent=NEAR_PERCENT)
    name = _own_column()
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    known = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(name), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("text").isNull(), F.col("text").cast("string"), F.xxhash64(
        *(F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns)))
    first = known.groupBy(F.col("doc_id").alias(name)).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return first.select("row.*").unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret's span replaced by a mark; ``n_chars`` follows."""
    name = _own_column()
    text = F.col("text").cast("string")
    clean = docs.withColumn(name, secrets.find_secrets(text)).withColumn(
        "text", secrets.redacted(text, F.col(name)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.size(name) > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(
            F.col("n_chars")).cast(kind))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and place in it."""
    return packing.pack(docs, WORD_BPE, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", keep_one_of_near_copies),
    ("secret scan", redact_secrets),
    ("vector packing", pack_sequences),
]
# Learned models, hashes and tokenizer files are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
