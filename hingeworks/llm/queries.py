"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hingeworks.llm import (
    backoff_lm, chunk_bpe, imatch, lexical_search, middle, near_dup, packing, quality, rollups, secrets, token_files,
    toxicity, url_filter,
)
from hingeworks.llm.oracles import ORACLES
from hingeworks.llm.text import id_remainder
from hingeworks.llm.tables import fresh_path, table, written

QUERIES = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = chunk_bpe.encode(table(spark, folder, "documents"), BYTE_BPE)
    decoded = F.sha2(F.encode(chunk_bpe.decoder(BYTE_BPE)(F.col("ids")), "UTF-8"), 256)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        chunk_bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), decoded.alias("decoded_sha256"))


@query
def op6_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_BPE, end_id=1)


@query
def op7_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after every document was inserted, its count revised and exact copies deleted.

    The first batch inserts all documents under two tokenizers. The second revises
    every count to include the end id, and is committed twice, as after a lost
    acknowledgement. The third deletes all but the smallest id of equal texts.
    """
    docs = table(spark, folder, "documents")
    counts = written(rollups.token_counts(docs, [
        ("byte_bpe_50k", BYTE_BPE, True), ("word_bpe_49k", WORD_BPE, False)]), "counts")
    keys = ("source", "lang", "tokenizer")
    none = [F.lit(None).cast("string").alias(f"old_{k}") for k in keys]
    no_count = F.lit(None).cast("long").alias("old_n_tokens")
    inserts = counts.select(F.lit("insert").alias("op"), *keys, "n_tokens", *none, no_count)
    ended = (F.col("n_tokens") + 1).alias("n_tokens")
    revised = counts.select(F.lit("revise").alias("op"), *keys, ended,
                            *(F.col(k).alias(f"old_{k}") for k in keys),
                            F.col("n_tokens").alias("old_n_tokens"))
    firsts = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min("doc_id").alias("doc_id"))
    copies = counts.join(firsts.select("doc_id"), "doc_id", "left_anti")
    deletes = copies.select(F.lit("delete").alias("op"), *keys, ended, *none, no_count)
    store = fresh_path(spark, "rollup")
    for batch, changes in ((1, inserts), (2, revised), (2, revised), (3, deletes)):
        rollups.commit(changes, store, batch)
    return rollups.totals(spark, store)


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), path, WORD_BPE, end_id=2)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", F.size("ids").cast("long").alias("n_tokens"),
        token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", secrets.find_secrets(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "entropy")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"), count("entropy"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality.learn(docs, table(spark, folder, "labels"))
    judged = quality.with_verdict(docs.select("doc_id", "text"), rules, "judged")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"judged.{name}") for name in shown))


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query
def op4_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, folder, "documents"))


@query
def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return imatch.compare_with_edits(docs, imatch.lexicon(docs))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity.toxicity(model, F.col("text")).alias("score"))
    return scored.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_shared_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The rules of the query, as host, path and verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Five rules, and a list of the canonical URLs that pages have under several addresses."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    address = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    listed = pages.groupBy(address.alias("address")).agg(F.min("url").alias("low"), F.max("url").alias("high")).where(
        "low != high and address != ''").select("address")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    stored = written(docs.select("doc_id", middle.store(F.col("text")).alias("stored")), "frames")
    filled = stored.select("doc_id", middle.fill_in_middle(F.col("stored"), F.col("doc_id")).alias("filled"))
    text = middle.restored(F.col("filled.output"), F.col("filled.form"))
    return filled.select(
        "doc_id", "filled.n", "filled.form", "filled.prefix_chars", "filled.middle_chars", "filled.output_sha256",
        F.sha2(text, 256).alias("restored_sha256"))
