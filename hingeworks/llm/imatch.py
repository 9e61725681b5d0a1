"""I-Match fingerprints over a band of inverse document frequency (operator 9).

The lexicon holds the terms (letter runs, A-Z in lower case) whose share of
documents lies in a band. A term in at least a thousandth of the documents is one of
at most a thousand times as many as a document has on average, whatever the
number of documents; the lexicon goes to the tasks in sorted pieces of at most
``PIECE_TERMS`` terms, so a large one is looked up piece by piece.

A fingerprint has one 64-bit hash of the document's distinct terms in the whole
lexicon, in sorted order, and one for each randomised subset of it: ``FAMILIES``
subsets at each rate 1/2 ... 1/2**RATES. All terms that a subset keeps are hashed;
16 dashes stand for none. A hash is that of another document only if no term of its
subset differs, so low rates stand changes that high rates do not. The likeness of two
fingerprints is the share of equal hashes among the subsets that keep a term of either.
Texts of very many terms lose all hashes by a change of a third.

Defined results: a document with fewer than ``LEAST_TERMS`` terms of the band uses
all its terms. A null or empty text has no terms; two such fingerprints are
equal, likeness 1. Equal texts have equal fingerprints. Rows are ordered by
descending id, nulls last, equal ids by the hash of the text. A single row is
its own successor. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.text import LETTER_BYTES, Segment, mix, segments, words

LOWEST_SHARE, HIGHEST_SHARE = 0.001, 0.2
PIECE_TERMS = 8 << 20
LEAST_TERMS = 4
FAMILIES, RATES = 3, 8
SUBSETS = 1 + FAMILIES * RATES
COUNT_BYTES = 8 << 20
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000
EMPTY = np.uint64(0)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def distinct_terms(segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each document, sorted, and their document numbers."""
    found = words(segment, LETTER_BYTES)
    order = np.lexsort((found.hashes, found.documents))
    hashes, owners = found.hashes[order], found.documents[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], owners[fresh]


def _document_counts(size: int):
    """Terms and their document counts, for every ``size`` bytes of text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = 0

        def rows() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for _, _, segment in segments(batch.column("text")):
                held.append(distinct_terms(segment)[0])
                seen += len(segment.data)
                if seen > size:
                    yield rows()
                    held, seen = [], 0
        if held:
            yield rows()

    return run


def band(docs: DataFrame, lowest: float = LOWEST_SHARE, highest: float = HIGHEST_SHARE) -> DataFrame:
    """``(term)``: hashes of the terms in the band; counts cover all documents."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    documents = texts.count()
    counted = texts.mapInArrow(_document_counts(COUNT_BYTES), "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n"))
    return counted.where(F.col("n").between(max(lowest * documents, 1.0), highest * documents)).select("term")


Lexicon = list[Broadcast]


def lexicon(docs: DataFrame, lowest: float = LOWEST_SHARE, highest: float = HIGHEST_SHARE) -> Lexicon:
    """The band's terms in sorted pieces; the driver holds one piece at a time."""
    pieces, held = [], []

    def hand_over():
        terms = np.sort(np.array(held, np.int64).view(np.uint64))
        pieces.append(docs.sparkSession.sparkContext.broadcast(terms))
        held.clear()

    for row in band(docs, lowest, highest).toLocalIterator():
        held.append(row["term"])
        if len(held) >= PIECE_TERMS:
            hand_over()
    hand_over()
    return pieces


def in_lexicon(hashes: np.ndarray, pieces: list) -> np.ndarray:
    inside = np.zeros(len(hashes), bool)
    for piece in pieces:
        terms = piece.value
        if len(terms):
            places = np.searchsorted(terms, hashes)
            places[places == len(terms)] = 0
            inside |= terms[places] == hashes
        if len(pieces) > 1:
            vars(piece).pop("_value", None)  # a worker keeps what it has read of a broadcast
    return inside


def in_subset(hashes: np.ndarray, subset: int) -> np.ndarray:
    """Which terms a randomised subset of the lexicon keeps; subset 0 is all of it."""
    if subset == 0:
        return np.ones(len(hashes), bool)
    rate = 1 + (subset - 1) % RATES
    return mix(hashes ^ mix(np.array([subset], np.uint64))) < np.uint64(1 << (64 - rate))


def parts(segment: Segment, pieces: list) -> np.ndarray:
    """One row per document: the hash of its sorted terms in each subset, or EMPTY."""
    hashes, owners = distinct_terms(segment)
    inside = in_lexicon(hashes, pieces)
    few = np.bincount(owners[inside], minlength=segment.documents) < LEAST_TERMS
    kept = inside | few[owners]
    hashes, owners = hashes[kept], owners[kept]
    out = np.full((segment.documents, SUBSETS), EMPTY)
    for subset in range(SUBSETS):
        chosen = in_subset(hashes, subset)
        terms, own = hashes[chosen], owners[chosen]
        if len(own) == 0:
            continue
        firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(firsts, len(own)))
        place = np.arange(len(own)) - np.repeat(firsts, counts)  # in the document's sorted terms
        sums = mix(np.add.reduceat(mix(terms ^ mix(place.astype(np.uint64) + np.uint64(1))), firsts))
        out[own[firsts], subset] = np.maximum(sums, np.uint64(1))
    return out


def fingerprints(texts: list[str], pieces: list) -> np.ndarray:
    found = [parts(segment, pieces) for _, _, segment in segments(pa.array(texts, pa.string()))]
    return np.concatenate(found) if found else np.zeros((0, SUBSETS), np.uint64)


def as_strings(matrix: np.ndarray) -> list[str]:
    return [":".join(f"{n:016x}" if n else "-" * 16 for n in row) for row in matrix.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of equal hashes among the subsets that keep a term on either side."""
    either = (a != EMPTY) | (b != EMPTY)
    total = either.sum(axis=1)
    return np.where(total > 0, (either & (a == b)).sum(axis=1) / np.maximum(total, 1), 1.0)


def _compare(pieces: Lexicon):
    """Rows come by bucket and descending id; a bucket ends with a guest, its last row's successor."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its values and its fingerprint
        for batch in batches:
            ids, guests = batch.column("doc_id").to_pylist(), batch.column("guest").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            matrix = fingerprints(texts, pieces)
            if held:
                ids, guests, texts = [held[0], *ids], [held[1], *guests], [held[2], *texts]
                matrix = np.concatenate([held[3], matrix])
            own = [i for i in range(len(ids) - 1) if not guests[i]]
            if own:
                edited = []
                for i in own:
                    gone = len(texts[i]) // 3
                    edited.append(texts[i][: len(texts[i]) - gone] + texts[i + 1][:gone])
                changed = fingerprints(edited, pieces)
                rows = np.array(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(as_strings(matrix[rows])), pa.array(as_strings(changed)),
                    pa.array(likeness(matrix[rows], changed)),
                    pa.array(likeness(matrix[rows], matrix[rows + 1])),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                          "near_edited", "near_next"])
            held = (ids[-1], guests[-1], texts[-1], matrix[-1:])

    return run


def compare_with_edits(docs: DataFrame, terms: Lexicon) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness.

    The edited text has its last third replaced by the beginning of the next row's
    text. Rows are dealt by ranges of the id; the first row of each range also
    goes to the range before it as a guest, so no range needs another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # By bytes; a range's rows stream through its task, however many they are.
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)))
    bounds = np.unique(np.array(rows.select("doc_id").approxQuantile(
        "doc_id", [n / ranges for n in range(1, ranges)], 0.2 / ranges) if ranges > 1 else [], float))

    def number(column: pa.Array) -> pa.Array:  # 0 has the largest ids
        values = column.to_numpy(zero_copy_only=False)
        places = np.searchsorted(-bounds[::-1], -values.astype(float), side="right")
        return pa.array(np.where(np.isnan(values.astype(float)), len(bounds), places).astype(np.int64))

    dealt = rows.withColumn("bucket", F.arrow_udf(number, "long")(F.col("doc_id"))).withColumn(
        "tie", F.xxhash64("text"))
    # One row per range.
    heads = dealt.groupBy("bucket").agg(F.max(F.struct(
        F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head")).collect()
    heads.sort(key=lambda r: r["bucket"])
    places = [(r["head"]["doc_id"], r["head"]["tie"], heads[n - 1]["bucket"]) for n, r in enumerate(heads)]
    targets = spark.createDataFrame(places, "head_id long, head_tie long, target long")
    guests = dealt.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head_id"))
                        & (F.col("tie") == F.col("head_tie")))
    both = dealt.select("doc_id", "text", "tie", "bucket", F.lit(False).alias("guest")).union(
        guests.select("doc_id", "text", "tie", F.col("target").alias("bucket"), F.lit(True).alias("guest")))
    ordered = both.repartitionByRange(len(heads) or 1, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return ordered.select("doc_id", "text", "guest").mapInArrow(_compare(terms), RESULT)
