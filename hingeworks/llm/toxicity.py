"""Toxicity from class-conditional Kneser-Ney models (operator 2).

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, spell
words byte by byte with up to ``ORDER - 1`` bytes of history inside the word, so
they also know expressions by their stems. The highest order has counts, lower
orders count the distinct bytes before an n-gram; orders up to ``SHARED_ORDERS``
are counted over both classes together, so rare expressions back off to shared
counts. The difference of the log-likelihoods per byte, and per square root of
the bytes, go through a logistic function. It is fitted on differences of labelled
texts by models that have not counted them (``FOLDS`` parts, each measured by the
others), weighted to the labels' own proportions; the final models count all parts.

Fitted on at most ``SAMPLE_ROWS`` labelled rows of each class. N-grams are counted on the executors; the driver gets their sums, of
which there are as many as distinct runs of ORDER bytes inside words.

Defined results: null and empty texts and texts without letters have difference 0.
Equal texts have equal scores. Without rows of both classes every score is 0.
Other columns are ignored. Texts of any length are scored whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hingeworks.llm.hash_table import HashTable
from hingeworks.llm.samples import sampled, training_labels
from hingeworks.llm.text import LETTER_BYTES, LOWER, heavy_state, segments, sums_by_document, words

SAMPLE_ROWS = 6_000
ORDER, SHARED_ORDERS = 5, 2
DISCOUNT = 0.75
OPEN, CLOSE = 1, 2  # bytes that stand for a word's borders
FOLDS = 4
SLOTS, MOST_WORDS = 1 << 20, 1 << 19
NGRAMS = "length int, gram long, label int, fold int, n long"


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as bytes between border bytes, and each byte's place in its word."""
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    out = np.empty(len(place), np.int64)
    inside = (place > 0) & (place < np.repeat(lengths, lengths) - 1)
    source = np.repeat(starts - 1, lengths) + place
    out[inside] = LOWER[data[source[inside]]]
    out[first] = OPEN
    out[first + lengths - 1] = CLOSE
    return out, place


def grams(symbols: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``length - 1`` bytes before them in the word, and the packed run."""
    at = np.flatnonzero(place >= length - 1)
    packed = np.zeros(len(at), np.int64)
    for back in range(length - 1, -1, -1):
        packed = (packed << 8) | symbols[at - back]
    return at, packed


def _count_grams(order: int):
    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False) + 2 * batch.column(
                "fold").to_numpy(zero_copy_only=False)
            for first, last, segment in segments(batch.column("text")):
                found = words(segment, LETTER_BYTES)
                for label in np.unique(labels[first:last]).tolist():
                    mine = labels[first:last][found.documents] == label
                    symbols, place = spelled(segment.data, found.starts[mine], found.ends[mine])
                    for length in range(2, order + 1):
                        at, packed = grams(symbols, place, length)
                        if length < order:  # a shorter run counts where the word begins
                            packed = packed[place[at] == length - 1]
                        distinct, times = np.unique(packed, return_counts=True)
                        size = len(distinct)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(size, length, np.int32)), pa.array(distinct),
                            pa.array(np.full(size, label % 2, np.int32)), pa.array(np.full(size, label // 2, np.int32)),
                            pa.array(times.astype(np.int64)),
                        ], names=["length", "gram", "label", "fold", "n"])

    return run


@dataclass
class Level:
    """N-grams of one length with the counts of both classes, and sums by history."""

    grams: np.ndarray
    counts: np.ndarray  # two rows
    histories: np.ndarray
    totals: np.ndarray
    types: np.ndarray


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(inverse, row, len(distinct)) for row in values])


def kneser_ney_levels(counted: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER,
                      shared: int = SHARED_ORDERS) -> list[Level]:
    """Levels 1 to ``order`` from the counts of the longest run at every position."""
    levels, keys, counts = [], *counted[order]
    for length in range(order, 0, -1):
        if length < order:
            # Distinct bytes before each run, and counts of runs that begin a word.
            keys, counts = keys & ((1 << 8 * length) - 1), (counts > 0).astype(float)
            if length in counted:
                keys = np.concatenate([keys, counted[length][0]])
                counts = np.concatenate([counts, counted[length][1]], axis=1)
            keys, counts = _summed(keys, counts)
        used = np.stack([counts.sum(axis=0)] * 2) if length <= shared else counts
        histories, totals = _summed(keys >> 8, used)
        _, types = _summed(keys >> 8, (used > 0).astype(float))
        order_of = np.argsort(keys)
        keys, used = keys[order_of], used[:, order_of]
        levels.append(Level(keys, used, histories, totals, types))
        counts = counts[:, order_of]
    return levels[::-1]


def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if len(keys) == 0:
        return np.zeros((2, len(wanted)))
    places = np.searchsorted(keys, wanted)
    places[places == len(keys)] = 0
    return np.where(keys[places] == wanted, values[:, places], 0.0)


def log_ratios(levels: list[Level], symbols: np.ndarray, place: np.ndarray,
               discount: float = DISCOUNT) -> np.ndarray:
    """log toxic - log ordinary probability of every byte after its history (0 for borders that open)."""
    chance = np.full((2, len(symbols)), 1 / 256)
    for length, level in enumerate(levels, 1):
        at, packed = grams(symbols, place, length)
        counts = _at(level.grams, packed, level.counts)
        totals = _at(level.histories, packed >> 8, level.totals)
        types = _at(level.histories, packed >> 8, level.types)
        own = (np.maximum(counts - discount, 0) + discount * types * chance[:, at]) / np.maximum(totals, 1e-300)
        chance[:, at] = np.where(totals > 0, own, chance[:, at])
    ratio = np.log(chance[1]) - np.log(chance[0])
    ratio[place == 0] = 0.0
    return ratio


@dataclass
class ToxicityModel:
    """The two models and the fitted logistic function; without it every score is 0."""

    name: str
    levels: list[Level]
    logistic: np.ndarray | None = None

    def _table(self) -> HashTable:
        """This worker's table of word differences; one model's takes the place of another's."""
        return heavy_state(f"toxicity {self.name}", "words", lambda: HashTable(SLOTS))

    def differences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log-likelihood difference and the number of bytes it is over."""
        table = self._table()
        sums, sizes = [], []
        for _, _, segment in segments(column):
            found = words(segment, LETTER_BYTES)
            values = table.find(found.hashes, missing=np.iinfo(np.int64).min)
            rest = np.flatnonzero(values == np.iinfo(np.int64).min)
            if len(rest):
                new, first = np.unique(found.hashes[rest], return_index=True)
                own = rest[first]
                symbols, place = spelled(segment.data, found.starts[own], found.ends[own])
                ratios = log_ratios(self.levels, symbols, place)
                per_word = np.add.reduceat(ratios, np.flatnonzero(place == 0)).view(np.int64)
                values[rest] = per_word[np.searchsorted(new, found.hashes[rest])]
                if table.held + len(new) > MOST_WORDS:
                    table.clear()
                if len(new) <= MOST_WORDS:
                    table.put(new, per_word)
            before = np.concatenate([[0.0], np.cumsum(values.view(np.float64))])
            firsts = found.firsts
            sums.append(before[firsts[1:]] - before[firsts[:-1]])
            sizes.append(sums_by_document(found.ends - found.starts + 1, firsts))
        empty = np.zeros(0)
        return np.concatenate(sums or [empty]), np.concatenate(sizes or [empty])

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-(features(*self.differences(column)) @ self.logistic)))


def features(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sizes = np.maximum(sizes, 1.0)
    return np.stack([np.ones(len(sums)), 100 * sums / sizes, sums / np.sqrt(sizes)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a weighted logistic regression."""
    found = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * found
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(found))
        step = np.linalg.solve(curve, slope)
        found -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return found


def _from_counts(counted) -> ToxicityModel:
    model, tables = ToxicityModel(uuid.uuid4().hex, []), {}
    for length, part in counted.groupby("length"):
        summed = part.groupby("gram")[["ordinary", "toxic"]].sum()
        tables[int(length)] = (summed.index.to_numpy(np.int64), summed.to_numpy(float).T)
    if ORDER in tables and (tables[ORDER][1].sum(axis=1) > 0).all():
        model.levels = kneser_ney_levels(tables)
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic") -> ToxicityModel:
    """Models of the labelled documents whose crc32 remainder is not 0; no other label is read."""
    known = training_labels(labels, label).where(F.col("label").isin(0, 1))
    classes = [sampled(docs, known.where(F.col("label") == value), rows) for value in (0, 1)]
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = classes[0].union(classes[1]).withColumn("fold", fold)
    counted = sample.select("text", "label", "fold").mapInArrow(_count_grams(ORDER), NGRAMS).groupBy(
        "length", "gram", "fold").agg(
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"),
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic")).toPandas()
    model = _from_counts(counted)
    partial = [_from_counts(counted[counted["fold"] != f]) for f in range(FOLDS)]
    if not model.levels or not all(p.levels for p in partial):
        return model

    def differences(column: pa.Array, folds: pa.Array) -> pa.Array:
        number = folds.to_numpy(zero_copy_only=False)
        sums, sizes = np.zeros(len(number)), np.zeros(len(number))
        for f, own in enumerate(partial):
            rows_of = np.flatnonzero(number == f)
            sums[rows_of], sizes[rows_of] = own.differences(column.take(pa.array(rows_of)))
        return pa.StructArray.from_arrays([pa.array(sums), pa.array(sizes)], names=["sum", "size"])

    measured = sample.select("label", F.arrow_udf(differences, "struct<sum: double, size: double>")(
        F.col("text"), F.col("fold")).alias("d"))
    table = measured.select("label", "d.sum", "d.size").toPandas()
    y = table["label"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    share = dict(known.groupBy("label").count().collect())
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    x = features(table["sum"].to_numpy(float), table["size"].to_numpy(float))
    model.logistic = fit_logistic(x, y, weight / weight.mean())
    return model


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """Score from 0 to 1 of a text; never null."""
    return F.arrow_udf(lambda column: pa.array(model.scores(column), pa.float64()), "double")(text)
