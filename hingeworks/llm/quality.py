"""Quality rules: a learned decision list over text statistics (operator 10).

``statistics`` measures a text. ``learn`` grows threshold conjunctions for the
rejected class one after another on labelled statistics: a rule gets conditions
by information gain on two thirds of the rows that are left, loses its last
conditions while that helps on the other third, and is kept while its precision
there is high enough; rows it covers are removed. ``DecisionList.expression`` is
the ordered Spark conditional expression: the first rule that holds decides,
otherwise the text is kept.

Defined results: null and empty texts have no words, so they fail the base
rules. Equal rows get equal results. Texts of any length are measured whole.
Without labelled rows, or with one class only, the list is empty and keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hingeworks.llm.samples import labelled_sample
from hingeworks.llm.text import Segment, WORD_BYTES, heavy_state, mix, segments, span_hashes, sums_by_document, windows, words

SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct")
STATS = ", ".join(f"{name}: bigint" for name in COUNTS)
# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50


def _flags(values) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(values)] = True
    return flags


_SYMBOL, _UPPER = _flags(SYMBOLS), _flags(range(65, 91))
_LETTER = _flags([*range(65, 91), *range(97, 123)])
_DIGIT = _flags(range(48, 58))
_MARK = _flags([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_FIRST_BYTE = _flags([*range(128), *range(192, 256)])  # of a code point


def _by_document(hashes: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Hashes that tell equal values of different documents apart."""
    return mix(hashes + mix(documents.astype(np.uint64) + np.uint64(1)))


def segment_counts(segment: Segment) -> dict[str, np.ndarray]:
    data, offsets = segment.data, segment.offsets
    found = words(segment, lower=False)
    documents = segment.documents

    def total(flags: np.ndarray) -> np.ndarray:
        return sums_by_document(flags[data], offsets)

    def distinct(hashes, owners) -> np.ndarray:
        _, first = np.unique(_by_document(hashes, owners), return_index=True)
        return np.bincount(owners[first], minlength=documents)

    first, window = windows(found, 3)
    owners = found.documents[first]
    _, inverse, times = np.unique(_by_document(window, owners), return_inverse=True, return_counts=True)
    again = first[times[inverse] > 1]
    covered = np.zeros(len(found.hashes) + 2, bool)
    for step in range(3):
        covered[again + step] = True
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([offsets, breaks]))
    starts, ends = bounds[:-1], bounds[1:].copy()
    ends -= data[np.maximum(ends - 1, 0)] == 10 if len(data) else 0
    solid = np.concatenate([[0], np.cumsum(WORD_BYTES[data])])
    with_word = solid[ends] > solid[starts]
    starts, ends = starts[with_word], ends[with_word]
    line_owner = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=documents)
    hashes = span_hashes(data, starts, ends)
    return {
        "n_words": found.counts,
        "word_chars": total(WORD_BYTES & _FIRST_BYTE),
        "n_symbols": total(_SYMBOL),
        "n_dup_lines": lines - distinct(hashes, line_owner),
        "n_repeat_words": sums_by_document(covered[:-2], found.firsts),
        "n_lines": lines,
        "n_upper": total(_UPPER), "n_letters": total(_LETTER), "n_digits": total(_DIGIT),
        "n_marks": total(_MARK),
        "n_distinct": distinct(found.hashes, found.documents),
    }


def _statistics(column: pa.Array) -> pa.Array:
    heavy_state("statistics", "none", dict)
    parts = [segment_counts(segment) for _, _, segment in segments(column)]
    return pa.StructArray.from_arrays([
        pa.array(np.concatenate([p[name] for p in parts]).astype(np.int64) if parts else [], pa.int64())
        for name in COUNTS
    ], names=list(COUNTS))


def statistics(text: Column) -> Column:
    """The counts of a text as one struct; never null."""
    return F.arrow_udf(_statistics, f"struct<{STATS}>")(text)


# Name of each feature, its numerator and its denominator.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_word": ("n_digits", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str, stats: Column) -> Column:
    top, bottom = FEATURES[name]
    value = stats[top].cast("double")
    return value / F.greatest(stats[bottom], F.lit(1)).cast("double") if bottom else value


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold; else value <= threshold
    threshold: float

    def holds(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        values = cells[self.feature]
        return values >= self.threshold if self.above else values <= self.threshold

    def expression(self, stats: Column) -> Column:
        value = feature(self.feature, stats)
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass
class DecisionList:
    """Ordered conjunctions for the rejected class; texts that none covers are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self, stats: Column) -> Column:
        """The first rule that holds, from 1, or 0."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            test = rule[0].expression(stats)
            for condition in rule[1:]:
                test &= condition.expression(stats)
            chain = F.when(test, number) if chain is None else chain.when(test, number)
        return F.lit(0) if chain is None else chain.otherwise(0)

    def expression(self, stats: Column) -> Column:
        """True where the text is kept."""
        return self.rule_number(stats) == 0


def _holds(rule: list[Condition], cells: dict[str, np.ndarray], rows: int) -> np.ndarray:
    mask = np.ones(rows, bool)
    for condition in rule:
        mask &= condition.holds(cells)
    return mask


def _best_condition(cells, bad, covered) -> Condition | None:
    """The condition with the largest information gain on covered rows."""
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    if p == 0 or n == 0:
        return None
    base, best, choice = np.log2(p / (p + n)), 1e-9, None
    for name in FEATURES:
        values, own = cells[name][covered], bad[covered]
        order = np.argsort(values, kind="stable")
        values, own = values[order], own[order].astype(np.int64)
        ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))[:-1]
        if len(ends) == 0:
            continue
        left_p = np.cumsum(own)[ends]
        left = ends + 1
        middle = (values[ends] + values[ends + 1]) / 2
        for above in (False, True):
            hit_p = p - left_p if above else left_p
            hit = p + n - left if above else left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit_p > 0, hit_p * (np.log2(hit_p / hit) - base), 0.0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, choice = gain[at], Condition(name, above, float(middle[at]))
    return choice


def grow_list(cells: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9,
              most_rules: int = 12, most_conditions: int = 4, least_rows: int = 5) -> DecisionList:
    """Sequential covering of the rows marked ``bad``."""
    rows, found = len(bad), DecisionList()
    grow = np.arange(rows) % 3 != 0
    left = np.ones(rows, bool)
    while len(found.rules) < most_rules and (left & bad & grow).any():
        rule: list[Condition] = []
        covered = left & grow
        while len(rule) < most_conditions:
            condition = _best_condition(cells, bad, covered)
            if condition is None:
                break
            rule.append(condition)
            covered = covered & condition.holds(cells)

        def worth(candidate: list[Condition]) -> tuple[float, int, float]:
            mask = _holds(candidate, cells, rows) & left & ~grow
            p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
            return (p - n) / max(p + n, 1), p + n, p / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        _, hit, share = worth(rule) if rule else (0, 0, 0)
        if hit < least_rows or share < precision:
            break
        found.rules.append(rule)
        left &= ~_holds(rule, cells, rows)
    return found


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality",
          rows: int = SAMPLE_ROWS, precision: float = 0.9) -> DecisionList:
    """A list from at most ``rows`` labelled documents that pass the base rules; label 0 is bad."""
    sample = labelled_sample(docs, labels, label, rows).withColumn("stats", statistics(F.col("text")))
    stats = F.col("stats")
    # Filtered here: a filter on the statistics would measure every text twice.
    table = sample.select(
        F.xxhash64("doc_id").alias("order"), "label", base_failed(stats).alias("failed"),
        *(feature(n, stats).alias(n) for n in FEATURES)
    ).toPandas().sort_values("order", kind="stable")
    table = table[~table["failed"].astype(bool)]
    cells = {name: table[name].to_numpy(float) for name in FEATURES}
    return grow_list(cells, table["label"].to_numpy() == 0, precision)


def with_verdict(docs: DataFrame, rules: DecisionList, name: str) -> DataFrame:
    """``docs`` and one struct column ``name`` of the counts, ``base_failed`` and ``kept``."""
    measured = docs.withColumn(name, statistics(F.col("text").cast("string")))
    stats = F.col(f"`{name}`")
    failed = base_failed(stats)
    return measured.withColumn(name, F.struct(
        *(stats[c].alias(c) for c in COUNTS), failed.alias("base_failed"),
        (~failed & rules.expression(stats)).alias("kept")))
