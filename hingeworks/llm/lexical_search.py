"""Ranked lexical search of many queries at once, with shared partial sums.

A document's score for an item is a sum over the item's terms. Terms that occur in
exactly the same items are one shared set; pairs of sets that several items hold
are joined to larger ones, the most common pair first, until none is held twice. The
sets form a graph in which every item is the sum of a few nodes. For a block of
documents each node's accumulator (one number a document) is computed once, from
the accumulators below it, and used by all nodes and items above.

Items go through in blocks of a bounded size, each against all documents: a first
pass keeps the documents' frequencies of the block's terms, a second one scores them
and keeps each task's best rows, of which the best of all are taken in two steps.

Null texts have no terms. A document row is a document of its own, also where an id
repeats; null ids rank after all others of their score. Equal item rows are one
item; items that share an id but not a text are ranked each on its own. Items or
documents without terms have no rows, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hingeworks.llm.tables import written
from hingeworks.llm.text import utf8

# The rank function's constants.
TOP = 20
SHARE, BASE, SPAN, DAMPING = 25, 100, 1_000_000_000, 12

ITEM_BYTES = 1 << 17  # of item text (and 64 an item) that one block of items has
PAIRS_OF = 256  # items of more sets than this keep them as they are; their sums are the same
SLICE = 1 << 20
ROWS = 256  # documents that are scored together
BUCKETS = 64

# Bytes that are no part of a term become spaces, A-Z become lower case.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GAP = re.compile(rb" ")


def terms_of(data: bytes) -> Counter:
    """Terms and how often they occur; long texts are counted slice by slice."""
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        part = data[start: start + SLICE]
        if len(part) == SLICE:  # on to the next byte that ends a term
            while start + len(part) < len(data) and _TABLE[part[-1]] != 32:
                more = data[start + len(part): start + len(part) + SLICE].translate(_TABLE)
                gap = _GAP.search(more)
                part += more[: gap.end() if gap else len(more)]
        counts.update(part.translate(_TABLE).split())
        start += len(part)
    return counts


@dataclass
class SharedPlan:
    """Nodes ``0..terms-1`` are terms; ``levels`` add nodes up to further ones; items add nodes up.

    A level is ``(first node, children one after another, start of each node's children,
    weight of each child)``.
    """

    terms: list[bytes]
    levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    nodes: int
    items: tuple[np.ndarray, np.ndarray]
    edges: int
    plain_edges: int


def _shared_sets(items: list[Counter]) -> tuple[list[tuple], list[set[int]]]:
    """Sets of ``(term, repeats)`` that occur in exactly the same items, and the sets of each item."""
    holders: dict[tuple, list[int]] = defaultdict(list)
    for place, terms in enumerate(items):
        for element in terms.items():
            holders[element].append(place)
    same: dict[tuple, list[tuple]] = defaultdict(list)
    for element, places in holders.items():
        same[tuple(places)].append(element)
    sets, held = [], [set() for _ in items]
    for places, elements in sorted(same.items()):
        for place in places:
            held[place].add(len(sets))
        sets.append(tuple(sorted(elements)))
    return sets, held


def _joined_pairs(held: list[set[int]], first: int) -> list[tuple[int, int]]:
    """Pairs that become nodes ``first, first + 1, ..``; ``held`` is rewritten with them."""
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)

    def pairs_with(place: int, node: int, others) -> list[tuple[int, int]]:
        return [(min(node, o), max(node, o)) for o in others if o != node]

    small = [p for p, nodes in enumerate(held) if len(nodes) <= PAIRS_OF]
    for place in small:
        nodes = sorted(held[place])
        for i, a in enumerate(nodes):
            for b in nodes[i + 1:]:
                holders[a, b].add(place)
    by_count: dict[int, set] = defaultdict(set)
    for pair, places in holders.items():
        if len(places) > 1:
            by_count[len(places)].add(pair)
    made = []
    count = max(by_count, default=0)
    while count > 1:
        if not by_count[count]:
            count -= 1
            continue
        pair = min(by_count[count])
        node = first + len(made)
        made.append(pair)
        for place in sorted(holders[pair]):
            for own in pair:
                for old in pairs_with(place, own, held[place]):
                    _moved(holders, by_count, old, place, False)
                held[place].discard(own)
            for new in pairs_with(place, node, held[place]):
                _moved(holders, by_count, new, place, True)
            held[place].add(node)
    return made


def _moved(holders, by_count, pair, place: int, added: bool) -> None:
    places = holders[pair]
    by_count[len(places)].discard(pair)
    (places.add if added else places.discard)(place)
    if len(places) > 1:
        by_count[len(places)].add(pair)


def shared_plan(items: list[Counter]) -> SharedPlan:
    terms = sorted({t for item in items for t in item})
    number = {t: i for i, t in enumerate(terms)}
    sets, held = _shared_sets(items)
    # A set of one term that occurs once is the term itself.
    names, sums = [], []
    for elements in sets:
        if len(elements) == 1 and elements[0][1] == 1:
            names.append(number[elements[0][0]])
        else:
            names.append(len(terms) + len(sums))
            sums.append([(number[t], repeats) for t, repeats in elements])
    held = [{names[s] for s in own} for own in held]
    made = _joined_pairs(held, len(terms) + len(sums))
    children = sums + [[(a, 1), (b, 1)] for a, b in made]
    depth = [0] * len(terms)
    for own in children:
        depth.append(1 + max(depth[c] for c, _ in own))
    # Nodes of one depth side by side, so that a level is computed at once.
    order = sorted(range(len(depth)), key=lambda node: depth[node])
    place = {node: i for i, node in enumerate(order)}
    levels, node = [], len(terms)
    while node < len(order):
        own = [n for n in order[node:] if depth[n] == depth[order[node]]]
        below = [[(place[c], w) for c, w in children[n - len(terms)]] for n in own]
        flat = [x for one in below for x in one]
        starts = np.cumsum([0, *map(len, below)])[:-1]
        levels.append((node, np.array([c for c, _ in flat]), starts, np.array([w for _, w in flat], np.int64)))
        node += len(own)
    tops = [sorted(place[n] for n in own) for own in held]
    starts = np.cumsum([0, *map(len, tops)])
    flat = np.array([n for own in tops for n in own], np.int64)
    edges = sum(map(len, children)) + len(flat)
    return SharedPlan(terms, levels, len(order), (flat, starts), edges, sum(map(len, items)))


def accumulate(plan: SharedPlan, scored: np.ndarray) -> np.ndarray:
    """Item sums ``(items, documents)`` from term scores ``(terms, documents)``."""
    held = np.zeros((plan.nodes, scored.shape[1]), np.int64)
    held[: len(scored)] = scored
    for first, children, starts, weights in plan.levels:
        sums = np.add.reduceat(held[children] * weights[:, None], starts, axis=0)
        held[first: first + len(starts)] = sums
    flat, starts = plan.items
    total = np.zeros((len(starts) - 1, scored.shape[1]), np.int64)
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        total[filled] = np.add.reduceat(held[flat], starts[filled], axis=0)
    return total


COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Per document its number of terms, and the frequencies of the given ones."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            totals, lengths, found, often = [], [], [], []
            for first, last in zip(offsets[:-1], offsets[1:]):
                counts = terms_of(raw[first:last].tobytes())
                own = sorted((number[t], c) for t, c in counts.items() if t in number)
                totals.append(counts.total())
                lengths.append(len(own))
                found += [t for t, _ in own]
                often += [c for _, c in own]
            steps = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()),
                 pa.ListArray.from_arrays(steps, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(steps, pa.array(often, pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, COUNTED)


class Best:
    """The highest-scoring documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor, self.size = top, np.zeros(items, np.int64), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def offer(self, total: np.ndarray, ids: np.ndarray, known: np.ndarray):
        """``floor`` is what a document has to reach: 1 at first, then the score of the last place."""
        items, rows = np.nonzero(total >= np.maximum(self.floor, 1)[:, None])
        if len(items):
            self.parts.append((items, total[items, rows], ids[rows], known[rows]))
            self.size += len(items)
            if self.size > 8 * self.top * len(self.floor):
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        items, scores, ids, known = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, ~known, -scores, items))
        items, scores, ids, known = (x[order] for x in (items, scores, ids, known))
        first = np.searchsorted(items, items)
        kept = np.arange(len(items)) - first < self.top
        items, scores, ids, known = (x[kept] for x in (items, scores, ids, known))
        last = np.flatnonzero(np.arange(len(items)) - np.searchsorted(items, items) == self.top - 1)
        self.floor[items[last]] = scores[last]
        self.parts, self.size = [(items, scores, ids, known)], len(items)
        return self.parts[0]


SCORED = "item int, score long, doc_id long"


def best_documents(counted: DataFrame, plan: SharedPlan, weights: np.ndarray, documents: int,
                   words: int, top: int) -> DataFrame:
    """Each task's best documents of every item."""

    def run(batches):
        best = Best(len(plan.items[1]) - 1, top)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists, often = part.column("terms"), part.column("tfs").flatten().to_numpy()
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                places = lists.flatten().to_numpy()
                m = BASE - SHARE + SHARE * part.column("n").to_numpy() * documents // words
                scored = np.zeros((len(weights), part.num_rows), np.int64)
                scored[places, rows] = weights[places] * (SPAN * often // (1000 * often + DAMPING * m[rows]))
                ids = part.column("doc_id")
                best.offer(accumulate(plan, scored), ids.fill_null(0).to_numpy(),
                           ids.is_valid().to_numpy(zero_copy_only=False))
        items, scores, ids, known = best.shrink()
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=~known)],
            ["item", "score", "doc_id"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, SCORED)


def _rank(*keys: str) -> Column:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def _item_blocks(items: DataFrame):
    """Items in blocks of bounded text, in the order of their hash; the driver holds one at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    block, size = [], 0
    for row in rows.orderBy(F.xxhash64("item_id", "text"), "item_id", "text").toLocalIterator():
        own = len(row.text.encode()) + 64
        if block and size + own > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, terms_of(row.text.encode())))
        size += own
    if block:
        yield block


def term_weights(counted: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weights of the terms, and the numbers of documents with a term and of all their terms."""
    documents, words = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(terms, np.int64)  # one number a term of the block
    for term, rows in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        holding[term] = rows
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))).astype(np.int64), documents, words


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of each item's best documents."""
    found = None
    for block in _item_blocks(items):
        plan = shared_plan([terms for _, terms in block])
        counted = written(term_counts(docs, plan.terms), "term_counts")
        weights, documents, words = term_weights(counted, len(plan.terms))
        rows = best_documents(counted, plan, weights, documents, words, top)
        # Two steps, so that no task gets the rows of an item from all tasks.
        rows = rows.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS)))
        rows = rows.withColumn("place", _rank("item", "bucket")).where(F.col("place") <= top).drop("place", "bucket")
        rows = rows.withColumn("rank", _rank("item").cast("int")).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame(
            [(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        # A block has at most ITEM_BYTES / 64 items.
        ranked = written(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
