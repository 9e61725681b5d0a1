"""Near duplicates by MinHash bands and odd sketches, links confirmed on full sets (operator 5).

1. Every text gets the set of its distinct five-word shingles (64-bit hashes),
   MinHash samples, band keys of five samples each, and an odd sketch: the parity
   bitmap of all samples. Equal sets become one class, named by its smallest id.
2. Classes that share a band key are joined to the smallest class of that key, and
   the connected parts of these joins are the candidate groups.
3. Each group meets in one task; a larger group is cut into blocks and every pair
   of blocks meets. There the popcount of two XORed sketches estimates the
   similarity. Pairs that may reach the threshold are confirmed on the full sets,
   most alike first, unless earlier links join them already; links form a forest,
   so no task emits all pairs.
4. Connected components of the links give the result.

A pair at the threshold shares no band with probability 4e-7 at 0.85 and 5e-5 at
0.80, and its sketch lies beyond the estimate's margin with less than 1e-6 at
either; every other step is exact.

Defined results: null and empty texts and texts of white space have an empty set
and are linked with nothing. A text of fewer than five words has one shingle, its
word sequence. Rows of one id are one document and are linked by each of their
texts; a row with a null id is linked with nothing and stays. Other columns are
ignored. Ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hingeworks.llm.components import components
from hingeworks.llm.tables import written
from hingeworks.llm.text import Segment, give_back, heavy_state, mix, segments, windows, words

SHINGLE = 5
# The threshold of operator 5; the pipeline's stage has its own.
PERCENT = 85
BANDS, BAND_ROWS = 25, 5
SKETCH_BITS = 512
# Standard deviations of one sample between the threshold and the similarity below
# which sketches of pairs are passed over.
MARGIN = 0.56
BLOCK = 512
SIGNATURE = ("struct<n_shingles: bigint, low: bigint, high: bigint, "
             "bands: array<bigint>, sketch: binary>")


def shingle_sets(segment: Segment, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each document, and the documents' offsets."""
    found = words(segment)
    firsts, hashes = windows(found, length)
    owners = found.documents[firsts]
    for short in range(1, length):
        if not (found.counts == short).any():
            continue
        first, own = windows(found, short)
        few = found.counts[found.documents[first]] == short
        owners = np.concatenate([owners, found.documents[first[few]]])
        hashes = np.concatenate([hashes, own[few]])
    order = np.argsort(hashes)
    small = owners.astype(np.uint16 if segment.documents < 1 << 16 else np.int64)[order]
    order = order[np.argsort(small, kind="stable")]
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[fresh], owners[fresh]
    return hashes, np.searchsorted(owners, np.arange(segment.documents + 1))


def _minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One column of samples per nonempty document."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(0, 1 << 32, (BANDS * BAND_ROWS, 3), dtype=np.uint64).astype(np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((len(factors), len(starts)), np.uint32)
    work, other = np.empty_like(low), np.empty_like(low)
    for row, (a, b, c) in zip(samples, factors):
        np.multiply(low, a | np.uint32(1), out=work)
        np.multiply(high, b | np.uint32(1), out=other)
        work += other
        work += c
        np.minimum.reduceat(work, starts, out=row)
    return samples


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, one row of bytes per document."""
    count, documents = samples.shape
    number = np.arange(count, dtype=np.uint64)[:, None] << np.uint64(32)
    place = (mix((number | samples).ravel()) % np.uint64(bits)).astype(np.int64)
    column = np.tile(np.arange(documents), count)
    toggles = np.bincount(column * bits + place, minlength=documents * bits)
    return np.packbits((toggles & 1).astype(bool).reshape(documents, bits), axis=1)


def sketch_limit(similarity: float, samples: int = BANDS * BAND_ROWS, bits: int = SKETCH_BITS) -> float:
    """Expected number of differing bits at a similarity."""
    return bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))


def sketch_similarity(differing: np.ndarray, samples: int = BANDS * BAND_ROWS,
                      bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity estimate from the number of differing bits."""
    share = np.minimum(2 * differing / bits, 1 - 1e-9)
    return np.maximum(0.0, 1 + bits / (4 * samples) * np.log1p(-share))


def margin_similarity(percent: int) -> float:
    """Sketches of pairs below this similarity are passed over: 0.65 for 85 percent."""
    share = percent / 100
    return share - MARGIN * np.sqrt(share * (1 - share))


def set_names(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each nonempty set."""
    return (mix(np.add.reduceat(mix(hashes), starts)),
            mix(np.bitwise_xor.reduceat(mix(hashes + np.uint64(77)), starts)))


def _signatures(column: pa.Array) -> pa.Array:
    parts: list[tuple] = []
    heavy_state("shingles", "none", dict)
    for _, _, segment in segments(column):
        hashes, offsets = shingle_sets(segment)
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        low, high = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        bands = np.zeros((len(sizes), BANDS), np.uint64)
        sketch = np.zeros((len(sizes), SKETCH_BITS // 8), np.uint8)
        if len(full):
            starts = offsets[:-1][full]
            low[full], high[full] = set_names(hashes, starts)
            samples = _minhashes(hashes, starts)
            sketch[full] = odd_sketches(samples)
            keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(full), axis=1)
            for step in range(BAND_ROWS):
                keys = mix(keys) + samples[step::BAND_ROWS].astype(np.uint64)
            bands[full] = mix(keys).T
        parts.append((sizes, low, high, bands, sketch))
    if not parts:
        parts.append((np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64),
                      np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 8), np.uint8)))
    sizes, low, high, bands, sketch = (np.concatenate(p) for p in zip(*parts))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS)
    return pa.StructArray.from_arrays([
        pa.array(sizes.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
        lists.cast(pa.list_(pa.int64())), pa.array([row.tobytes() for row in sketch], pa.binary()),
    ], names=["n_shingles", "low", "high", "bands", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heavy_state("shingles", "none", dict)
    for batch in batches:
        for first, last, segment in segments(batch.column("text")):
            hashes, offsets = shingle_sets(segment)
            view = memoryview(hashes).cast("B") if len(hashes) else memoryview(b"")
            names = np.zeros((2, last - first), np.uint64)
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                names[:, full] = set_names(hashes, offsets[:-1][full])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, last - first), *(pa.array(n.view(np.int64)) for n in names),
                pa.array([bytes(view[8 * a: 8 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
            ], names=["id", "low", "high", "shingles"])


def signatures(text: Column) -> Column:
    return F.arrow_udf(_signatures, SIGNATURE)(text)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) == 0 or 100 * len(small) < percent * len(large):
        return False
    places = np.searchsorted(large, small)
    places[places == len(large)] = 0
    common = int((large[places] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(sketches: np.ndarray, sets: list[np.ndarray], sides: np.ndarray,
           percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Confirmed links that join what pairs of these rows join.

    Rows of side 0 and 1 are two blocks of one group, and only pairs across are
    looked at; where all have one side, all pairs are.
    """
    sizes = np.array([len(s) for s in sets])
    limit, rows = sketch_limit(margin_similarity(percent)), len(sets)
    across = bool(sides.min() != sides.max())
    pairs = []
    for i in range(rows - 1):
        differing = np.bitwise_count(sketches[i + 1:] ^ sketches[i]).sum(axis=1)
        other = sizes[i + 1:]
        close = (differing <= limit) & (
            100 * np.minimum(sizes[i], other) >= percent * np.maximum(sizes[i], other))
        if across:
            close &= sides[i + 1:] != sides[i]
        hit = np.flatnonzero(close)
        pairs.append(np.stack([differing[hit].astype(np.int64), np.full(len(hit), i), hit + i + 1]))
    if not pairs:
        return
    found = np.concatenate(pairs, axis=1)
    found = found[:, np.argsort(found[0], kind="stable")]
    parent = list(range(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(found[1].tolist(), found[2].tolist()):
        a, b = root(i), root(j)
        if a != b and alike(sets[i], sets[j], percent):
            parent[b] = a
            yield i, j


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("part").to_numpy()
        ids = table.column("id").to_numpy()
        sides = table.column("side").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        order = np.lexsort((ids, group))
        firsts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        left, right = [], []
        for rows in np.split(order, firsts[1:]):
            for i, j in forest(sketches[rows], [sets[r] for r in rows], sides[rows], percent):
                left.append(ids[rows[i]])
                right.append(ids[rows[j]])
        del sketches, sets
        give_back()
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``(id, part)`` of the classes that share a band key with another, directly or by a chain."""
    keys = classes.select("id", F.explode("bands").alias("key"))
    # At most one row per key; a key of one class is no candidate.
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    joins = keys.join(first.select("key", "first"), "key").where("id != first")
    found = components(joins.select(F.col("first").alias("a"), F.col("id").alias("b")))
    return found.select("id", F.col("component").alias("part"))


def block_pairs(groups: DataFrame, block: int) -> DataFrame:
    """Each row of ``(id, part)`` once per pair of blocks that it takes part in."""
    sizes = groups.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    small = sizes.agg(F.coalesce(F.sum(F.when(F.col("size") <= block, F.col("size"))), F.lit(0))).first()[0]
    bins = max(1, -(-small // block))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pairs = groups.join(sizes, "part").withColumn("blocks", F.ceil(F.col("size") / block)).withColumn(
        "own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # Small groups share bins of about one block.
    cell = F.when(F.col("blocks") == 1, F.struct(
        F.pmod(F.xxhash64("part"), F.lit(bins)).alias("x"), F.lit(-1).cast("long").alias("y"),
        F.lit(-1).cast("long").alias("z"))).otherwise(F.struct(
            F.col("part").alias("x"), low.cast("long").alias("y"), high.cast("long").alias("z")))
    side = F.when(low == high, 0).when(F.col("own") == low, 0).otherwise(1)
    return pairs.select("id", "part", cell.alias("cell"), side.cast("int").alias("side"))


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; links from ``percent`` similarity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    signed = written(rows.select("doc_id", signatures(F.col("text")).alias("s")).select("doc_id", "s.*"),
                     "signatures")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("low", "high", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").alias("id"), "bands", "sketch")).alias("own"))
    classes = written(classes.select("low", "high", "n_shingles", "own.*"), "classes")
    groups = written(candidate_groups(classes), "groups")
    pairs = block_pairs(groups, block)
    # Of an id with several texts, each stands for the class of its set.
    texts = rows.join(groups.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    sets = texts.select("doc_id", "text").mapInArrow(
        _full_sets, "id long, low long, high long, shingles binary")
    named = ["id", "low", "high"]
    full = sets.join(classes.select(*named, "n_shingles", "sketch"), named).where(
        F.length("shingles") == 8 * F.col("n_shingles")).dropDuplicates([*named, "n_shingles"])
    links = pairs.join(full.select("id", "sketch", "shingles"), "id").groupBy("cell").applyInArrow(
        _links(percent), "a long, b long")
    keys = ["low", "high", "n_shingles"]
    same = linked.select(*keys, "doc_id").join(classes.select(*keys, "id"), keys)
    # Classes of an id that comes with several texts are linked by it.
    several = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z")
    by_id = same.join(several, "doc_id").select("a", F.col("id").alias("b"))
    found = components(links.union(by_id)).select("id", F.col("component").alias("component_id"))
    placed = same.join(found, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
