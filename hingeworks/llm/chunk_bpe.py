"""BPE encoding with content-defined chunk reuse, and decoding (operator 1).

A text is cut where a hash of its last ``WINDOW`` characters has ``CUT_BITS`` zero
bits, so equal passages give equal chunks wherever they stand. Documents are
dealt by the smallest hash of their cuts, which brings documents with common
passages into one task; large bins are split by Spark. A task encodes a
distinct chunk once and reuses its ids. A cut may fall inside a token, so each
join is repaired: the characters around it are encoded anew, from one border
of pieces to another, and the window grows on both sides until its outermost
pieces come out exactly as the chunks have them. Ids equal those of encoding the
whole text with the library.

Defined results: a null text is empty and has no ids; a null id is kept. Equal
rows give equal results, one each. A special token's string in a text is that
token, as in the library; such a text is encoded whole. Other columns are
ignored. A text of any length is encoded whole, never cut off.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from hingeworks.llm.encoder import SPECIAL, byte_strings, encoder
from hingeworks.llm.text import mix, powers
from hingeworks.llm.token_files import texts_of

WINDOW = 24
CUT_BITS = 10  # one cut in about a thousand characters
HELD_CHARS = 4 << 20  # chunk texts kept for reuse in one task
LEAST_CHARS = 256  # between two cuts
LEAST_TAIL = 64
CONTEXT = 2  # pieces of agreement on each side of a repaired join
ENCODED = "doc_id long, ids array<int>"


def cut_points(codes: np.ndarray, window: int = WINDOW, bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places after which to cut, and the window's hash there."""
    if len(codes) <= window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    rolling = mix((sums[window:] - sums[:-window]) * down[: len(codes) + 1 - window])
    hit = np.flatnonzero((rolling & np.uint64((1 << bits) - 1)) == 0)
    places = hit + window
    inside = places < len(codes)
    return places[inside], rolling[hit[inside]]


def chunk_list(text: str) -> list[str]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, start = [], 0
    for place in cut_points(codes)[0].tolist():
        if place - start >= LEAST_CHARS and place <= len(text) - LEAST_TAIL:
            ends.append(place)
            start = place
    ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Chunk:
    """A chunk's ids, and the place and ids before each of its pieces."""

    __slots__ = ("text", "ids", "places", "before")

    def __init__(self, text, ids, places, before):
        self.text, self.ids, self.places, self.before = text, ids, places, before


class ChunkEncoder:
    """Encodes texts of one task, each distinct chunk once while it is held."""

    def __init__(self, path: str, byte_level: bool = True):
        self.tool = encoder(path, byte_level)
        self.held: dict[str, Chunk] = {}
        self.chars = self.encoded = self.reused = 0

    def _chunks(self, texts: list[str]) -> list[list[Chunk]]:
        lists = [chunk_list(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for own in lists for c in own if c not in self.held))
        got = self.tool.encode(new, with_pieces=True)
        fresh = {c: Chunk(c, got.of(i).copy(), *(x.astype(np.int32) for x in got.pieces[i]))
                 for i, c in enumerate(new)}
        self.encoded += len(new)
        self.reused += sum(map(len, lists)) - len(new)
        found = [[fresh.get(c) or self.held[c] for c in own] for own in lists]
        self.chars += sum(map(len, new))
        if self.chars > HELD_CHARS:
            self.held, self.chars = {}, sum(map(len, new))
        self.held |= fresh
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = ["" if any(s in t for s in SPECIAL) else t for t in texts]
        documents = self._chunks(plain)
        ids = self._repaired(documents)
        whole = [i for i, t in enumerate(texts) if t and not plain[i]]
        if whole:
            got = self.tool.encode([texts[i] for i in whole])
            for n, i in enumerate(whole):
                ids[i] = got.of(n)
        return ids

    def _repaired(self, documents: list[list[Chunk]]) -> list[np.ndarray]:
        """Ids of the documents; the joins of all of them are repaired at once."""
        # A chunk without borders of pieces (unusual characters) has nothing to repair at.
        whole = {i for i, own in enumerate(documents) if any(len(c.places) == 0 for c in own)}
        joins = [
            [i, n, CONTEXT] for i, own in enumerate(documents) if i not in whole
            for n in range(len(own) - 1)
        ]
        spans: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
        while joins:
            texts, frames = [], []
            for i, n, reach in joins:
                left, right = documents[i][n], documents[i][n + 1]
                a = max(0, len(left.places) - 1 - reach)
                b = min(len(right.places) - 1, 1 + reach)
                texts.append(left.text[left.places[a]:] + right.text[: right.places[b]])
                frames.append((a, b))
            got, again = self.tool.encode(texts, with_pieces=True), []
            for (i, n, reach), (a, b), k in zip(joins, frames, range(len(texts))):
                left, right = documents[i][n], documents[i][n + 1]
                window, (places, before) = got.of(k), got.pieces[k]
                agreed = _agreement(left, right, a, b, window, places, before)
                if agreed is not None:
                    spans[i, n] = agreed
                elif a == 0 and b == len(right.places) - 1:
                    whole.add(i)  # both chunks are used up
                else:
                    again.append([i, n, reach * 4])
            joins = again
        results = []
        for i, own in enumerate(documents):
            if i in whole or not own:
                results.append(np.zeros(0, np.uint32))
                continue
            parts, start = [], 0
            for n, chunk in enumerate(own):
                if n == len(own) - 1:
                    parts.append(chunk.ids[start:])
                else:
                    stop, go_on, ids = spans[i, n]
                    if start > stop:  # two repairs meet in one short chunk
                        whole.add(i)
                        break
                    parts += [chunk.ids[start:stop], ids]
                    start = go_on
            results.append(np.concatenate(parts) if i not in whole else np.zeros(0, np.uint32))
        if whole:
            rest = sorted(whole)
            got = self.tool.encode(["".join(c.text for c in documents[i]) for i in rest])
            for n, i in enumerate(rest):
                results[i] = got.of(n)
        return results


def _agreement(left: Chunk, right: Chunk, a: int, b: int, window, places, before):
    """``(ids kept on the left, ids left out on the right, ids between)`` or None.

    The window runs from piece ``a`` of the left chunk to piece ``b`` of the right.
    Its first and last pieces must have the borders and ids that the chunks have.
    """
    if b < 1 or len(places) < 2:
        return None
    head = int(left.places[a])
    text_length = len(left.text) - head + int(right.places[b])
    ends = np.append(places, text_length)
    # First piece: same end and same ids (unless the text itself begins there).
    if a + 1 < len(left.places):
        if ends[1] != left.places[a + 1] - head:
            return None
        first = left.ids[left.before[a]: left.before[a + 1]]
        if not np.array_equal(window[: before[1]], first):
            return None
    elif a != 0:
        return None
    # Last piece: same start and same ids as the piece before b.
    last_start = int(right.places[b - 1]) + len(left.text) - head
    if places[-1] != last_start or not np.array_equal(
        window[before[len(places) - 1]:], right.ids[right.before[b - 1]: right.before[b]]
    ):
        return None
    return int(left.before[a]), int(right.before[b]), window


def _bin(column: pa.Array) -> pa.Array:
    found = []
    for text in column.to_pylist():
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = cut_points(codes)[1]
        if len(hashes):
            found.append(int(hashes.min() >> np.uint64(1)))
        else:
            found.append(int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=7).digest()))
    return pa.array(found, pa.int64())


def _encode_rows(path: str, byte_level: bool):
    def run(batches):
        tool = ChunkEncoder(path, byte_level)
        for batch in batches:
            for first, last, texts in texts_of(batch.column("text")):
                ids = tool.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                ], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, byte_level: bool = True) -> DataFrame:
    """``(doc_id, ids)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    binned = rows.withColumn("bin", F.arrow_udf(_bin, "long")(F.col("text")))
    dealt = binned.hint("rebalance", "bin").sortWithinPartitions("bin")
    return dealt.select("doc_id", "text").mapInArrow(
        _encode_rows(path, byte_level), ENCODED)


def decoder(path: str):
    """A Column function: ids of a byte-level file to text, bad bytes replaced."""

    def run(ids: pa.Array) -> pa.Array:
        data, offsets = byte_strings(path)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        lengths = (offsets[1:] - offsets[:-1])[flat]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = before[np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False))]
        found, start = [], 0
        for valid, end in zip(ids.is_valid().to_pylist(), ends.tolist()):
            own = slice(*np.searchsorted(before, (start, end)))
            places = np.repeat(offsets[flat[own]] - before[own], lengths[own]) + np.arange(start, end)
            found.append(data[places].tobytes().decode("utf-8", "replace") if valid else None)
            start = end
        return pa.array(found, pa.string())

    return F.arrow_udf(run, "string")


@F.arrow_udf(StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """Lower-case hex of the ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    view = memoryview(flat).cast("B")
    return pa.array([
        hashlib.sha256(view[4 * a: 4 * b]).hexdigest() for a, b in zip([0, *ends], ends)
    ], pa.string())
