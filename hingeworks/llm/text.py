"""Words of many documents at once: UTF-8 bytes of an Arrow array as numpy arrays.

A segment is a run of documents of about half a megabyte. Its words are found with
byte masks and identified by a 64-bit hash, so no Python object is made for a
word. Null texts count as empty everywhere.

The hash of a span is a pair of polynomials modulo the prime 2^31 - 1, and its length.
Two spans of up to L symbols have one value in both for at most L^2 of the 4.6e18
pairs of bases. (Modulo a power of two there are short strings, with the pattern of
the Thue-Morse sequence, that meet under every base.)
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

SEGMENT_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 31) - 1
_BASES = (1_299_709_201, 982_451_653, 1_640_531_527)
_STEP = 1 << 20
_STATE = "_hingeworks_worker_state"

# White space that ends a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def worker_state(name: str, make: Callable[[], object]):
    """A value that lives as long as this Python worker, whatever task asks for it."""
    module = sys.modules.setdefault(_STATE, types.ModuleType(_STATE))
    if name not in module.__dict__:
        module.__dict__[name] = make()
    return module.__dict__[name]


def heavy_state(use: str, name: str, make: Callable[[], object]):
    """Like ``worker_state`` for large tables: those of another use are let go first."""
    held = worker_state("heavy", dict)
    if held.get("use") != use:
        held.clear()
        held["use"] = use
    if name not in held:
        held[name] = make()
    return held[name]


def give_back() -> None:
    """Return freed memory to the system, which allocators otherwise keep for this worker."""
    pa.default_memory_pool().release_unused()
    library = worker_state("libc", lambda: ctypes.CDLL(None))
    if hasattr(library, "malloc_trim"):  # glibc
        library.malloc_trim(0)


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    held = worker_state("powers", dict)
    if len(held.get("up", ())) < count:
        size = max(count, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            held[key] = np.multiply.accumulate(steps)
    return held["up"], held["down"]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits; a bijection."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _prime_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime, for ``_STEP`` places."""

    def make():
        tables = []
        for own in (base, pow(base, -1, _PRIME)):
            table = np.ones(1, np.uint64)
            while len(table) < _STEP:
                table = np.concatenate([table, table * np.uint64(pow(own, len(table), _PRIME)) % np.uint64(_PRIME)])
            tables.append(table.astype(np.uint32))
        return tuple(tables)

    return worker_state(f"powers of {base}", make)


def _polynomials(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial in ``base`` modulo the prime of each span; symbols are below 2^21."""
    up, down = _prime_powers(base)
    prime, shift = np.uint64(_PRIME), np.uint64(31)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    for first in range(0, len(symbols), _STEP):
        part = symbols[first: first + _STEP].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        if first:
            part = ((part & prime) + (part >> shift)) * np.uint64(pow(base, first, _PRIME))
        # Below 2^33, so that the running sum of 2^30 symbols fits.
        part = (part & prime) + (part >> shift)
        own = sums[first + 1: first + 1 + len(part)]
        np.cumsum(part, out=own)
        own += sums[first]
    back = down[starts & (_STEP - 1)].astype(np.uint64)
    if len(symbols) > _STEP:
        inverse = pow(base, -_STEP, _PRIME)
        far = np.array([pow(inverse, k, _PRIME) for k in range(len(symbols) // _STEP + 1)], np.uint64)
        back = back * far[starts // _STEP] % prime
    return (sums[ends] - sums[starts]) % prime * back % prime


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span ``[start, end)`` of a number array."""
    first, second = (_polynomials(symbols, starts, ends, base) for base in _BASES[:2])
    return mix(mix(first << np.uint64(31) | second) + (ends - starts).astype(np.uint64))


def span_checks(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A further number for each span, independent of its hash."""
    return _polynomials(symbols, starts, ends, _BASES[2]).astype(np.uint32)


def _byte_flags(values) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(values)] = True
    return flags


WORD_BYTES = ~_byte_flags(SPACES)
# ASCII letters and every byte of a longer character.
LETTER_BYTES = _byte_flags([*range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Segment:
    """``data`` holds the documents' bytes one after another, cut by ``offsets``."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def documents(self) -> int:
        return len(self.offsets) - 1


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def cuts(offsets: np.ndarray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes, or of one longer document."""
    first, documents = 0, len(offsets) - 1
    while first < documents:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), documents)
        yield first, last
        first = last


def segments(column, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, Segment]]:
    data, offsets = utf8(column)
    for first, last in cuts(offsets, limit):
        part = offsets[first: last + 1]
        yield first, last, Segment(data[part[0]: part[-1]], part - part[0])
    give_back()


@dataclass
class Words:
    """Spans, hashes and document numbers of the words of a segment, in order."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    documents: np.ndarray
    counts: np.ndarray  # words of each document

    @property
    def firsts(self) -> np.ndarray:
        """Position of each document's first word, and the number of all words."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def words(segment: Segment, flags: np.ndarray = WORD_BYTES, lower: bool = True) -> Words:
    """Maximal runs of bytes that ``flags`` marks, inside documents; A-Z in lower case."""
    data, offsets = segment.data, segment.offsets
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = flags[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(data)]
    opening = inside & ~before
    opening[edges] |= inside[edges]
    closing = before & ~inside
    closing[edges] |= before[edges]
    closing[-1] |= before[-1]
    starts, ends = np.flatnonzero(opening), np.flatnonzero(closing)
    hashes = span_hashes(LOWER[data] if lower else data, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(starts, ends, hashes, np.repeat(np.arange(segment.documents), counts), counts)


def windows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of all runs of ``length`` words inside a document."""
    if len(found.hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(found.hashes) - length + 1)
    starts = starts[found.documents[starts] == found.documents[starts + length - 1]]
    total = np.zeros(len(starts), np.uint64)
    for step in range(length):
        total = mix(total) + found.hashes[starts + step]
    return starts, mix(total)


def sums_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``[offsets[i], offsets[i + 1])``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def id_remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))
