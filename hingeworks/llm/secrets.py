"""Secret scan: fixed patterns, and sliding-window entropy of unusual strings (operator 3).

``find_secrets`` gives for every text its spans ``(kind, start, end)`` in code
points, end exclusive, sorted by start. Kinds ``assign``, ``access`` and ``hex``
are patterns, matched from the left without overlap per kind. Kind ``entropy``
comes from candidate strings (runs of at least ``WINDOW`` characters of keys and
encodings): a window slides over the candidate, and the sum ``c * log2(c)`` of its
character counts and the totals of each sort of character change by the one character
that enters and the one that leaves. Windows whose Shannon entropy reaches the threshold of
their character class are joined to a span. The classes are hexadecimal, letters with digits,
encodings, and letters of mixed case that turns often; the last one alone is looked for in
joined words. Strings of the allow-list and spans that touch a pattern's span are left out.
All windows of a segment are worked out together, as arrays.

Defined results: null and empty texts have no spans. Whole texts are read, of
any length. Equal rows give equal spans. Nothing but the text is looked at.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from hingeworks.llm.text import LOWER, Segment, heavy_state, segments

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
# Bits; a window of 20 characters has 4.32 at most.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "encoded": 3.8, "mixed": 3.6}
CLASSES = tuple(THRESHOLDS)
# A window of mixed case has so many letters of either case at least, and more turns between them.
MIXED = 7
POINT = 1 << 32
STRETCH = 1 << 20
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"

# Patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Strings that look random and are no secrets.
ALLOWED = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9./_=+-]+",  # dates, numbers, phone numbers
    r"(?:www|https?)[A-Za-z0-9+/_=-]*",
    r"(.)\1*",
))
# Fixed value: joined words, one number at the end; only letters of mixed case are looked at there.
WORDS = re.compile(r"(?:[A-Za-z]+[-_/+=])*[A-Za-z]+[0-9]{0,4}")


def _flags(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


_HEX = _flags(b"0123456789abcdef")
_DIGITS, _UPPER, _LOWER = (_flags(c.encode()) for c in (string.digits, string.ascii_uppercase, string.ascii_lowercase))
# Digits, upper case, lower case, other characters, hexadecimal digits.
_SORTS = (_DIGITS, _UPPER, _LOWER, ~(_DIGITS | _UPPER | _LOWER), _flags(string.hexdigits.encode()))
_CANDIDATE = _flags(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _runs(segment: Segment, flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes inside documents, of at least ``least`` bytes."""
    inside = flags[segment.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    # A document's first byte ends the run before it.
    edge[segment.offsets] = True
    edges = np.flatnonzero(edge)
    held = inside[edges[:-1]]
    starts, stop = edges[:-1][held], edges[1:][held]
    kept = stop - starts >= least
    return starts[kept], stop[kept]


def classes(digits, upper, lower, others, hexed) -> np.ndarray:
    """Number of the class in ``CLASSES`` of windows with so many characters of each sort.

    Windows that ordinary words are like have none (-1): under two digits, under two
    letters or over four other characters.
    """
    letters = upper + lower
    odd = (digits < 2) | (letters < 2) | (others > 4)
    one_case = (hexed == WINDOW) & ((upper == 0) | (lower == 0))
    return np.select([odd, one_case, others > 0], [-1, 0, 2], 1)


def window_class(counts: dict[str, int]) -> str | None:
    """Character class of a window of these characters; None where ordinary words are as mixed."""
    digits, upper, lower, others, hexed = (sum(n for c, n in counts.items() if sort[ord(c)]) for sort in _SORTS)
    number = int(classes(digits, upper, lower, others, hexed))
    return CLASSES[number] if number >= 0 else None


def _window_weights(data: np.ndarray, run: np.ndarray, window: int) -> np.ndarray:
    """Sum of ``c * log2(c)`` over the characters of the window that ends at each place.

    A step adds the character that enters and drops the one that leaves. ``before``
    counts an entering character among those already in the window, ``after`` a leaving
    one among those that stay; both are found by ``window - 1`` comparisons of the
    data with itself moved.
    """
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for step in range(1, window):
        same = (data[step:] == data[:-step]) & (run[step:] == run[:-step])
        before[step:] += same
        after[:-step] += same
    n = np.arange(1, window + 1)
    # In fixed point, so that sums are exact wherever a run begins.
    log = np.concatenate([[0], np.round(n * np.log2(n) * POINT).astype(np.int64)])
    rise = np.diff(log)
    change = rise[before]
    leaves = run[window:] == run[:-window]
    change[window:][leaves] -= rise[after[:-window][leaves]]
    sums = np.cumsum(change)
    # A run starts with an empty window.
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    return sums - np.repeat(np.concatenate([[0], sums])[starts], np.diff(starts, append=len(run)))


def _marked(data: np.ndarray, run: np.ndarray, mixed_only: np.ndarray, window: int) -> np.ndarray:
    """Ends (inclusive) of the windows, inside one run, whose entropy reaches their class's threshold."""
    if len(data) < window:
        return np.zeros(0, np.int64)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[window:] - sums[:-window]

    weights = _window_weights(data, run, window)[window - 1:]
    sorts = [total(flags[data]) for flags in _SORTS]
    digits, upper, lower, others, _ = sorts
    kind = np.where(mixed_only[window - 1:], -1, classes(*sorts))
    turns = np.zeros(len(data), bool)
    turns[1:] = _SORTS[1][data[1:]] & _SORTS[2][data[:-1]] | _SORTS[2][data[1:]] & _SORTS[1][data[:-1]]
    # The first place of a window has nothing before it to differ from.
    turned = total(turns) - turns[: len(data) - window + 1]
    mixed = (kind < 0) & (digits < 2) & (others <= 4) & (upper >= MIXED) & (lower >= MIXED) & (turned > MIXED)
    kind[mixed] = CLASSES.index("mixed")
    most = np.array([(math.log2(window) - THRESHOLDS[c] + 1e-9) * window * POINT for c in CLASSES])
    inside = run[window - 1:] == run[: len(data) - window + 1]
    return np.flatnonzero(inside & (kind >= 0) & (weights <= most[kind])) + window - 1


def _joined_windows(data: np.ndarray, run: np.ndarray, mixed_only: np.ndarray, window: int
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Places ``[start, end)`` of joined windows; runs are worked through ``STRETCH`` places at a time."""
    parts = [np.zeros(0, np.int64)]
    for first in range(0, len(data), STRETCH):
        part = slice(first, first + STRETCH + window - 1)
        parts.append(_marked(data[part], run[part], mixed_only[part], window) + first)
    ends = np.concatenate(parts)
    breaks = (np.diff(ends) > window) | (run[ends[1:]] != run[ends[:-1]])
    opening, closing = np.append(True, breaks), np.append(breaks, True)
    return (ends[opening[: len(ends)]] - window + 1, ends[closing[: len(ends)]] + 1)


def entropy_spans(candidate: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of one candidate whose entropy reaches the threshold of their class."""
    data = np.frombuffer(candidate.encode("ascii"), np.uint8)
    only = np.full(len(data), WORDS.fullmatch(candidate) is not None)
    starts, ends = _joined_windows(data, np.zeros(len(data), np.int64), only, window)
    return list(zip(starts.tolist(), ends.tolist()))


def allowed(candidate: str) -> bool:
    """Whether the candidate is a harmless string; joined words only where no window is of mixed case."""
    return any(p.fullmatch(candidate) for p in ALLOWED) or (
        WORDS.fullmatch(candidate) is not None and not entropy_spans(candidate))


def _candidates(segment: Segment, raw: bytes) -> tuple[np.ndarray, ...]:
    """Characters of all candidates that may hold secrets: their places, runs and whether they are joined words."""
    places, runs, worded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for n, (start, end) in enumerate(zip(*_runs(segment, _CANDIDATE, WINDOW))):
        candidate = raw[start:end].decode()
        like_words = WORDS.fullmatch(candidate) is not None
        if like_words and (candidate.islower() or candidate.isupper()):
            continue
        if not like_words and any(p.fullmatch(candidate) for p in ALLOWED):
            continue
        places.append(np.arange(start, end))
        runs.append(np.full(end - start, n))
        worded.append(np.full(end - start, like_words))
    return np.concatenate(places), np.concatenate(runs), np.concatenate(worded)


def _apart(starts: np.ndarray, ends: np.ndarray, taken: list[tuple[str, int, int]]) -> np.ndarray:
    """Which spans share no character with those taken."""
    if not taken:
        return np.ones(len(starts), bool)
    held = np.array(sorted((s, e) for _, s, e in taken))
    before = np.searchsorted(held[:, 0], ends)
    furthest = np.concatenate([[-1], np.maximum.accumulate(held[:, 1])])
    return furthest[before] <= starts


def _segment_spans(segment: Segment) -> list[list[tuple[str, int, int]]]:
    data, offsets = segment.data, segment.offsets
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(segment.documents)]
    if len(data) == 0:
        return found
    characters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=characters[1:])
    raw, small = data.tobytes(), LOWER[data].tobytes()

    def place(document: int, position: int) -> int:
        return int(characters[position] - characters[offsets[document]])

    for start, end in zip(*_runs(segment, _HEX, LEAST["hex"])):
        i = int(np.searchsorted(offsets, start, side="right")) - 1
        found[i].append(("hex", place(i, start), place(i, end)))
    patterns = ((ACCESS, "access", 0, raw, (b"AKIA",)), (ASSIGN, "assign", 2, small, KEYWORDS))
    for pattern, kind, group, where, keys in patterns:
        hits = set()
        for key in keys:
            at = where.find(key)
            while at >= 0:  # on to the next document after a hit
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                hits.add(i)
                at = where.find(key, int(offsets[i + 1]))
        for i in hits:
            for m in pattern.finditer(raw[offsets[i]: offsets[i + 1]].decode()):
                if len(m[group]) >= LEAST[kind]:
                    found[i].append((kind, m.start(), m.end()))
    places, runs, worded = _candidates(segment, raw)
    starts, ends = _joined_windows(data[places], runs, worded, WINDOW)
    first, last = places[starts], places[ends - 1] + 1
    owners = np.searchsorted(offsets, first, side="right") - 1
    first, last = (characters[edge] - characters[offsets[owners]] for edge in (first, last))
    for i in np.unique(owners):
        own = slice(*np.searchsorted(owners, [i, i + 1]))
        apart = _apart(first[own], last[own], found[i])
        found[i] += [("entropy", a, b) for a, b in zip(first[own][apart].tolist(), last[own][apart].tolist())]
    for own in found:
        own.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _spans(column: pa.Array) -> pa.Array:
    heavy_state("secrets", "none", dict)
    rows = [own for _, _, segment in segments(column) for own in _segment_spans(segment)]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in own] for own in rows], pa.list_(kind))


def find_secrets(text: Column) -> Column:
    """The spans of a text as ``array<struct<kind, start, end>>``; never null."""
    return F.arrow_udf(_spans, SPANS)(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced; overlapping spans become one mark."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(held: Column, span: Column) -> Column:
        gap = F.substring(text, (held["at"] + 1).cast("int"),
                          F.greatest(span["start"] - held["at"], F.lit(0)).cast("int"))
        fresh = (span["start"] >= held["at"]) | (held["at"] == 0)
        out = F.concat(held["out"], F.when(fresh, F.concat(gap, F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(held["at"], span["end"]).alias("at"), out.alias("out"))

    def finish(held: Column) -> Column:
        return F.concat(held["out"], F.substring(text, (held["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, finish))
