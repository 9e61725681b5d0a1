"""Fill-in-middle over texts that are stored as seekable compressed frames.

A stored text is a run of independent zstandard frames, cut after whole lines,
with the number of lines, characters and bytes up to the end of each. A place in
the text is found from these numbers and the one frame that holds it; the whole
text is only ever read frame by frame.

Nulls count as empty texts and empty ids. Repeated rows each have their own
result, other columns are left alone, an empty table gives an empty table. A line
longer than a frame's size is a frame of its own, so a very long text needs its
own compressed size and that of its longest line or frame.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from hingeworks.llm.text import utf8, worker_state

FRAME_BYTES = 1 << 14
LEVEL = 3
# The marks before prefix, suffix and middle, and the order of the parts.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

STORED = "struct<index:array<struct<units:bigint,chars:bigint,bytes:bigint>>,marked:boolean,data:binary>"
_INDEX = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64())])


@dataclass(frozen=True)
class Rates:
    """Per cent of texts that are transformed, and of those that put the suffix first."""

    transformed: int = 100
    suffix_first: int = 50
    seed: str = "7"


def _codecs():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def frame_cuts(data: bytes, size: int = FRAME_BYTES):
    """``(start, end)`` of the frames: about ``size`` bytes of whole lines."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            line = data.rfind(b"\n", start, end)
            line = line if line >= 0 else data.find(b"\n", end)
            end = line + 1 if line >= 0 else len(data)
        end = min(end, len(data))
        yield start, end
        start = end


def _list(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def store(text: Column, size: int = FRAME_BYTES) -> Column:
    """The text as frames: ``index`` of running totals, ``marked`` where a mark occurs in it, ``data``."""
    marks = [m.encode() for m in MARKS.values()]

    def apply(texts: pa.Array) -> pa.Array:
        pack = worker_state("zstandard", _codecs)[0].compress
        raw, offsets = utf8(texts)
        units, chars, ends, frames, marked, stored = [], [], [], [], [], []
        for first, last in zip(offsets[:-1], offsets[1:]):
            data, held, parts = raw[first:last].tobytes(), [0, 0, 0], []
            for start, end in frame_cuts(data, size):
                part = data[start:end]
                packed = pack(part)
                held[0] += part.count(b"\n") + (not part.endswith(b"\n"))
                held[1] += len(part.decode())
                held[2] += len(packed)
                for column, value in zip((units, chars, ends), held):
                    column.append(value)
                parts.append(packed)
            frames.append(len(parts))
            marked.append(any(m in data for m in marks))
            stored.append(b"".join(parts))
        index = pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (units, chars, ends)], fields=list(_INDEX))
        return pa.StructArray.from_arrays(
            [_list(frames, index), pa.array(marked, pa.bool_()), pa.array(stored, pa.binary())],
            ["index", "marked", "data"])

    return F.arrow_udf(apply, STORED)(text.cast("string"))


class Frames:
    """One stored text: running totals, and frames that are unpacked one at a time."""

    def __init__(self, units: list[int], chars: list[int], ends: list[int], data: bytes):
        self.units, self.chars, self.ends, self.data = units, chars, ends, data
        self.unpack = worker_state("zstandard", _codecs)[1].decompress
        self.held = (-1, b"")

    @property
    def n(self) -> int:
        return self.units[-1] if self.units else 0

    def frame(self, place: int) -> bytes:
        if self.held[0] != place:
            start = self.ends[place - 1] if place else 0
            self.held = place, self.unpack(self.data[start: self.ends[place]])
        return self.held[1]

    def cut(self, units: int) -> tuple[int, int, int]:
        """``(frame, byte in it, characters of the text before)`` of the place after so many units."""
        if units == 0:
            return 0, 0, 0
        place = bisect_left(self.units, units)
        if self.units[place] == units:  # the end of a frame: nothing is unpacked
            return place + 1, 0, self.chars[place]
        part, before = self.frame(place), self.units[place - 1] if place else 0
        end = 0
        for _ in range(units - before):
            end = part.index(b"\n", end) + 1
        return place, end, (self.chars[place - 1] if place else 0) + len(part[:end].decode())

    def between(self, start: tuple[int, int, int], end: tuple[int, int, int]):
        """The bytes from one cut to another, frame by frame."""
        for place in range(start[0], min(end[0] + 1, len(self.ends))):
            if place == end[0] and end[1] == 0:
                return
            part = self.frame(place)
            yield part[start[1] if place == start[0] else 0: end[1] if place == end[0] else len(part)]


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    """The first four 32-bit numbers of the sha256 of ``seed:doc_id``; a null id is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i: i + 4], "big") for i in range(0, 16, 4))


FILLED = ("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,"
          "output:string,output_sha256:string>")


def fill_in_middle(stored: Column, doc_id: Column, rates: Rates = Rates()) -> Column:
    """Number of lines, form, characters of prefix and middle, the output and its digest.

    The two cuts unpack only the frames that hold them; output and digest take the
    ordered parts frame by frame. ``form`` is ``plain`` (the text itself) for empty
    and marked texts and those that the rates leave out.
    """

    def one(frames: Frames, marked: bool, i: int | None):
        h1, h2, h3, h4 = draws(i, rates.seed)
        n = frames.n
        start, stop = (0, 0, 0), (len(frames.ends), 0, frames.chars[-1] if n else 0)
        if n == 0 or marked or h3 % 100 >= rates.transformed:
            form, chars = "plain", (None, None)
            pieces = [("", start, stop)]
        else:
            form = "spm" if h4 % 100 < rates.suffix_first else "psm"
            low, high = (frames.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
            chars = low[2], high[2] - low[2]
            spans = {"prefix": (start, low), "middle": (low, high), "suffix": (high, stop)}
            pieces = [(MARKS[part], *spans[part]) for part in ORDERS[form]]
        digest, made = hashlib.sha256(), []
        for mark, first, last in pieces:
            for part in (mark.encode(), *frames.between(first, last)):
                digest.update(part)
                made.append(part)
        return n, form, *chars, b"".join(made), digest.hexdigest()

    def apply(texts: pa.Array, ids: pa.Array) -> pa.Array:
        index, marked, data = texts.flatten()
        totals = [x.to_numpy() for x in index.flatten().flatten()]
        steps = np.concatenate([[0], np.cumsum(index.value_lengths().to_numpy())])
        rows = []
        for row, i in enumerate(ids.to_pylist()):
            own = (t[steps[row]: steps[row + 1]].tolist() for t in totals)
            rows.append(one(Frames(*own, data[row].as_py()), marked[row].as_py(), i))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
        columns[4] = columns[4].cast(pa.string())
        return pa.StructArray.from_arrays(
            columns, ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    return F.arrow_udf(apply, FILLED)(stored, doc_id.cast("long"))


def restored(output: Column, form: Column) -> Column:
    """The text that was put into this form: its three parts between the marks, in their order."""
    text = output
    for name, order in ORDERS.items():
        first, second, third = (MARKS[part] for part in order)
        rest = F.substring(output, len(first) + 1, F.length(output))
        head, tail = F.substring_index(rest, third, 1), F.substring_index(rest, third, -1)
        found = {order[0]: F.substring_index(head, second, 1),
                 order[1]: F.substring_index(head, second, -1), "middle": tail}
        text = F.when(form == name, F.concat(found["prefix"], found["middle"], found["suffix"])).otherwise(text)
    return text
