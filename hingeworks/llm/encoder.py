"""Token ids of many texts by a public tokenizer file, each distinct piece encoded once.

The ``tokenizers`` library never joins characters across its pre-token borders.
So texts are cut at such borders with numpy, every distinct piece is encoded by
the library once per Python worker, and texts are put together from a table of
pieces. Where the borders are not plain (a word with an apostrophe or a
character outside the plain set below) the whole word is one piece; a text with
a special token, unusual white space or an unusual control character goes to
the library as it is.
"""

from __future__ import annotations

import os
import unicodedata
from dataclasses import dataclass

import numpy as np

from hingeworks.llm.hash_table import HashTable
from hingeworks.llm.text import heavy_state, span_checks, span_hashes, worker_state

SLOTS = 1 << 21
MOST_PIECES = 1 << 20
_LONG = 0xFFFF  # the length of a run that begins with its true length
_SENTINEL = "\U0010ffff"
_EDGE, _SPACE, _LETTER, _DIGIT, _OTHER, _ODD, _WHOLE = range(7)

# Scripts whose letters the library's normaliser maps one to one.
PLAIN_LETTERS = ((0xC0, 0x24F), (0x391, 0x3CE), (0x410, 0x44F), (0x4E00, 0x9FFF))
# The special tokens of the two public files.
SPECIAL = ("<|endoftext|>", "<|startoftext|>")


def _plain(c: str) -> bool:
    return (
        unicodedata.category(c)[0] == "L"
        and unicodedata.normalize("NFC", c) == c
        and len(c.lower()) == 1
        and c not in "İΣςσ"
    )


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point."""
    kinds = np.full(0x110000, _ODD, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cs"):
            kinds[c] = _WHOLE
    kinds[[9, 10, 13, 32]] = _SPACE
    kinds[33:127] = _OTHER
    kinds[ord("'")] = _ODD
    kinds[48:58] = _DIGIT
    for first, last in ((65, 90), (97, 122), *PLAIN_LETTERS):
        for c in range(first, last + 1):
            if _plain(chr(c)):
                kinds[c], lower[c] = _LETTER, ord(chr(c).lower())
    kinds[ord(_SENTINEL)] = _EDGE
    return kinds, lower


@dataclass
class Encoded:
    """Ids of several texts one after another, and their pieces where asked for."""

    ids: np.ndarray
    offsets: np.ndarray
    pieces: list[tuple[np.ndarray, np.ndarray]] | None = None

    def of(self, text: int) -> np.ndarray:
        return self.ids[self.offsets[text]: self.offsets[text + 1]]


class PieceTable(HashTable):
    """From piece hash to a run of ids: ``place << 16 | length`` in the pool.

    A run of ``_LONG`` ids or more is marked by that length; the pool has its true
    length at ``place`` and its ids after it. The two numbers before ``place`` are the
    piece's length and a check, which a hit is compared with.
    """

    def __init__(self):
        super().__init__(SLOTS)

    def clear(self):
        super().clear()
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def add(self, hashes: np.ndarray, ids: list[list[int]], sizes: np.ndarray, checks: np.ndarray):
        """Keep new distinct hashes of pieces with these lengths and checks."""
        marks = zip(sizes.tolist(), checks.tolist())
        ids = [[*mark, *run] if len(run) < _LONG else [*mark, len(run), *run] for mark, run in zip(marks, ids)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        flat = np.fromiter((i for run in ids for i in run), np.uint32, total)
        self.pool[self.used: self.used + total] = flat
        places = self.used + np.cumsum(lengths) - lengths + 2
        self.put(hashes, places << 16 | np.minimum(lengths - 2, _LONG))
        self.used += total

    def differing(self, runs: np.ndarray, sizes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Which of the found runs are those of another piece with the same hash."""
        places = runs >> 16
        return np.flatnonzero((self.pool[places - 2] != sizes) | (self.pool[places - 1] != checks))

    def spans(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the ids of found runs."""
        places, lengths = runs >> 16, runs & 0xFFFF
        long = np.flatnonzero(lengths == _LONG)
        lengths[long] = self.pool[places[long]]
        places[long] += 1
        return places, lengths


class Encoder:
    """``byte_level``: pieces keep white space (the byte-level file); else it is dropped."""

    def __init__(self, path: str, byte_level: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.byte_level = byte_level
        self.alphabet = {b: c for c, b in byte_letters().items()}
        self.kinds, self.lower = worker_state("code_points", _tables)
        self.table = PieceTable()

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in found]

    def _piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that are one pre-token each: straight from the library's model."""
        model = self.library.model
        if not self.byte_level:
            pieces = [p.lower() for p in pieces]
        pieces = [p.encode().decode("latin-1").translate(self.alphabet) for p in pieces]
        return [[token.id for token in model.tokenize(p)] for p in pieces]

    def _piece_starts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        solid = kinds >= _LETTER
        after = np.zeros_like(solid)
        after[1:] = solid[:-1]
        first = solid & ~after  # first character of a word
        starts = first.copy()
        change = solid & after
        change[1:] &= kinds[1:] != kinds[:-1]
        if not self.byte_level:
            change |= solid & (kinds == _DIGIT)
        odd = np.flatnonzero(kinds == _ODD)
        if len(odd):
            word = np.cumsum(first)
            whole = np.zeros(word[-1] + 1, bool)
            whole[word[odd]] = True
            change &= ~whole[word]
        starts |= change
        space = kinds == _SPACE
        if not self.byte_level:
            return starts | space | (kinds == _EDGE)
        before = np.zeros_like(first)  # white space right before a word
        before[:-1] = first[1:] & space[:-1]
        run = space.copy()
        run[1:] &= ~space[:-1]
        joined = np.zeros_like(first)
        joined[1:] = first[1:] & (codes[:-1] == 32)
        return (starts & ~joined) | run | before | (kinds == _EDGE)

    def encode(self, texts: list[str], with_pieces: bool = False) -> Encoded:
        """``with_pieces``: per text the characters and ids before each of its pieces."""
        if not texts:
            return Encoded(np.zeros(0, np.uint32), np.zeros(1, np.int64), [] if with_pieces else None)
        return self._encoded(texts, with_pieces, {i for i, t in enumerate(texts) if any(s in t for s in SPECIAL)})

    def _encoded(self, texts: list[str], with_pieces: bool, whole: set[int]) -> Encoded:
        """``whole``: texts that the library gets as they are."""
        while True:
            parts = ["" if i in whole else t for i, t in enumerate(texts)]
            joined = _SENTINEL.join(parts) + _SENTINEL
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = self.kinds[codes]
            edges = np.flatnonzero(kinds == _EDGE)
            if len(edges) != len(texts):  # the sentinel occurs in a text
                whole |= {i for i, t in enumerate(parts) if _SENTINEL in t}
                continue
            more = np.flatnonzero(kinds == _WHOLE)
            if not len(more):
                break
            whole |= set(np.searchsorted(edges, more).tolist())
        mask = self._piece_starts(codes, kinds)
        starts = np.flatnonzero(mask)
        ends = np.append(starts[1:], len(codes))
        kept = kinds[starts] >= (_SPACE if self.byte_level else _LETTER)
        starts, ends = starts[kept], ends[kept]
        symbols = codes if self.byte_level else self.lower[codes]
        odd = np.concatenate([[0], np.cumsum(kinds == _ODD)])
        hashes, checks = (make(symbols, starts, ends) for make in (span_hashes, span_checks))
        ids, lengths, clash = self._taken(hashes, checks, starts, ends, joined, odd)
        if len(clash):  # different pieces with one hash
            return self._encoded(texts, with_pieces, whole | set(np.searchsorted(edges, starts[clash]).tolist()))
        before = np.concatenate([[0], np.cumsum(lengths)])
        firsts = np.concatenate([[0], np.searchsorted(starts, edges)])
        offsets = before[firsts]
        pieces = None
        if with_pieces:
            opened = np.concatenate([[0], edges + 1])
            pieces = [
                (starts[a:b] - opened[i], before[a:b] - before[a])
                for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:]))
            ]
        if whole:
            ids, offsets = self._with_whole(texts, sorted(whole), ids, offsets)
        return Encoded(ids, offsets, pieces)

    def _taken(self, hashes, checks, starts, ends, joined, odd) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, how many each has, and pieces whose hash is another's."""
        runs = self._runs(hashes, checks, starts, ends, joined, odd)
        if runs is None:  # slices of so few pieces that the table holds each
            cuts = range(0, len(hashes), MOST_PIECES)
            parts = [self._taken(*(x[a: a + MOST_PIECES] for x in (hashes, checks, starts, ends)), joined, odd)
                     for a in cuts]
            ids, lengths, clash = zip(*parts)
            return (np.concatenate(ids), np.concatenate(lengths),
                    np.concatenate([a + own for a, own in zip(cuts, clash)]))
        clash = self.table.differing(runs, ends - starts, checks)
        found, lengths = self.table.spans(runs)
        before = np.cumsum(lengths) - lengths
        places = np.repeat(found - before, lengths) + np.arange(lengths.sum())
        return self.table.pool[places], lengths, clash

    def _runs(self, hashes, checks, starts, ends, joined, odd) -> np.ndarray | None:
        """The table's entries for the pieces; None where it cannot hold them all at once."""
        runs = self.table.find(hashes)
        missing = np.flatnonzero(runs < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.table.held + len(new) > MOST_PIECES:
                missing = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
                if len(new) > MOST_PIECES:
                    return None
                self.table.clear()
            at = missing[first]
            plain = odd[ends[at]] == odd[starts[at]]
            for few, make in ((plain, self._piece_ids), (~plain, self._library_ids)):
                own = at[few]
                self.table.add(new[few], make([joined[a:b] for a, b in zip(starts[own], ends[own])]),
                               ends[own] - starts[own], checks[own])
            runs[missing] = self.table.find(hashes[missing])
        return runs

    def _with_whole(self, texts, whole, ids, offsets):
        parts, lengths, position = [], np.diff(offsets), 0
        found = self._library_ids([texts[i] for i in whole])
        for i, own in zip(whole, found):
            parts += [ids[position: offsets[i]], np.array(own, np.uint32)]
            position, lengths[i] = offsets[i], len(own)
        parts.append(ids[position:])
        return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def encoder(path: str, byte_level: bool) -> Encoder:
    """This worker's encoder for a file."""
    return heavy_state("encoder", path, lambda: Encoder(path, byte_level))


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_strings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes of all ids one after another, their offsets)`` of a byte-level file."""

    def make():
        from tokenizers import Tokenizer

        letters = byte_letters()
        tokens = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        made = [b""] * (max(tokens.values()) + 1)
        for token, place in tokens.items():
            made[place] = bytes(letters[c] for c in token)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])])
        return np.frombuffer(b"".join(made), np.uint8), offsets

    return worker_state(f"bytes {path}", make)
