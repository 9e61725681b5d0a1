"""Language model scores by a weighted backoff automaton (operator 4).

States are histories: one per word that was seen in training, the start (the end
token of an earlier text), and the empty history. A state has an arc for every
token that followed it in training, with the smoothed log10 probability

    (c(history, token) + STRENGTH * p(token)) / (c(history) + STRENGTH)

and a failure arc to the empty history with weight ``STRENGTH / (c(history) +
STRENGTH)``; the empty history has p(token), the additive estimate of the base
score, for every token, also unseen ones. Probabilities of a state add up to 1.
A text is read once from left to right: the state takes the token's arc or its
failure arc first, and log-probabilities add up.

The counts cover all training documents. They are exchanged as in
``ngram_blocks``: a block of text receives the part of the automaton that its
own texts can reach.

Words are told apart by 64-bit hashes. Defined results: a null or empty text is
one end token. A null id counts as empty text for the split. Equal rows get equal
scores and each counts as often as it comes. Without training documents all
probabilities are 1 (log 0). Other columns are ignored. Texts of any length are
scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hingeworks.llm.ngram_blocks import BLOCK_BYTES, Block, answers, requests, text_blocks, totals_of, unpacked
from hingeworks.llm.tables import written
from hingeworks.llm.text import Segment, cuts, id_remainder, mix, words

STRENGTH = 100.0
END = np.uint64(0x5851F42D4C957F2D)
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def token_hashes(segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents, each ended by END, and the documents' offsets."""
    tokens, counts = [], []
    for first, last in cuts(segment.offsets):
        part = segment.offsets[first: last + 1]
        found = words(Segment(segment.data[part[0]: part[-1]], part - part[0]))
        tokens.append(np.insert(found.hashes, found.firsts[1:], END))
        counts.append(found.counts + 1)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def history_keys(tokens: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it; END stands before a document."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(mix(before) + tokens)


def _counted(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, inverse, np.bincount(inverse, weights=taught, minlength=len(distinct))


def block_keys(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and word pairs of a block with their training counts."""
    tokens, offsets = token_hashes(block.segment)
    taught = np.repeat(block.flags, np.diff(offsets))
    found = []
    for keys in (tokens, history_keys(tokens)):
        distinct, _, counts = _counted(keys, taught)
        found.append((distinct, counts))
    return found


class Automaton:
    """The part of the automaton that a block's tokens can reach.

    ``arcs`` holds the arc weight of a token after its history where there is
    one, ``failures`` the failure weight of each history.
    """

    def __init__(self, singles: np.ndarray, pairs: np.ndarray, total: int, known: int, strength: float):
        self.base = np.log10((singles + 0.5) / (total + 0.5 * (known + 1)))
        self.failures = np.log10(strength / (singles + strength))
        self.singles, self.pairs, self.strength = singles, pairs, strength

    def traverse(self, state: np.ndarray, token: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log-probability of each step from the state before it (a word's place)."""
        count, history = self.pairs[pair], self.singles[state]
        lower = self.base[token]
        arc = np.log10((count + self.strength * 10.0 ** lower) / (history + self.strength))
        return np.where(count > 0, arc, self.failures[state] + lower)


def _score(total: int, known: int, strength: float):
    def run(blocks: pa.Table, answered: pa.Table) -> pa.Table:
        block = unpacked(blocks.to_pylist()[0])
        tokens, offsets = token_hashes(block.segment)
        _, token, _ = _counted(tokens, np.zeros(len(tokens)))
        _, pair, _ = _counted(history_keys(tokens), np.zeros(len(tokens)))
        singles = totals_of(answered, 0).astype(float)
        automaton = Automaton(singles, totals_of(answered, 1).astype(float), total, known, strength)
        end = token[-1]
        state = np.concatenate([[end], token[:-1]])
        steps = automaton.traverse(state, token, pair)
        starts = offsets[:-1]
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()),
            "held_out": pa.array(~block.flags),
            "n_tokens": pa.array(np.diff(offsets)),
            "n_known": pa.array(np.add.reduceat((singles[token] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(starts), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(automaton.base[token], starts)),
            "score": pa.array(np.add.reduceat(steps, starts)),
        })

    return run


def score_documents(docs: DataFrame, held_out_remainder: int = 1, strength: float = STRENGTH,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    taught = id_remainder(F.col("doc_id")) != held_out_remainder
    blocks = written(text_blocks(docs, taught, block_bytes), "blocks")
    # As many buckets as blocks: a bucket holds about as many keys as a block asks for.
    buckets = max(1, blocks.count())
    answered = written(answers(requests(blocks, block_keys, buckets)), "answers")
    words_known = answered.where("kind = 0").agg(
        F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _score(int(words_known[0]), int(words_known[1]), strength), SCORES)
