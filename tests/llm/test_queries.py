"""Every registered text query on a small fixture against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from hingeworks.llm.backoff_lm import STRENGTH
from hingeworks.llm.queries import QUERIES

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
# Queries with one row per document.
PER_DOCUMENT = [q for q in QUERIES if not q.startswith(("op6", "op7", "op11", "op12"))]


def ids_of(tool, text):
    return tool.encode(text or "", add_special_tokens=False).ids


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def by_id(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    return {r.doc_id: r for r in rows}


def test_op1_equals_the_library(spark, folder):
    found = by_id(spark, folder, "op1_chunk_bpe")
    for i, text in documents(spark, folder):
        ids = ids_of(BYTE, text)
        decoded = BYTE.decode(ids, skip_special_tokens=False)
        assert tuple(found[i]) == (i, len(ids), hashlib.sha256(brute.id_bytes(ids)).hexdigest(),
                                   brute.sha256(decoded))


def test_op3_base_spans(spark, folder):
    found = by_id(spark, folder, "op3_secret_scan")
    for i, text in documents(spark, folder):
        expected = brute.base_secrets(text)
        assert found[i].base_sha256 == brute.sha256(expected)
        spans = [s for s in found[i].spans.split(",") if s]
        assert [s for s in spans if not s.startswith("entropy")] == [s for s in expected.split(",") if s]
        assert found[i].spans == brute.all_secrets(text)


def test_op4_equals_a_dictionary_model(spark, folder):
    found = by_id(spark, folder, "op4_backoff_lm")
    rows = documents(spark, folder)
    for (i, _), expected in zip(rows, brute.language_model(rows, STRENGTH)):
        assert tuple(found[i])[1:5] == expected[:4]
        assert tuple(found[i])[5:] == pytest.approx(expected[4:], rel=1e-9)


def test_op5_equals_all_pairs(spark, folder):
    found = by_id(spark, folder, "op5_near_duplicates")
    expected = brute.components(dict(documents(spark, folder)))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in found.items())
    assert sum(not r.kept for r in found.values()) > 10


def test_op6_pieces_fill_few_sequences(spark, folder):
    rows = QUERIES["op6_vector_packing"](spark, folder).collect()
    texts = dict(documents(spark, folder))
    for i, text in texts.items():
        ids, at = [*ids_of(WORD, text), 1], 0
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        for number, r in enumerate(own):
            assert (r.piece, r.start) == (number, at)
            assert r.ids_crc32 == zlib.crc32(brute.id_bytes(ids[at:at + r.length]))
            assert r.length == 4096 or r is own[-1]
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [o for o, _ in places] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op7_totals(spark, folder):
    firsts, expected = {}, {}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    for r in sorted(rows, key=lambda r: r.doc_id):
        firsts.setdefault(r.text or "", r)
    for text, r in firsts.items():
        for name, tool in (("byte_bpe_50k", BYTE), ("word_bpe_49k", WORD)):
            n = expected.setdefault((r.source, r.lang, name), [0, 0])
            n[0] += 1
            n[1] += len(ids_of(tool, text)) + 1
    found = QUERIES["op7_token_rollups"](spark, folder).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in found} == expected


def test_op8_files_give_the_ids_back(spark, folder):
    found = by_id(spark, folder, "op8_token_files")
    start = 0
    for i, text in sorted(documents(spark, folder)):
        ids = [*ids_of(WORD, text), 2]
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(brute.id_bytes(ids)))
        start += len(ids)


def test_op9_edited_texts_and_likeness(spark, folder):
    found = by_id(spark, folder, "op9_imatch")
    rows = sorted(documents(spark, folder), reverse=True)
    seen = {}
    for n, (i, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        gone = len(text) // 3
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (
            len(text), brute.sha256(text[:len(text) - gone] + following[:gone]))
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    # Neighbours among the first rows are no copies of each other.
    long = [found[i] for i, t in rows if len(t or "") > 400 and i < 3 * 70]
    assert len(long) > 10 and np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_op10_base_counts(spark, folder):
    found = by_id(spark, folder, "op10_quality_rules")
    for i, text in documents(spark, folder):
        assert tuple(found[i])[1:7] == brute.quality_base(text)
        assert not (found[i].kept and found[i].base_failed)


def test_op2_scores(spark, folder):
    found = by_id(spark, folder, "op2_toxicity")
    for i, _ in documents(spark, folder):
        r = found[i]
        assert r.held_out == (brute.remainder(i) == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_null_ids_and_repeated_rows(spark, odd_folder, name):
    rows = QUERIES[name](spark, odd_folder).collect()
    if name in PER_DOCUMENT:
        given = [i for i, _ in documents(spark, odd_folder)]
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, given))
    if name.startswith("op5"):
        repeated = [r for r in rows if sum(q.doc_id == r.doc_id for q in rows) > 1 and r.doc_id is not None]
        assert len({tuple(r) for r in repeated}) == 1
        assert all(r.kept for r in rows if r.doc_id is None)
