import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from conftest_texts import ODD
from hingeworks.llm import chunk_bpe, encoder
from hingeworks.llm.encoder import Encoder, PieceTable
from hingeworks.llm.hash_table import HashTable
from hingeworks.llm.queries import QUERIES

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
TOOLS = {name: Encoder(public_tokenizers.path(name), flag) for name, flag in FILES}


def library(tool, texts):
    return [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,flag", FILES)
def test_equals_the_library_on_odd_texts(name, flag):
    tool = TOOLS[name]
    for texts in (ODD, *[[t] for t in ODD]):
        got = tool.encode(texts)
        assert [got.of(i).tolist() for i in range(len(texts))] == library(tool, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'’stlmd\n\t .,!09éßΣİ漢́\xa0 <|>\x00-"), max_size=40),
                min_size=1, max_size=4))
def test_equals_the_library_on_random_texts(texts):
    for tool in TOOLS.values():
        got = tool.encode(texts)
        assert [got.of(i).tolist() for i in range(len(texts))] == library(tool, texts)


def test_table_finds_what_it_holds_and_grows_its_pool():
    table = PieceTable()
    hashes = np.unique(np.random.default_rng(0).integers(1, 1 << 63, 5000).astype(np.uint64))
    sizes, checks = np.arange(len(hashes)) % 9, np.arange(len(hashes), dtype=np.uint32) * np.uint32(7)
    table.add(hashes, [[n, n + 1] for n in range(len(hashes))], sizes, checks)
    runs = table.find(hashes)
    assert table.pool[runs >> 16].tolist() == list(range(len(hashes)))
    assert len(table.differing(runs, sizes, checks)) == 0
    checks[3] += 1
    sizes[17] += 1
    assert table.differing(runs, sizes, checks).tolist() == [3, 17]
    assert (table.find(hashes + np.uint64(1)) < 0).all()
    small = HashTable(8)  # collisions
    small.put(np.array([8, 16, 24], np.uint64), np.array([1, 2, 3]))
    assert small.find(np.array([24, 8, 16, 32], np.uint64)).tolist() == [3, 1, 2, -1]


def test_chunks_are_reused_and_joins_repaired():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(3000))
    texts = [f"start {i} {passage} 's end{i}" for i in range(6)]
    tool = chunk_bpe.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tool.encode(texts)
    assert tool.reused > 4 * tool.encoded // 2
    assert [x.tolist() for x in ids] == library(TOOLS["byte_bpe_50k.json"], texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z's\n .,9é"), max_size=300), min_size=1, max_size=3))
def test_any_cut_is_repaired(texts):
    tool = chunk_bpe.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    real, chunk_bpe.chunk_list = chunk_bpe.chunk_list, lambda t: [t[i:i + 17] for i in range(0, len(t), 17)]
    try:
        ids = tool.encode(texts)
    finally:
        chunk_bpe.chunk_list = real
    assert [x.tolist() for x in ids] == library(TOOLS["byte_bpe_50k.json"], texts)


LONG = "".join(chr(0x4E00 + n * 7919 % 20000) + "，" * (n % 12 == 0) for n in range(100_000))[:100_000]


def test_a_piece_of_any_number_of_ids():
    table, lengths = PieceTable(), [3, 65_534, 65_535, 65_536, 200_000, 1]
    hashes = np.arange(1, len(lengths) + 1, dtype=np.uint64)
    sizes, checks = np.arange(6), np.arange(6, dtype=np.uint32)
    table.add(hashes, [[n] * length for n, length in enumerate(lengths)], sizes, checks)
    assert len(table.differing(table.find(hashes), sizes, checks)) == 0
    places, found = table.spans(table.find(hashes))
    assert found.tolist() == lengths
    for n, (a, length) in enumerate(zip(places, found)):
        assert (table.pool[a:a + length] == n).all()
    for tool in TOOLS.values():
        texts = ["some words", LONG, "more words 漢字"]
        got = tool.encode(texts)
        assert len(got.of(1)) > 1 << 16
        assert [got.of(i).tolist() for i in range(len(texts))] == library(tool, texts)


def test_operators_keep_all_ids_of_a_long_unspaced_run(spark, make_folder):
    texts = [LONG, "some words", LONG.replace("，", "")]
    folder = make_folder([(n, t, None, "s", len(t), None, None) for n, t in enumerate(texts)])
    byte, word = (library(TOOLS[name], texts) for name, _ in FILES)

    def rows(name):
        return QUERIES[name](spark, folder).collect()

    assert {r.doc_id: r.ids_sha256 for r in rows("op1_chunk_bpe")} == {
        n: hashlib.sha256(brute.id_bytes(ids)).hexdigest() for n, ids in enumerate(byte)}
    pieces = {n: [[*ids, 1][a:a + 4096] for a in range(0, len(ids) + 1, 4096)] for n, ids in enumerate(word)}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in rows("op6_vector_packing")} == {
        (n, k): (len(x), zlib.crc32(brute.id_bytes(x))) for n, own in pieces.items() for k, x in enumerate(own)}
    assert {r.tokenizer: r.n_tokens for r in rows("op7_token_rollups")} == {
        name.removesuffix(".json"): sum(map(len, ids)) + len(texts) for (name, _), ids in zip(FILES, (byte, word))}
    assert {r.doc_id: r.ids_crc32 for r in rows("op8_token_files")} == {
        n: zlib.crc32(brute.id_bytes([*ids, 2])) for n, ids in enumerate(word)}


def test_more_distinct_pieces_than_the_table_holds(monkeypatch):
    monkeypatch.setattr(encoder, "MOST_PIECES", 50)
    texts = ["few words", " ".join(f"{n} w{n} é{n}’s" for n in range(400)), "<|endoftext|>", "few words again", *ODD]
    for name, flag in FILES:
        tool = Encoder(public_tokenizers.path(name), flag)
        for _ in range(2):
            got = tool.encode(texts, with_pieces=True)
            assert tool.table.held <= 50
            assert [got.of(i).tolist() for i in range(len(texts))] == library(tool, texts)
            for i, (places, before) in enumerate(got.pieces):
                assert len(places) == len(before) and (np.diff(places) > 0).all()
    tool = chunk_bpe.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    tool.tool = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    assert [x.tolist() for x in tool.encode(texts)] == library(TOOLS["byte_bpe_50k.json"], texts)
