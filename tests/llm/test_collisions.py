"""Strings that meet under polynomial hashes modulo a power of two, in all operators that hash spans."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
from hingeworks.llm import encoder as encoders, near_dup, quality, text as texts
from hingeworks.llm.queries import QUERIES

LENGTHS = (1024, 2048, 4096, 8192)
FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}


def pair(length, letters="ab"):
    """The Thue-Morse word of a length, and the same with its letters changed over."""
    bits = [bin(i).count("1") & 1 for i in range(length)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_spans_and_checks_differ():
    for length in LENGTHS:
        symbols = np.frombuffer("".join(pair(length)).encode(), np.uint8)
        for make in (texts.span_hashes, texts.span_checks):
            a, b = make(symbols, np.array([0, length]), np.array([length, 2 * length]))
            assert a != b


def test_a_hash_depends_on_the_span_alone(monkeypatch):
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 1 << 21, 5000)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 900, 300)
    whole = texts.span_hashes(symbols, starts, ends)
    for a, b, h in zip(starts[:40], ends[:40], whole):
        own = symbols[a:b]
        assert texts.span_hashes(own, np.array([0]), np.array([len(own)]))[0] == h
        moved = np.concatenate([rng.integers(0, 9, 77), own])
        assert texts.span_hashes(moved, np.array([77]), np.array([77 + len(own)]))[0] == h
    # A long array is worked through in steps.
    monkeypatch.setattr(texts, "_STEP", 64)
    texts.worker_state("powers", dict)
    held = texts.worker_state
    monkeypatch.setattr(texts, "worker_state", lambda name, make: make())
    np.testing.assert_array_equal(texts.span_hashes(symbols, starts, ends), whole)
    monkeypatch.setattr(texts, "worker_state", held)


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("weak", [False, True])
def test_ids_of_such_pieces(file, weak, monkeypatch):
    """Also where all hashes are equal: the check then finds the difference."""
    if weak:
        monkeypatch.setattr(encoders, "span_hashes", lambda symbols, starts, ends: np.ones(len(starts), np.uint64))
    path = public_tokenizers.path(file)
    library, own = Tokenizer.from_file(path), encoders.Encoder(path, FILES[file])
    for length in LENGTHS:
        rows = [*pair(length), " ".join(pair(length)), *pair(length, "xy")]
        got = own.encode(rows)
        assert [got.of(i).tolist() for i in range(5)] == [
            library.encode(t, add_special_tokens=False).ids for t in rows]


@pytest.fixture(scope="module")
def hostile_folder(make_folder):
    rows = []
    for n, length in enumerate(LENGTHS):
        a, b = pair(length)
        for k, text in enumerate([a, b, f"{a} {b}", f"{a}\n{b}\n{a}", f"one two three four {a}", f"one two three four {b}"]):
            rows.append((10 * n + k, text, "en", "s", len(text), None, None))
    return make_folder(rows, [(0, 1, 0), (1, 0, 1), (2, 1, 1), (3, 0, 0)])


def test_operators_on_such_texts(spark, hostile_folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{hostile_folder}/documents.parquet").collect()}
    tools = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in FILES}

    def rows(name):
        return {r.doc_id: r for r in QUERIES[name](spark, hostile_folder).collect()}

    def ids(name, i):
        return tools[name].encode(docs[i], add_special_tokens=False).ids

    op1, op8, op10, op5 = (rows(n) for n in (
        "op1_chunk_bpe", "op8_token_files", "op10_quality_rules", "op5_near_duplicates"))
    expected = brute.components(docs)
    for i, text in docs.items():
        assert op1[i].ids_sha256 == __import__("hashlib").sha256(brute.id_bytes(ids("byte_bpe_50k.json", i))).hexdigest()
        assert op8[i].ids_crc32 == __import__("zlib").crc32(brute.id_bytes([*ids("word_bpe_49k.json", i), 2]))
        assert tuple(op10[i])[1:7] == brute.quality_base(text)
        assert (op5[i].n_shingles, op5[i].component_id) == expected[i]
    lm = rows("op4_backoff_lm")
    expected = brute.language_model(list(docs.items()), __import__("hingeworks.llm.backoff_lm", fromlist=["x"]).STRENGTH)
    for (i, _), row in zip(docs.items(), expected):
        assert tuple(lm[i])[1:5] == row[:4] and tuple(lm[i])[5:] == pytest.approx(row[4:], rel=1e-9)


def test_links_of_ids_with_two_texts(spark):
    """Each text of an id links its own near copy."""
    rng = np.random.default_rng(4)
    rows, copies = [], []
    for i in range(40):
        for k in range(2):
            words = [f"w{rng.integers(0, 10**6)}" for _ in range(200)]
            rows.append((i, " ".join(words)))
            words[rng.integers(0, 200)] = "other"
            copies.append((1000 + 2 * i + k, " ".join(words)))
    frame = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame).collect()}
    assert all(found[1000 + 2 * i + k] == i for i in range(40) for k in range(2))


def test_base_counts_of_such_lines():
    a, b = pair(1024)
    counts = quality.segment_counts
    assert counts is not None and brute.quality_base(f"{a}\n{b}")[3] == 0


def test_held_out_labels_teach_nothing(spark, make_folder, corpus):
    """The same scores whatever the labels of the rows that are held out."""
    found = []
    for flip in (0, 1):
        labels = [(i, 1, (n % 3 == 0) ^ (flip if brute.remainder(i) == 0 else 0)) for n, (i, *_) in enumerate(corpus)]
        folder = make_folder(corpus, [(i, q, int(t)) for i, q, t in labels])
        found.append(sorted((r.doc_id, r.score) for r in QUERIES["op2_toxicity"](spark, folder).collect()))
    assert found[0] == found[1]


def test_an_id_with_two_labels_has_the_smaller(spark, make_folder, corpus):
    both = [(i, 1, int(n % 3 == 0)) for n, (i, *_) in enumerate(corpus)]
    first = make_folder(corpus, both)
    second = make_folder(corpus, [*both, *((i, 1, 1) for i, _, t in both if t == 0)])
    a, b = ([(r.doc_id, r.score) for r in sorted(QUERIES["op2_toxicity"](spark, f).collect())] for f in (first, second))
    assert a == b


def test_an_empty_batch_replaces_what_was_there(spark, tmp_path):
    from hingeworks.llm import rollups

    row = ("insert", "s", "en", "t", 5, None, None, None, None)
    changes = spark.createDataFrame([row], rollups.CHANGES)
    store = str(tmp_path / "store")
    rollups.commit(changes, store, 1)
    rollups.commit(changes, store, 2)
    rollups.commit(changes.limit(0), store, 1)
    assert [tuple(r) for r in rollups.totals(spark, store).collect()] == [("s", "en", "t", 1, 5)]
    rollups.commit(changes.limit(0), store, 2)
    assert rollups.totals(spark, store).count() == 0
