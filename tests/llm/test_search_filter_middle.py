"""Shared lexical search, URL filter and fill-in-middle against brute force and their SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import brute
from hingeworks.llm import lexical_search, middle, url_filter
from hingeworks.llm.queries import ORACLES, QUERIES, URL_RULES

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=20):
    """Rows of the search: every item against every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = Counter(t for _, c in counted for t in c)
    n = sum(1 for _, c in counted if c)
    words = sum(c.total() for _, c in counted)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in held.items()}
    rows = []
    for item_id, text in set(items):
        scored = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n // words if c else 0
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item_id, place, i, -s) for place, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def read(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("which", ["folder", "odd_folder"])
def test_search_equals_scoring_everything(spark, request, which):
    folder = request.getfixturevalue(which)
    found = rows_of(QUERIES["op11_shared_search"](spark, folder).select("item_id", "rank", "doc_id", "score"))
    expected = ranked(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))
    assert found == expected and len(found) > 60


def test_search_in_blocks_slices_and_small_buffers(spark, folder, monkeypatch):
    whole = rows_of(QUERIES["op11_shared_search"](spark, folder))
    for name, value in (("ITEM_BYTES", 900), ("ROWS", 3), ("BUCKETS", 2)):
        monkeypatch.setattr(lexical_search, name, value)
    assert rows_of(QUERIES["op11_shared_search"](spark, folder)) == whole


def test_terms_do_not_depend_on_slices(monkeypatch):
    text = ("Ünï x-Y " * 50 + "w" * 300 + "-" * 40 + "a1").encode()
    whole = lexical_search.terms_of(text)
    assert {t.decode(): n for t, n in whole.items()} == Counter(terms(text.decode()))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(lexical_search, "SLICE", size)
        assert lexical_search.terms_of(text) == whole


def test_shared_sets_are_summed_once():
    rng = random.Random(3)
    common = [f"c{i}".encode() for i in range(12)]
    items = [Counter(rng.choices(common, k=6) + [f"own{n}".encode()]) for n in range(40)]
    items += [Counter({b"c1": 1, b"c2": 1, b"c3": 1})] * 5 + [Counter()]
    plan = lexical_search.shared_plan(items)
    assert plan.edges < plan.plain_edges
    scored = np.random.default_rng(1).integers(0, 10**9, (len(plan.terms), 7))
    expected = [sum((scored[plan.terms.index(t)] * n for t, n in item.items()), np.zeros(7, np.int64)) for item in items]
    np.testing.assert_array_equal(lexical_search.accumulate(plan, scored), expected)


def url_verdict(url, shared):
    rest = (url or "").split("://", 1)
    host = re.match("[^/?#]*", rest[1])[0] if len(rest) > 1 else ""
    path = re.match("[^?#]*", rest[1][len(host):])[0] if len(rest) > 1 else ""
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    address = re.sub(":(80|443)$", "", host) + re.sub("/$", "", path)
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if len(shared.get(address, ())) > 1 else "allow"


@pytest.mark.parametrize("which", ["folder", "odd_folder"])
def test_url_filter_equals_each_url_on_its_own(spark, request, which):
    folder = request.getfixturevalue(which)
    pages = read(spark, folder, "pages", "page_id", "url")
    shared = {}
    for _, url in pages:
        host, path, *_ = url_verdict(url, {})
        if host + path:
            shared.setdefault(re.sub(":(80|443)$", "", host) + re.sub("/$", "", path), set()).add(url)
    found = QUERIES["op12_url_filter"](spark, folder)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert rows_of(found) == sorted(((i, *url_verdict(u, shared)) for i, u in pages), key=str)
    assert {r.verdict for r in found.where("rule is null").collect()} == {"allow", "block"}


def test_url_filter_keeps_other_columns_and_any_filter_size(spark, monkeypatch):
    rng = random.Random(5)
    hosts = ["".join(rng.choices("ab", k=rng.randint(1, 2))) for _ in range(20)]
    address = [(f"{rng.choice(hosts)}.{rng.choice(hosts)}", "/" + rng.choice(hosts)) for _ in range(400)]
    rules = sorted({(h.split(".")[1], p[: rng.randint(1, 2)], rng.choice(["allow", "block"])) for h, p in address[:25]})
    pages = spark.createDataFrame([(n, f"http://{h}{p}", "x") for n, (h, p) in enumerate(address)],
                                  "page_id long, url string, verdict string").withColumnRenamed("page_id", "salt")
    listed = spark.createDataFrame([(h + p,) for h, p in address[:50]] + [(None,)], "address string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    expected = []
    for n, (h, p) in enumerate(address):
        fits = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        verdict = max(fits)[3] if fits else "block" if h + p in {x + y for x, y in address[:50]} else "allow"
        expected.append((n, max(fits)[2] if fits else None, verdict))
    for blocks, bits in ((1, 12), (1 << 15, 12), (1 << 15, 1)):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
        monkeypatch.setattr(url_filter, "BITS_PER_KEY", bits)
        found = url_filter.judge(pages, table, listed)
        assert found.columns == ["salt", "url", "host", "path", "rule", "verdict"]
        assert rows_of(found.select("salt", "rule", "verdict")) == sorted(expected, key=str)
    empty = url_filter.judge(pages, table.limit(0), listed.limit(0))
    assert {(r.rule, r.verdict) for r in empty.collect()} == {(None, "allow")}


def test_the_filter_passes_all_listed_and_few_other_keys(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    bloom = url_filter.BlockedBloom(keys, 3000)
    every = spark.range(12000).selectExpr("id", "concat('k', id) as key")
    passed = [r.id for r in every.where(bloom.passes(every.key)).collect()]
    assert set(range(3000)) <= set(passed) and len(passed) < 3000 + 9000 * 0.03


def filled(doc_id, text):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, mid, suffix = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(lines), "plain", None, None, brute.sha256(text), brute.sha256(text)
    spm = h4 % 100 < 50
    output = f"<S>{suffix}<P>{prefix}<M>{mid}" if spm else f"<P>{prefix}<S>{suffix}<M>{mid}"
    return (doc_id, len(lines), "spm" if spm else "psm", len(prefix), len(mid), brute.sha256(output), brute.sha256(text))


MIDDLES = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é\r\n漢\n😀", "a<P>b\nc", "<S", "P>\n<M\n>", "x\n" * 5000,
           "ü" * 70_000, ("y" * 9000 + "\n") * 30, "a<M>\n" + "b\n" * 20_000]


@pytest.mark.parametrize("size", [1, 5, 16384])
def test_fill_in_middle_equals_cutting_lists_of_lines(spark, size):
    rows = [(n * 7 + k, t) for n, t in enumerate(MIDDLES) for k in range(5)] + [(None, "a\nb\nc"), (None, None), (0, "q"), (0, "q")]
    docs = spark.createDataFrame([(i, t, "output", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    stored = docs.select("doc_id", middle.store(docs.text, size).alias("s"))
    found = stored.select("doc_id", middle.fill_in_middle(stored.s, stored.doc_id).alias("f"))
    text = middle.restored(found.f["output"], found.f["form"])
    got = [(r.doc_id, r.f.n, r.f.form, r.f.prefix_chars, r.f.middle_chars, r.f.output_sha256, brute.sha256(r.text))
           for r in found.select("doc_id", "f", text.alias("text")).collect()]
    assert sorted(got, key=str) == sorted((filled(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_unpack_only_the_frames_that_hold_them(spark):
    import zstandard

    parts = [b"".join(b"%d %d\n" % (n, i) for i in range(50)) for n in range(40)]
    packed = [zstandard.ZstdCompressor().compress(p) for p in parts]
    frames = middle.Frames([50 * (n + 1) for n in range(40)], np.cumsum([len(p) for p in parts]).tolist(),
                           np.cumsum([len(p) for p in packed]).tolist(), b"".join(packed))
    seen, unpack = [], frames.unpack
    frames.unpack = lambda data: seen.append(1) or unpack(data)
    whole = b"".join(parts).decode()
    for units in (0, 50, 777, 778, 1000, 1999, 2000):
        frame, at, chars = frames.cut(units)
        assert whole[:chars].count("\n") == units and (chars == 0 or whole[chars - 1] == "\n")
    assert len(seen) == 2  # the frames of 777 and of 1999


def test_fill_in_middle_query_and_rates(spark, folder):
    found = QUERIES["op13_fill_in_middle"](spark, folder)
    assert rows_of(found) == sorted((filled(*r) for r in read(spark, folder, "documents", "doc_id", "text")), key=str)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stored = docs.select("doc_id", middle.store(docs.text).alias("s"))
    for rates, forms in ((middle.Rates(0), {"plain"}), (middle.Rates(100, 0), {"plain", "psm"}), (middle.Rates(100, 100), {"plain", "spm"})):
        rows = stored.select(middle.fill_in_middle(stored.s, stored.doc_id, rates)["form"].alias("form")).distinct()
        assert {r.form for r in rows.collect()} == forms


@pytest.mark.parametrize("name", [n for n in ORACLES if n in QUERIES])
def test_sql_gives_the_same_rows(spark, odd_folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd_folder}/{table}.parquet/*.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    found = QUERIES[name](spark, odd_folder).select(*columns)
    assert rows_of(found) == sorted(result.fetchall(), key=str)
