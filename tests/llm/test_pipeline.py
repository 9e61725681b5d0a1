import __spark_entry__ as entry_points
import brute
import corpus_pipeline
import numpy as np

from hingeworks.llm import near_dup
from hingeworks.llm.tables import written


def test_stages_keep_columns_and_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "near duplicates", "secret scan", "vector packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), "stage")
        if name != "vector packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
        if name == "near duplicates":
            assert near_dup.near_duplicates(docs).where("not kept").count() == 0
    run = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_secrets_are_replaced(spark):
    docs = spark.createDataFrame(
        [(1, "x token = abcdef0123456 y", 25, "a"), (2, "plain", 5, None), (None, None, None, None)],
        "doc_id long, text string, n_chars int, spans string")
    rows = corpus_pipeline.redact_secrets(spark, docs, "").collect()
    assert [tuple(r) for r in rows] == [(1, "x [secret] y", 12, "a"), (2, "plain", 5, None), (None,) * 4]


def test_near_copies_keep_one_row(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text), (3, text), (3, text), (9, "other words"), (None, text), (None, None)],
                                 "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "9", "None", "None"]


def test_empty_and_odd_tables(spark, empty_folder, odd_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
    assert corpus_pipeline.run(spark, odd_folder).count() >= 0


def test_registered(spark):
    assert "pipeline" in entry_points.queries()
    assert sum(q.startswith("op") for q in entry_points.queries()) >= 10


def near_copies_kept(texts, percent):
    """Smallest ids of the groups of ``{id: text}``, by comparing all pairs."""
    sets, name = {i: brute.shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return set(name.values())


def test_near_copies_from_0_8_go(spark):
    texts = {}
    for n in range(30):  # similarity (180 - t) / (180 + t) for t other words: 0.8 for 20
        own = [f"a{n}w{k}" for k in range(184)]
        other = 5 + n
        texts[10 * n] = " ".join(own)
        texts[10 * n + 1] = " ".join(own[:184 - other] + [f"b{n}w{k}" for k in range(other)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == near_copies_kept(texts, 80)
    found = near_dup.near_duplicates(docs).where("kept").collect()
    assert {r.doc_id for r in found} == near_copies_kept(texts, 85)
    assert len(found) > len(kept)


def test_sketch_margin_follows_the_threshold():
    sets = [np.arange(0, 180, dtype=np.uint64), np.arange(20, 200, dtype=np.uint64)]  # 0.8
    sketches = np.zeros((2, 8), np.uint64)
    sketches[1, 0], sketches[1, 1] = ~np.uint64(0), np.uint64((1 << 22) - 1)  # 86 bits: once in 10^6 pairs
    assert list(near_dup.forest(sketches, sets, np.zeros(2), 80)) == [(0, 1)]
    assert int(near_dup.sketch_limit(near_dup.margin_similarity(85))) == 74

def test_rows_of_one_id_with_different_texts(spark, make_folder, corpus):
    """One row of an id stays, that with the smallest text, whatever the order of the rows."""
    import corpus_pipeline

    texts = {5: ["b b b b b b b", "a a a a a a a", None], 6: ["x y z", "x y z"], None: ["q", "q"]}
    rows = [(i, t, str(n), None, 0, None, n) for i, own in texts.items() for n, t in enumerate(own)]
    kept = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")
        found = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
        assert found.columns == docs.columns
        kept.append(sorted((tuple(r) for r in found.collect()), key=str))
    assert kept[0] == kept[1] and [r[1] for r in kept[0]] == ["a a a a a a a", "x y z", "q", "q"]
