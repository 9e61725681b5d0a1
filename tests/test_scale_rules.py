"""Rules that hold whatever the size: equal ids, far points, splits, wide vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hingeworks.functions.kernels import GAUSSIAN
from hingeworks.functions.keyed import uniform
from hingeworks.models import KernelModel
from hingeworks.operators import blocks, feature_maps, kernel_ops, parts as part_ops
from hingeworks.operators.kernel_ops import kernel_scores
from hingeworks.operators.predict import predict, predict_vector
from hingeworks.operators import sampling
from hingeworks.operators.metrics import auroc
from hingeworks.operators.sampling import minibatch
from hingeworks.plans import descent
from hingeworks.plans.linear import train_pegasos
from hingeworks.plans.sweep import step_settings, sweep
from hingeworks.sources.labeled_text import read_labeled_text


@pytest.fixture(scope="module")
def support(make_points, blob):
    ids, labels, cells = blob
    points = make_points(zip(ids[:30], labels[:30], cells[:30]), 2)
    return points.select("id", (F.col("label") * 2 - 1).alias("y"), "features",
                         F.lit(1.0).alias("alpha"))


@pytest.fixture
def small_parts(monkeypatch):
    """Bounds under which thirty rows of five features are many parts and slices."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3 * 40)
    monkeypatch.setattr(part_ops, "PART_BYTES", 7 * 40)
    monkeypatch.setattr(part_ops, "VALUE_BYTES", 8 * 6 * 4)
    monkeypatch.setattr(kernel_ops, "HELD_BYTES", 11 * 40)


def counted(points):
    """The same points, and a counter of the rows that are read of them."""
    seen = points.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return points.mapInArrow(count, points.schema), seen


def test_equal_ids_keep_their_own_kernel_scores(make_points, blob, support, small_parts):
    points = make_points([(7, 1.0, x) for x in blob[2][:9]], 3)
    model = KernelModel(support, GAUSSIAN, 3.0, False).without_threshold()
    rows = support.collect()
    cells, factors = np.array([r.features for r in rows]), np.array([r.y * r.alpha for r in rows])
    expected = sorted(GAUSSIAN.block(blob[2][:9], cells) @ factors / 3.0)
    assert len(part_ops.broadcast_parts(support.withColumnRenamed("y", "label")).held.parts) > 4
    scored = predict(points, model, "s")
    assert scored.columns == [*points.columns, "s"]
    assert sorted(r.s for r in scored.collect()) == pytest.approx(expected, abs=1e-12)
    assert predict_vector(points.sparkSession, model, blob[2][0]) == pytest.approx(
        predict(points.where(F.col("features")[0] == float(blob[2][0][0])), model, "s").first().s)
    none = KernelModel(support.limit(0), GAUSSIAN, 3.0, False, intercept=0.25).without_threshold()
    assert {r.s for r in predict(points, none, "s").collect()} == {0.25}


def test_points_are_read_once_whatever_the_parts(make_points, blob, support, small_parts):
    points, seen = counted(make_points(zip(*blob), 3))
    model = KernelModel(support, GAUSSIAN, 3.0, True).without_threshold()
    assert len(predict(points, model.__class__(support, GAUSSIAN, 3.0).without_threshold(), "s").collect()) == 200
    assert seen.value == 200
    weighted, seen = counted(support.select("id", "y", "features", "alpha"))
    scores = kernel_scores(weighted, make_points(zip(*blob), 3), GAUSSIAN).collect()
    assert len(scores) == 200 and seen.value == 30


def test_many_targets_and_landmarks_go_in_parts(make_points, blob, support, small_parts):
    ids, labels, cells = blob
    values = GAUSSIAN.block(cells, cells)
    own = values.copy()
    np.fill_diagonal(own, 0.0)
    expected = dict(zip(ids.tolist(), (labels[:30] * 2 - 1) @ own[:30]))
    points = make_points(zip(*blob), 3)
    assert {r.id: r.score for r in kernel_scores(support, points, GAUSSIAN).collect()} == pytest.approx(expected)
    rows = {r.id: r.kernel_row for r in feature_maps.gram(points, 200, GAUSSIAN).collect()}
    np.testing.assert_allclose(np.array([rows[i] for i in sorted(rows)]), values, atol=1e-12)


def test_targets_of_one_id_are_never_refused(make_points, blob, support, small_parts):
    points = make_points([(7, 1.0, x) for x in blob[2][:90]], 3)
    scores = sorted(r.score for r in kernel_scores(support.where("id <> 7"), points, GAUSSIAN).collect())
    rows = support.where("id <> 7").collect()
    expected = GAUSSIAN.block(blob[2][:90], np.array([r.features for r in rows])) @ np.array([r.y for r in rows])
    assert scores == pytest.approx(sorted(expected))


def test_nystrom_bound_and_root(make_points, blob, monkeypatch):
    points = make_points(zip(*blob), 3)
    fitted = feature_maps.NystromMap.fit(points, 40)
    gram = GAUSSIAN.block(fitted.landmarks, fitted.landmarks)
    np.testing.assert_allclose(fitted.normalization @ gram @ fitted.normalization, np.eye(40), atol=1e-6)
    monkeypatch.setattr(feature_maps, "MAP_BYTES", 8 * 40 * 44)
    with pytest.raises(ValueError, match="exceed"):
        feature_maps.NystromMap.fit(points, 40)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e6, 1e8])
def test_gaussian_block_equals_differences_far_from_zero(size):
    rng = np.random.default_rng(0)
    centres = np.array([[0.0] * 4, [size] * 4])
    x = centres[rng.integers(0, 2, 60)] + rng.normal(size=(60, 4))
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(GAUSSIAN.block(x, x), exact, atol=1e-9)


def test_text_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"{i % 2}.0 {i % 97} 0.5" for i in range(5000)]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_labeled_text(spark, str(tmp_path / "t")).collect()
            found.append({r.id: tuple(r.features) for r in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len(found[0]) == 5000


def test_text_ids_without_a_shuffle_of_lines(spark, tmp_path):
    """One line is half of a file; there are several files, an empty one and a folder of splits."""
    hot, folder = "1.0 0.5 0.5", tmp_path / "t"
    folder.mkdir()
    texts = {"a.txt": [hot if i % 2 else f"0.0 {i} 0.25" for i in range(4000)], "b.txt": [], "c.txt": [hot, "0.0 7 8"]}
    for name, lines in texts.items():
        (folder / name).write_text("".join(line + "\n" for line in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        read = read_labeled_text(spark, str(folder))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan
        rows = {r.id: (r.label, *r.features) for r in read.collect()}
        assert read.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = {n: tuple(map(float, line.split())) for n, line in enumerate(texts["a.txt"])}
    # An empty file has no split and takes no number.
    expected |= {(1 << 40) + n: tuple(map(float, line.split())) for n, line in enumerate(texts["c.txt"])}
    assert rows == expected


def test_files_split_otherwise_fail(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"1.0 {i} 2\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = read_labeled_text(spark, str(tmp_path / "t.txt"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        with pytest.raises(Exception, match="split otherwise"):
            read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_draws_use_a_bounded_number_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_BUCKETS", 8)
    rows = sampling.draws(spark.range(0, 9000, 3), 2500).orderBy("iter").collect()
    assert [r.idx for r in rows] == sampling.draw_positions(3000, 2500)
    assert all(r.id == 3 * r.idx for r in rows)


def test_auroc_reads_its_input_once(spark):
    scored = spark.range(0, 600, 1, 3).selectExpr("cast(id % 7 as double) as score", "cast(id % 2 as double) as label")
    frame, seen = counted(scored)
    assert auroc(frame).first()[0] == pytest.approx(auroc(scored).first()[0])
    assert seen.value == 600


def test_wide_partial_vectors_move_in_chunks(spark):
    ids = spark.range(100).repartition(100)

    def fold(blocks_of):
        return np.arange(20_000.0) if blocks_of else None

    partials = blocks.partial_sums(ids, fold, lambda batches: [b for b in batches if b.num_rows])
    filled = ids.groupBy(F.spark_partition_id()).count().count()
    assert partials.count() == filled * 5
    np.testing.assert_array_equal(blocks.add_up(partials, 100, 20_000), np.arange(20_000.0) * filled)
    summed = blocks.add_chunks(partials).collect()
    assert len(summed) == 5 and sum(len(r.state) for r in summed) == 20_000


def _batch(frame):
    """Labels and features of a batch, in any order."""
    rows = []
    for draws, labels, cells in blocks.row_batches(frame.toArrow().to_batches()):
        rows += [(y, *x) for y, x in zip(labels, cells)]
    return sorted(rows)


@pytest.mark.parametrize("shift", [0.0, 2.0 ** -30])  # single and double precision
def test_picked_and_extracted_rows_are_the_keyed_sample(spark, make_points, blob, shift):
    ids, labels, cells = blob
    cells = cells.astype(np.float32) + shift * (ids % 2)[:, None]
    points = make_points(zip(ids, labels, cells), 3)
    packed = blocks.pack(points, by_row=True).persist()
    extracted = blocks.extract_batches(packed, range(3, 9), 0.2, 42)
    for i in range(3, 9):
        expected = sorted((r.label, *r.features) for r in minibatch(points, 0.2, i).collect())
        assert expected and _batch(blocks.pick_rows(packed, 0.2, 42 + i)) == expected
        assert _batch(extracted.where(F.col("iter") == i)) == expected
    drawn = blocks.pick_rows(packed, 0.2, 45, (45, 0)).toArrow().to_batches()
    draws = np.concatenate([d for d, _, _ in blocks.row_batches(drawn)], axis=1)
    used = minibatch(points, 0.2, 3)
    for line, seed in zip(draws, (45, 0)):
        assert sorted(line) == sorted(r[0] for r in used.select(uniform(F.col("id"), seed)).collect())
    packed.unpersist()
    assert descent.EXTRACT_SHARE < 1


def test_only_picked_rows_reach_python(make_points, blob):
    packed = blocks.in_row_layout(blocks.pack(make_points(zip(*blob), 2))).persist()
    table = blocks.pick_rows(packed, 0.1, 43).toArrow()
    rows = sum(len(labels) for _, labels, _ in blocks.row_batches(table.to_batches()))
    assert 5 < rows < 50
    sent = sum(len(cells) for row in table.column("cells").to_pylist() for cells in row)
    assert sent == rows * 5 * 8 and "ids" not in table.schema.names
    packed.unpersist()


@pytest.mark.parametrize("tasks", [1, 2, 10, 150])
def test_no_group_of_the_merge_tree_gets_over_two_roots_of_the_tasks(spark, tasks, monkeypatch):
    partials = spark.range(0, tasks, 1, tasks).select(
        F.lit(0).alias("chunk"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("state"))
    row = blocks.add_chunks(partials).first()
    assert list(row.state) == [tasks * (tasks - 1) / 2, tasks] and row.chunk == 0

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        seen = sum(b.num_rows for b in held)
        for batch in blocks_add(held):
            state = pa.array([[float(seen)]], pa.list_(pa.float64()))
            columns = [state if n == "state" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    blocks_add = blocks._add_group
    group = F.floor(F.sqrt(F.spark_partition_id().cast("double"))).cast("int")
    groups = partials.withColumn("group", group).select("chunk", "group", "state").groupBy("chunk", "group")
    sizes = [r.state[0] for r in groups.applyInArrow(
        counting, "chunk int, group int, state array<double>").collect()]
    assert sum(sizes) == tasks and max(sizes) <= 2 * tasks ** 0.5 and len(sizes) <= tasks ** 0.5 + 1


def test_feature_maps_work_in_every_trainer(make_points, blob):
    points = make_points(zip(*blob), 2)
    mapping = feature_maps.RandomFourierMap.seeded(5, 12, seed=1)
    mapped = mapping.transform(points)
    a = train_pegasos(points, iterations=3, feature_map=mapping.block, scale=True).model
    b = train_pegasos(mapped, iterations=3, scale=True).model
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-9)
    losses = [r.loss for r in sweep(points, "pegasos", "step", step_settings("pegasos", 1.0, [1.0]),
                                    iterations=3, feature_map=mapping.block).orderBy("iter").collect()]
    assert losses == pytest.approx([r.loss for r in sweep(
        mapped, "pegasos", "step", step_settings("pegasos", 1.0, [1.0]), iterations=3).orderBy("iter").collect()])
