import numpy as np
import pytest
from pyspark.sql import functions as F

from hingeworks.models import Trace
from hingeworks.operators.metrics import auroc
from hingeworks.operators.predict import predict
from hingeworks.plans.kernel import train_kernel_pegasos
from hingeworks.plans.linear import train_linear_pegasos, train_nystrom, train_rff
from hingeworks.sources import generators, labeled_text, traces


def test_read_labeled_text(spark, tmp_path):
    for name in ("0", "1"):
        (tmp_path / f"{name}.csv").write_text("1.0 0.5 -2\n0 3e2 4 \n")
    points = labeled_text.read_labeled_text(spark, str(tmp_path / "[0-1].csv"))
    rows = sorted((r.label, r.features) for r in points.collect())
    assert rows == [(0.0, [300.0, 4.0])] * 2 + [(1.0, [0.5, -2.0])] * 2
    assert points.select("id").distinct().count() == 4


def test_a_malformed_token_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1.0 0.5 x\n")
    with pytest.raises(Exception, match="not a labelled point"):
        labeled_text.read_labeled_text(spark, str(tmp_path / "bad.csv")).collect()


def test_labeled_text_format(spark, tmp_path, make_points):
    labeled_text.write_labeled_text(make_points([(1, 1.0, [0.12345, -2.0])]), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["1.0 0.1235 -2.0000"]


def test_support_and_surface_format(spark, tmp_path):
    support = spark.createDataFrame([(1, -1.0, [0.1, 1e-7], 2.0)],
                                    "id long, y double, features array<double>, alpha double")
    labeled_text.write_support(support, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == "-1.0 0.1 1.0E-7"
    surface = spark.createDataFrame([(-2.0, 0.5, 1 / 3)], "x double, y double, z double")
    labeled_text.write_surface(surface, str(tmp_path / "z"))
    assert spark.read.text(str(tmp_path / "z")).first()[0] == "-2.000000 0.500000 0.333333"


def test_trace_round_trip(spark, tmp_path):
    trace = Trace()
    for i in range(1, 41):
        trace.add(i, i * 7, 1 / i)
    table = trace.to_table(spark)
    for step in (3, 5):
        path = f"{tmp_path}/{traces.trace_name('step', step, 'pegasos')}"
        traces.write_trace(table, path, 12)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[:3] == ["12", "###", "7 1.0"] and len(lines) == 42
    read = traces.read_traces(spark, f"{tmp_path}/*")
    rows = read.where("setting = '5'").orderBy("iter").collect()
    assert [(r.iter, r.elapsed_ms, r.loss) for r in rows] == trace.rows()
    assert {(r.dimension, r.trainer) for r in rows} == {("step", "pegasos")}
    assert traces.trace_tail(read).count() == 20
    summary = traces.trace_summary(read).orderBy("setting").collect()
    assert [(r.setting, r.iterations, r.last_loss, r.least_loss, r.total_ms) for r in summary] == [
        (s, 40, 0.025, 0.025, 280) for s in ("3", "5")]


def test_traces_written_by_others(spark, tmp_path):
    (tmp_path / "batch#0.1#svm.txt").write_text("9\n###\n# note\n5 0.5\n\n9 0.25\n")
    rows = traces.read_traces(spark, str(tmp_path / "*.txt")).orderBy("iter").collect()
    assert [(r.setting, r.trainer, r.iter, r.loss) for r in rows] == [
        ("0.1", "svm", 1, 0.5), ("0.1", "svm", 2, 0.25)]


def test_sweep_files(spark, tmp_path):
    (tmp_path / "grid.csv").write_text(
        "## old runs\n# executors\ttime\n8\t127\n9\t130\n## skip\n# step\ttime\n1\t40\n")
    rows = traces.read_sweep(spark, str(tmp_path / "grid.csv")).orderBy("dimension", "value")
    assert [tuple(r) for r in rows.collect()] == [
        ("executors", 8.0, 127.0), ("executors", 9.0, 130.0), ("step", 1.0, 40.0)]
    timed = rows.withColumn("trainer", F.lit("svm"))
    traces.write_sweep(timed, str(tmp_path / "again"))
    again = traces.read_sweep(spark, str(tmp_path / "again")).orderBy("dimension", "value")
    assert again.collect() == rows.collect()


def test_gaussian_classes(spark):
    one, many = (generators.gaussian_classes(generators.ordinals(spark, 3000, p), 50, 2)
                 for p in (1, 5))
    a, b = one.orderBy("id").collect(), many.orderBy("id").collect()
    assert a == b
    cells, labels = np.array([r.features for r in a]), np.array([r.label for r in a])
    assert list(labels[:4]) == [1.0, 0.0, 1.0, 0.0] and cells.shape == (3000, 50)
    for label, mean in ((1.0, 1.0), (0.0, -1.0)):
        part = cells[labels == label]
        assert abs(part.mean() - mean) < 0.02 and abs(part.std() - 1) < 0.02
    assert abs(np.corrcoef(cells[:, 0], cells[:, 1])[0, 1] - 0.5) < 0.05  # shared class mean


def made(spark, name, axes, sigma, rows=2000):
    points = generators.shape(generators.ordinals(spark, rows, 3), rows, name, axes, sigma, 5)
    table = points.orderBy("id").collect()
    return points, np.array([r.label for r in table]), np.array([r.features for r in table])


@pytest.mark.parametrize("name,axes,positives,total", [
    ("linear", 2, 1000, 2000), ("linear", 3, 1000, 2000), ("circle", 2, 1000, 2000),
    ("mixture", 2, 1333, 2000), ("checkers", 2, 1000, 2000), ("clowns", 2, 1000, 2000),
    ("ball", 3, 1000, 2000)])
def test_shapes(spark, name, axes, positives, total):
    _, labels, cells = made(spark, name, axes, 0.3)
    assert labels.sum() == positives and cells.shape == (total, axes)
    up, down = cells[labels == 1], cells[labels == 0]
    if name == "linear":
        np.testing.assert_allclose(up.mean(axis=0), 1, atol=0.05)
        np.testing.assert_allclose(down.mean(axis=0), -1, atol=0.05)
    elif name == "circle":
        radius = np.hypot(*down.T)
        assert radius.min() >= 1 and radius.max() <= 1.5 and abs(up.std() - 0.3) < 0.02
    elif name == "mixture":
        np.testing.assert_allclose(down.mean(axis=0), [-0.3, -0.5], atol=0.05)
        np.testing.assert_allclose(up.mean(axis=0), [-0.35, -0.25], atol=0.05)
    elif name == "checkers":
        parity = np.floor(cells).sum(axis=1) % 2
        np.testing.assert_array_equal(parity, labels)
        assert cells.min() >= -2 and cells.max() <= 2
    elif name == "clowns":
        np.testing.assert_allclose(cells.mean(axis=0), 0, atol=1e-9)
        np.testing.assert_allclose(cells.std(axis=0), 1, atol=1e-9)
    else:
        np.testing.assert_allclose(down[:, 2], 2.25 - down[:, 0] ** 2 - down[:, 1] ** 2)
        assert down[:, :2].min() == -1.5 and down[:, :2].max() == 1.5


def test_unknown_shape(spark):
    with pytest.raises(ValueError, match="no shape"):
        generators.shape(generators.ordinals(spark, 10), 10, "checkers", 3)


def accuracy(points, model):
    return predict(points, model).agg(
        F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0))).first()[0]


def test_acceptance_on_separable_and_circular_data(spark):
    straight, _, _ = made(spark, "linear", 2, 1.0)
    straight = straight.coalesce(2).persist()
    assert accuracy(straight, train_linear_pegasos(straight, iterations=100).model) >= 0.90

    ring, _, _ = made(spark, "circle", 2, 0.3)
    ring = ring.coalesce(2).persist()
    assert accuracy(ring, train_linear_pegasos(ring, iterations=50).model) < 0.75
    kernel = train_kernel_pegasos(ring, iterations=200, kernel="gaussian")
    assert accuracy(ring, kernel) >= 0.95
    assert auroc(predict(ring, kernel.without_threshold(), "score")).first()[0] > 0.98
    for train in (train_rff, train_nystrom):
        mapping, result = train(ring, iterations=100)
        assert accuracy(mapping.transform(ring), result.model) >= 0.95
    straight.unpersist()
    ring.unpersist()
