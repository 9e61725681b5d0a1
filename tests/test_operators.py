import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from hingeworks.functions.kernels import GAUSSIAN
from hingeworks.models import LinearModel
from hingeworks.operators import metrics, ordering, sampling, surfaces, validate
from hingeworks.operators.feature_maps import NystromMap, RandomFourierMap, gram
from hingeworks.operators.gradients import gradient_sums
from hingeworks.operators.kernel_ops import kernel_scores
from hingeworks.operators.predict import predict
from hingeworks.operators.blocks import pack_and_check
from hingeworks.operators.scaling import block_deviations, column_deviations, scale_features


def ids_of(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_sampling_does_not_depend_on_partitions(spark):
    one, many = (spark.range(0, 3000, 1, p) for p in (1, 7))
    assert ids_of(sampling.minibatch(one, 0.1, 3)) == ids_of(sampling.minibatch(many, 0.1, 3))
    assert ids_of(sampling.landmarks(one, 25)) == ids_of(sampling.landmarks(many, 25))
    assert 200 < sampling.minibatch(one, 0.1, 3).count() < 400
    assert ids_of(sampling.minibatch(one, 0.1, 3)) != ids_of(sampling.minibatch(one, 0.1, 4))


def test_split_is_a_partition_of_the_table(spark):
    points = spark.range(2000)
    parts = sampling.random_split(points, (0.6, 0.4))
    assert sorted(sum((ids_of(p) for p in parts), [])) == list(range(2000))
    assert abs(parts[0].count() - 1200) < 100


def test_landmarks_of_a_small_table(spark):
    assert sampling.landmarks(spark.range(4), 10).count() == 4


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_row_index_and_running_sums(spark, buckets):
    rng = np.random.default_rng(0)
    keys = rng.choice(10**12, 500, replace=False)
    keys[:400] = np.arange(400)  # most keys in a narrow range
    keys = np.unique(keys)
    frame = spark.createDataFrame([(int(k), float(k % 7)) for k in keys], "id long, v double")
    frame = frame.repartition(5)
    rows = ordering.row_index(frame, buckets=buckets).orderBy("id").collect()
    assert [r.idx for r in rows] == list(range(len(keys)))
    sums = ordering.running_sums(frame, "id", {"s": "v"}, buckets).orderBy("id").collect()
    assert [r.s for r in sums] == list(np.cumsum([float(k % 7) for k in keys]))
    picked = ordering.rows_at(frame, [0, 17, len(keys) - 1], buckets=buckets).orderBy("idx").collect()
    assert [(r.idx, r.id) for r in picked] == [(p, int(keys[p])) for p in (0, 17, len(keys) - 1)]


def test_draws(spark):
    rows = sampling.draws(spark.range(100, 200), 50).orderBy("iter").collect()
    assert [r.iter for r in rows] == list(range(1, 51))
    assert [r.idx for r in rows] == sampling.draw_positions(100, 50)
    assert all(r.id == r.idx + 100 for r in rows)
    with pytest.raises(ValueError):
        sampling.draws(spark.range(0), 3)


def test_auroc_with_ties_and_a_hot_score(spark):
    rng = np.random.default_rng(1)
    scores = np.where(rng.random(900) < 0.4, 0.5, rng.integers(0, 40, 900) / 40)
    labels = (rng.random(900) < 0.3 + 0.4 * scores).astype(float)
    frame = spark.createDataFrame(list(zip(scores.tolist(), labels.tolist())), "score double, label double")
    library = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(frame)
    assert metrics.auroc(frame).first()[0] == pytest.approx(library, abs=1e-12)
    assert metrics.auroc(frame.where("label = 1")).first()[0] is None


def test_validation(make_points):
    points = make_points([(1, 0.0, [1.0, 2.0]), (2, 1.0, [1.0]), (3, 0.5, [1.0, 3.0])])
    assert tuple(validate.preflight(points).first()) == (3, 1, 2, 1)
    with pytest.raises(ValueError, match="validation failed"):
        validate.require(points)
    validate.require(points.where("label <> 0.5"))
    validate.require(points, [])
    with pytest.raises(ValueError):
        validate.require(points, [F.count_if(F.size("features") != 2)])


def test_gradient_sums_by_hand(make_points):
    # Margins at w = (1, 0), b = 0: 2 (no violation), exactly 1 (none), 1*-1*3 = -3 (violation).
    points = make_points([(1, 1.0, [2.0, 5.0]), (2, 0.0, [-1.0, 4.0]), (3, 0.0, [3.0, 7.0])], 2)
    rows = gradient_sums(points, [1.0, 0.0], 0.0).orderBy("dim").collect()
    assert [tuple(r) for r in rows] == [(0, 3.0, 4.0, 3), (1, 7.0, 4.0, 3), (2, 1.0, 4.0, 3)]
    assert gradient_sums(points.where("id > 9"), [1.0, 0.0]).count() == 0


def test_scaling(make_points, blob):
    ids, labels, cells = blob
    points = make_points(zip(ids, labels, cells * 1e6 + 1e9), 5)
    np.testing.assert_allclose(column_deviations(points), cells.std(axis=0, ddof=1) * 1e6, rtol=1e-7)
    packed = pack_and_check(points)
    np.testing.assert_allclose(block_deviations(packed), cells.std(axis=0, ddof=1) * 1e6, rtol=1e-7)
    packed.release()
    scaled = np.array([r.features for r in scale_features(make_points(zip(*blob), 3)).collect()])
    np.testing.assert_allclose(scaled.std(axis=0, ddof=1), 1.0)


def test_linear_prediction_and_threshold(make_points):
    points = make_points([(1, 1.0, [2.0, 0.0]), (2, 0.0, [0.0, 0.0])])
    model = LinearModel(np.array([1.0, 1.0]), -0.5)
    raw = {r.id: r.s for r in predict(points, model.without_threshold(), "s").collect()}
    assert raw == {1: 1.5, 2: -0.5}
    assert {r.id: r.prediction for r in predict(points, model).collect()} == {1: 1.0, 2: 0.0}
    high = predict(points, model.with_threshold(1.5)).collect()
    assert {r.prediction for r in high} == {0.0}
    table = model.to_table(points.sparkSession).first()
    assert tuple(table) == ([1.0, 1.0], -0.5, 0.0)


def test_prediction_stays_in_the_jvm_and_reads_two_columns(spark, tmp_path, blob_points):
    blob_points.withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    plan = predict(points, LinearModel(np.ones(5))).select("id", "prediction")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
    assert "ReadSchema: struct<id:bigint,features:array<double>>" in text
    batch = sampling.minibatch(points, 0.1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in batch


def test_kernel_scores_leave_out_the_target(make_points, blob):
    ids, labels, cells = blob
    points = make_points(zip(*blob), 3)
    weighted = points.select("id", (F.col("label") * 2 - 1).alias("y"), "features",
                             (F.col("id") % 3).cast("double").alias("alpha"))
    found = {r.id: r.score for r in kernel_scores(weighted, points.where("id < 20"), "gaussian").collect()}
    values = GAUSSIAN.block(cells, cells)
    np.fill_diagonal(values, 0.0)
    expected = dict(zip(ids, ((labels * 2 - 1) * (ids % 3)) @ values))
    assert found == pytest.approx({i: expected[i] for i in ids if i < 20})


def test_random_fourier_features_approximate_the_gaussian_kernel(make_points, blob):
    cells = blob[2]
    mapping = RandomFourierMap.seeded(5, 20000, seed=1)
    mapped = mapping.block(cells[:20])
    np.testing.assert_allclose(mapped @ mapped.T, GAUSSIAN.block(cells[:20], cells[:20]), atol=0.05)
    small = RandomFourierMap.seeded(5, 12, seed=1)
    rows = small.transform(make_points(zip(*blob), 3)).orderBy("id").collect()
    np.testing.assert_allclose([r.features for r in rows], small.block(cells), atol=1e-12)


def test_nystrom(make_points, blob):
    points = make_points(zip(*blob), 3)
    fitted = NystromMap.fit(points, 60, "gaussian")
    k = GAUSSIAN.block(fitted.landmarks, fitted.landmarks)
    np.testing.assert_allclose(fitted.normalization @ k @ fitted.normalization, np.eye(60), atol=1e-6)
    mapped = np.array([r.features for r in fitted.transform(points).orderBy("id").collect()])
    exact = GAUSSIAN.block(blob[2], blob[2])
    assert np.abs(mapped @ mapped.T - exact).mean() < 0.06
    assert len(NystromMap.fit(points, 10**6).landmarks) == len(blob[0])


def test_nystrom_with_equal_landmarks_stays_finite(make_points):
    points = make_points([(i, 1.0, [float(i % 2), 0.0]) for i in range(10)])
    fitted = NystromMap.fit(points, 10)
    assert np.isfinite(fitted.normalization).all()
    mapped = fitted.block(np.array([[0.0, 0.0], [1.0, 0.0]]))
    np.testing.assert_allclose(mapped @ mapped.T, [[1, np.exp(-0.5)], [np.exp(-0.5), 1]], atol=1e-9)


def test_gram(make_points, blob):
    rows = gram(make_points(zip(*blob), 2), 15, "gaussian").orderBy("id").collect()
    values = np.array([r.kernel_row for r in rows])
    np.testing.assert_allclose(values, values.T)
    np.testing.assert_allclose(np.diag(values), 1.0)


def test_surfaces(spark):
    plane = LinearModel(np.array([1.0, -2.0]), 0.5)
    rows = surfaces.surface_2d(spark, plane)
    assert rows.count() == 201 * 201
    off = rows.where(F.abs(F.col("x") - 2 * F.col("y") + 0.5 - F.col("z")) > 1e-9)
    assert off.count() == 0
    edge = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert list(edge) == pytest.approx([-2.0, 2.0, -2.0, 2.0])
    flat = surfaces.surface_3d(spark, LinearModel(np.array([0.0, 0.0, 1.0]), -1.0)).collect()
    assert len(flat) == 101 * 101 and {round(r.z, 9) for r in flat} == {1.0}
    # Equal scores everywhere: the lowest z wins.
    tied = surfaces.surface_3d(spark, LinearModel(np.array([0.0, 0.0, 0.0]), 1.0))
    assert tied.select("z").distinct().collect()[0].z == pytest.approx(-2.5)


def test_objective(make_points):
    points = make_points([(1, 1.0, [0.5]), (2, 0.0, [2.0])])
    # Hinge losses 0.5 and 3.0 at w = 1; penalty 0.2 / 2.
    assert metrics.objective(points, [1.0], 0.0, 0.2).first()[0] == pytest.approx(1.75 + 0.1)
