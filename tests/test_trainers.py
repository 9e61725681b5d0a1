"""Trainers against plain numpy loops, under several partitionings, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hingeworks.functions.kernels import kernel_named
from hingeworks.functions.keyed import uniform_array
from hingeworks.operators import blocks as block_ops, parts as parts_ops
from hingeworks.operators.predict import predict
from hingeworks.operators.sampling import draw_positions
from hingeworks.plans import descent, kernel as kernel_plan, linear, sweep

REG = 0.05


def loop(blob, rate, iterations, *, start, fraction=1.0, bias=False, penalty_after=False):
    ids, labels, cells = blob
    x = np.hstack([cells, np.ones((len(cells), 1))]) if bias else cells
    sign, w, losses = labels * 2 - 1, np.array(start, dtype=float), []
    for i in range(1, iterations + 1):
        used = uniform_array(ids, 42 + i) < fraction
        if not used.any():
            continue
        margins = sign[used] * (x[used] @ w)
        gradient = -(np.where(margins < 1, sign[used], 0.0) @ x[used]) / used.sum()
        before = 0.5 * REG * w @ w
        w = (1 - rate(i) * REG) * w - rate(i) * gradient
        penalty = 0.5 * REG * w @ w if penalty_after else before
        losses.append(np.maximum(0, 1 - margins).mean() + penalty)
    return w, losses


def pegasos(step):
    return lambda i: step / (i * REG)


def same(result, expected, bias=False):
    w, losses = expected
    found = np.append(result.model.weights, result.model.intercept) if bias else result.model.weights
    np.testing.assert_allclose(found, w, atol=1e-9)
    np.testing.assert_allclose(result.trace.losses, losses, atol=1e-9)


@pytest.mark.parametrize("partitions", [1, 4, 7])
@pytest.mark.parametrize("fraction", [1.0, 0.6, 0.1, 0.01])
def test_linear_pegasos(make_points, blob, partitions, fraction):
    points = make_points(zip(*blob), partitions)
    result = linear.train_linear_pegasos(points, iterations=12, reg=REG, fraction=fraction)
    expected = loop(blob, pegasos(1.0), 12, start=np.zeros(6), fraction=fraction, bias=True,
                    penalty_after=True)
    same(result, expected, bias=True)


def test_pegasos_rule(blob_points, blob):
    result = linear.train_pegasos(blob_points, iterations=8, step=2.5, reg=REG, fraction=0.5)
    same(result, loop(blob, pegasos(2.5), 8, start=np.zeros(5), fraction=0.5))


def test_sqrt_rule_with_start_and_intercept(blob_points, blob):
    start = [0.3, -0.2, 0.1, 0.0, 1.0]
    result = linear.train_svm_sgd(blob_points, iterations=8, step=0.7, reg=REG,
                                  initial_weights=start, intercept=True)
    expected = loop(blob, lambda i: 0.7 / i**0.5, 8, start=[*start, 1.0], bias=True)
    same(result, expected, bias=True)


def test_scaling_trains_on_divided_features_and_maps_back(make_points, blob):
    ids, labels, cells = blob
    wide = cells * np.array([1.0, 100.0, 0.01, 1.0, 1.0])
    wide[:, 4] = 3.0  # constant: counts as 0
    deviation = wide.std(axis=0, ddof=1)
    inverse = np.divide(1.0, deviation, out=np.zeros(5), where=deviation > 1e-12)
    w, losses = loop((ids, labels, wide * inverse), lambda i: 1 / i**0.5, 6, start=np.zeros(5))
    result = linear.train_svm_sgd(make_points(zip(ids, labels, wide), 3), iterations=6, reg=REG,
                                  scale=True)
    same(result, (w * inverse, losses))


def test_square_root_rule_agrees_with_the_library_trainer(spark, blob_points, blob):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.regression import LabeledPoint

    _, labels, cells = blob
    rows = spark.sparkContext.parallelize([LabeledPoint(y, x) for y, x in zip(labels, cells)], 2)
    library = SVMWithSGD.train(rows, iterations=15, step=0.5, regParam=REG, convergenceTol=0.0)
    result = linear.train_svm_sgd(blob_points, iterations=15, step=0.5, reg=REG)
    np.testing.assert_allclose(result.model.weights, library.weights.toArray(), atol=1e-9)


def test_partials_are_also_added_on_the_cluster(monkeypatch, make_points, blob):
    monkeypatch.setattr(block_ops, "DIRECT_BYTES", 0)
    result = linear.train_pegasos(make_points(zip(*blob), 6), iterations=5, reg=REG)
    same(result, loop(blob, pegasos(1.0), 5, start=np.zeros(5)))


def test_blocks_smaller_than_a_batch_and_single_precision(monkeypatch, make_points, blob):
    ids, labels, cells = blob
    monkeypatch.setattr(block_ops, "BLOCK_BYTES", 7 * 40)
    exact = cells.astype(np.float32).astype(float)
    for data in (exact, cells):
        for fraction in (1.0, 0.1):
            points = make_points(zip(ids, labels, data), 3)
            result = linear.train_pegasos(points, iterations=7, reg=REG, fraction=fraction)
            same(result, loop((ids, labels, data), pegasos(1.0), 7, start=np.zeros(5),
                              fraction=fraction))


def test_one_full_partition_is_spread(spark, monkeypatch, make_points, blob):
    monkeypatch.setattr(block_ops, "BLOCK_BYTES", 5 * 40)
    points = make_points(zip(*blob), 1)
    blocks = block_ops.pack_and_check(points)
    try:
        assert blocks.partitions == spark.sparkContext.defaultParallelism
        assert blocks.frame.rdd.getNumPartitions() == blocks.partitions
        assert blocks.rows == 200 and blocks.width == 5
    finally:
        blocks.release()


def test_warm_start_is_erased_by_the_first_unit_pegasos_step(blob_points):
    cold = linear.train_pegasos(blob_points, iterations=1, reg=REG, initial_weights=[0.0] * 5)
    huge = linear.train_pegasos(blob_points, iterations=1, reg=REG, initial_weights=[1e9] * 5)
    assert np.abs(huge.model.weights).max() <= 1 / REG * 5
    assert cold.model.weights.shape == huge.model.weights.shape


def test_zero_regularisation_is_refused_where_it_divides(blob_points):
    for train in (linear.train_linear_pegasos, linear.train_pegasos):
        with pytest.raises(ValueError, match="regularisation"):
            train(blob_points, iterations=1, reg=0.0)
    linear.train_svm_sgd(blob_points, iterations=1, reg=0.0)


def test_label_validation_is_only_in_the_validated_trainers(make_points):
    points = make_points([(1, 2.0, [1.0]), (2, 0.0, [2.0])])
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        linear.train_pegasos(points, iterations=1)
    linear.train_pegasos(points, iterations=1, validate=False)
    linear.train_linear_pegasos(points, iterations=1)


def test_own_validators(make_points):
    points = make_points([(1, 1.0, [-1.0]), (2, 0.0, [2.0])])
    negative = F.count_if(F.col("features")[0] < 0)
    with pytest.raises(ValueError, match="validation failed"):
        linear.train_pegasos(points, iterations=1, validators=[negative])
    linear.train_pegasos(points, iterations=1, validators=[negative], validate=False)


def test_rows_of_another_width_are_refused(make_points):
    points = make_points([(1, 1.0, [1.0, 2.0]), (2, 0.0, [2.0]), (3, 0.0, [2.0, 1.0])])
    with pytest.raises(ValueError, match="between 1 and 2 features"):
        linear.train_pegasos(points, iterations=1)


def test_empty_table(make_points, blob_points):
    nothing = blob_points.where("id < 0")
    result = linear.train_pegasos(nothing, iterations=3, initial_weights=[1.0, 2.0])
    assert list(result.model.weights) == [1.0, 2.0] and result.trace.rows() == []
    with pytest.raises(ValueError, match="empty"):
        linear.train_linear_pegasos(nothing, iterations=3)


def test_empty_batches_leave_no_trace_row(make_points):
    points = make_points([(1, 1.0, [1.0]), (2, 0.0, [-1.0])])
    result = linear.train_pegasos(points, iterations=30, fraction=0.05)
    used = [i for i in range(1, 31) if (uniform_array(np.array([1, 2]), 42 + i) < 0.05).any()]
    assert result.trace.iterations == used and len(used) < 30
    assert np.isfinite(result.model.weights).all()


def test_margin_of_one_is_no_violation(make_points):
    points = make_points([(1, 1.0, [1.0])])
    result = linear.train_svm_sgd(points, iterations=1, reg=0.0, initial_weights=[1.0])
    assert list(result.model.weights) == [1.0] and result.trace.losses == [0.0]


def test_one_class_only(make_points):
    points = make_points([(i, 1.0, [1.0, 0.5]) for i in range(5)])
    model = linear.train_linear_pegasos(points, iterations=10).model
    assert {r.prediction for r in predict(points, model).collect()} == {1.0}


def kernel_loop(blob, iterations, kernel, biased):
    ids, labels, cells = blob
    order = np.argsort(ids)
    x = np.hstack([cells, np.ones((len(cells), 1))]) if biased else cells
    x, sign = x[order], labels[order] * 2 - 1
    values, alpha = kernel_named(kernel).block(x, x), np.zeros(len(x))
    for i, r in enumerate(draw_positions(len(x), iterations), 1):
        terms = sign * alpha * values[r]
        terms[r] = 0.0
        if sign[r] * terms.sum() / (REG * i) < 1:
            alpha[r] += 1
    scores = values @ (sign * alpha) / (REG * iterations)
    return dict(zip(ids[order], alpha)), dict(zip(ids[order], scores))


@pytest.mark.parametrize("kernel,biased", [("linear", True), ("gaussian", False),
                                           ("polynomial", True)])
def test_kernel_pegasos(monkeypatch, blob_points, blob, kernel, biased):
    # Small bounds: several bands of the kernel matrix, several parts, several slices of rows.
    monkeypatch.setattr(kernel_plan, "GRAM_BYTES", 8 * 60 * 25)
    monkeypatch.setattr(block_ops, "BLOCK_BYTES", 8 * 5 * 4)
    monkeypatch.setattr(parts_ops, "PART_BYTES", 8 * 8 * 10)
    monkeypatch.setattr(parts_ops, "VALUE_BYTES", 8 * 10 * 7)
    model = kernel_plan.train_kernel_pegasos(blob_points, iterations=80, reg=REG, kernel=kernel,
                                             biased=biased).without_threshold()
    alpha, scores = kernel_loop(blob, 80, kernel, biased)
    support = {r.id: r.alpha for r in model.support.collect()}
    assert support == {i: a for i, a in alpha.items() if a > 0}
    found = {r.id: r.prediction for r in predict(blob_points, model).collect()}
    assert found == pytest.approx(scores)


def test_sweep_matches_single_trainings(blob_points):
    settings = sweep.batch_settings(1.0, (1.0, 0.5, 0.05))
    rows = sweep.sweep(blob_points, "pegasos", "batch", settings, iterations=6, reg=REG).collect()
    for fraction, _ in settings:
        single = linear.train_pegasos(blob_points, iterations=6, reg=REG, fraction=fraction)
        losses = [r.loss for r in sorted(rows, key=lambda r: r.iter) if r.value == fraction]
        assert losses == pytest.approx(single.trace.losses)


def test_sweep_of_small_fractions_and_shares(blob_points, blob):
    ids, labels, cells = blob
    small = sweep.batch_settings(1.0, (0.12, 0.1))
    rows = sweep.sweep(blob_points, "svm", "batch", small, iterations=5, reg=REG).collect()
    for fraction, _ in small:
        single = linear.train_svm_sgd(blob_points, iterations=5, reg=REG, fraction=fraction)
        losses = [r.loss for r in sorted(rows, key=lambda r: r.iter) if r.value == fraction]
        assert losses == pytest.approx(single.trace.losses)
    half = uniform_array(ids, 0) < 0.5
    rows = sweep.sweep(blob_points, "pegasos", "size", sweep.size_settings(1.0, 1.0, (0.5, 1.0)),
                       iterations=4, reg=REG).collect()
    _, losses = loop((ids[half], labels[half], cells[half]), pegasos(1.0), 4, start=np.zeros(5))
    found = [r.loss for r in sorted(rows, key=lambda r: r.iter) if r.value == 0.5]
    assert found == pytest.approx(losses)


def test_timed_sweep(blob_points):
    rows = sweep.timed_sweep(blob_points, "svm", "step", sweep.step_settings("svm", 1.0, (1.0, 2.0)),
                             iterations=2).collect()
    assert [(r.trainer, r.dimension, r.value) for r in rows] == [("svm", "step", 1.0),
                                                                 ("svm", "step", 2.0)]
    assert all(r.seconds > 0 for r in rows)


def test_fold_tasks():
    assert descent.fold_tasks(3, 1.0, 8) == 3
    assert descent.fold_tasks(32, 1.0, 8) == 8
    assert descent.fold_tasks(30_000, 1.0, 1000) == 3000
    assert descent.fold_tasks(100_000, 0.01, 1000) == 6250
    assert descent.fold_tasks(100_000, 0.01, 8000) == 8000


def test_own_gradient_and_update_rule(blob_points, blob):
    """Squared loss with a constant step, as user functions."""
    _, labels, cells = blob

    def squared(scores, truth):
        gap = scores - (truth * 2 - 1)[:, None]
        return gap * gap / 2, gap

    def constant(weights, gradient, step, iteration, reg):
        return weights - step * gradient, 0.0

    result = linear.train_with_rule(blob_points, constant, iterations=3, step=0.1,
                                    gradient=squared)
    w = np.zeros(5)
    for _ in range(3):
        w = w - 0.1 * ((cells @ w - (labels * 2 - 1)) @ cells) / len(labels)
    np.testing.assert_allclose(result.model.weights, w, atol=1e-9)
