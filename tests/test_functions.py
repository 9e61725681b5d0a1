import numpy as np
import pytest
from pyspark.sql import functions as F

from hingeworks.functions import keyed, vectors
from hingeworks.functions.kernels import GAUSSIAN, LINEAR, POLYNOMIAL, kernel_named


def test_column_and_array_forms_of_keyed_numbers_agree(spark):
    keys = spark.range(-50, 500, 1, 3).select(
        "id", keyed.uniform(F.col("id"), 43).alias("u"), keyed.normal(F.col("id"), 7).alias("z")
    ).toPandas()
    assert (keyed.uniform_array(keys.id.values, 43) == keys.u.values).all()
    np.testing.assert_allclose(keyed.normal_array(keys.id.values, 7), keys.z.values, atol=1e-12)


def test_keyed_numbers_look_random(spark):
    u = keyed.uniform_array(np.arange(100_000), 1)
    assert abs(u.mean() - 0.5) < 0.005 and u.min() >= 0 and u.max() < 1
    other = keyed.uniform_array(np.arange(100_000), 2)
    assert abs(np.corrcoef(u, other)[0, 1]) < 0.02
    z = keyed.normal_array(np.arange(100_000), 1)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02


@pytest.mark.parametrize("seed", [0, 7, 2**31])
def test_many_seeds_at_once(spark, seed):
    keys = np.array([-(2**63), -1, 0, 1, 5, 2**63 - 1])
    both = keyed.uniform_array(keys[:, None], np.array([seed, seed + 1]))
    np.testing.assert_array_equal(both[:, 0], keyed.uniform_array(keys, seed))
    np.testing.assert_array_equal(both[:, 1], keyed.uniform_array(keys, seed + 1))
    assert (both[:, 0] != both[:, 1]).all() and both.shape == (6, 2)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vector_columns(spark):
    a, b = vectors.literal_vector([1.0, -2.0, 3.5]), vectors.literal_vector([2.0, 0.5, -1.0])
    row = one(spark, vectors.dot(a, b), vectors.squared_distance(a, b), vectors.append_bias(a),
              *vectors.split_bias(a), vectors.signed_label(F.lit(0.0)))
    assert list(row) == [-2.5, 27.5, [1.0, -2.0, 3.5, 1.0], [1.0, -2.0], 3.5, -1.0]


def test_literal_vector_keeps_every_bit(spark):
    values = [0.1, -1e-300, 2**0.5, 1e22, 0.0]
    assert one(spark, vectors.literal_vector(values))[0] == values
    assert one(spark, vectors.literal_vector([]))[0] == []


def test_threshold_is_strict(spark):
    assert one(spark, vectors.threshold_label(F.lit(0.0), 0.0))[0] == 0.0
    assert one(spark, vectors.threshold_label(F.lit(0.1), 0.0))[0] == 1.0
    assert one(spark, vectors.threshold_label(F.lit(0.1), None))[0] == 0.1


@pytest.mark.parametrize("kernel,value", [
    (LINEAR, -2.5), (GAUSSIAN, np.exp(-0.5 * 27.5)), (POLYNOMIAL, 2.25)])
def test_kernels(spark, kernel, value):
    a, b = [1.0, -2.0, 3.5], [2.0, 0.5, -1.0]
    column = kernel.column(vectors.literal_vector(a), vectors.literal_vector(b))
    assert one(spark, column)[0] == pytest.approx(value)
    assert kernel.block(np.array([a]), np.array([b]))[0, 0] == pytest.approx(value)
    assert kernel_named(kernel.name) is kernel


def test_unknown_kernel_is_refused():
    with pytest.raises(ValueError, match="unknown kernel"):
        kernel_named("sigmoid")
