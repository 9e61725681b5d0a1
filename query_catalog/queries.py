"""The registered queries. Each takes ``(spark, folder)`` and returns a DataFrame.

Floating point results are rounded to six decimals, because sums depend in
their last bits on the order of addition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hingeworks.functions.kernels import GAUSSIAN, LINEAR, POLYNOMIAL
from hingeworks.functions.vectors import (
    append_bias,
    dot,
    literal_vector,
    signed_label,
    signed_margin,
    split_bias,
)
from hingeworks.models import KernelModel, LinearModel, TrainingResult
from hingeworks.operators import metrics, ordering, sampling, surfaces, validate
from hingeworks.operators.feature_maps import NystromMap, RandomFourierMap, gram
from hingeworks.operators.gradients import gradient_sums
from hingeworks.operators.kernel_ops import collect_anchors, kernel_rows, kernel_scores, support_vectors
from hingeworks.operators.predict import predict, predict_vector
from hingeworks.operators.scaling import scale_features
from hingeworks.operators.updates import pegasos_rate, sqrt_rate, updated_weights
from hingeworks.plans import linear, sweep as sweeps
from hingeworks.plans.kernel import train_kernel_pegasos
from hingeworks.sources import generators, labeled_text, traces
from hingeworks.sources.scratch import fresh_path
from query_catalog.inputs import (
    WIDTH,
    ALPHA_DRAWS,
    LINEITEM_INTERCEPT,
    LINEITEM_WEIGHTS,
    REFERENCE_INTERCEPT,
    REFERENCE_WEIGHTS,
    REG,
    embedding_points,
    lineitem_points,
    narrow_points,
    order_ids,
    table,
)

REGISTERED = {}


def query(function):
    REGISTERED[function.__name__] = function
    return function


def r6(column):
    return F.round(column, 6)


def cells(points: DataFrame, *keep: str, column: str = "features") -> DataFrame:
    """One row per array element: ``dim`` from 0 and ``value``."""
    exploded = points.select(*keep, F.posexplode(column).alias("dim", "value"))
    return exploded.withColumn("value", r6("value"))


def trained(spark, result: TrainingResult) -> DataFrame:
    """``(part, pos, value)``: losses by iteration, weights by position, intercept."""
    rows = [("loss", i, loss) for i, _, loss in result.trace.rows()]
    rows += [("weight", j, float(w)) for j, w in enumerate(result.model.weights)]
    rows.append(("intercept", 0, float(result.model.intercept)))
    made = spark.createDataFrame(rows, "part string, pos int, value double")
    return made.withColumn("value", r6("value"))


# Sources and sinks


@query
def write_labeled_text(spark, folder):
    path = fresh_path(spark, "points")
    labeled_text.write_labeled_text(embedding_points(spark, folder), path)
    return spark.read.text(path)


@query
def read_labeled_text(spark, folder):
    path = fresh_path(spark, "points")
    labeled_text.write_labeled_text(embedding_points(spark, folder), path)
    return cells(labeled_text.read_labeled_text(spark, path), "label")


@query
def support_write(spark, folder):
    path = fresh_path(spark, "support")
    labeled_text.write_support(support_table(spark, folder), path)
    read = labeled_text.read_labeled_text(spark, path)
    return cells(read.withColumnRenamed("label", "y"), "y")


@query
def surface_write(spark, folder):
    path = fresh_path(spark, "surface")
    labeled_text.write_surface(surface_2d(spark, folder), path)
    return spark.read.text(path)


def trace_files(spark, folder):
    """Traces of three step sizes, one file each, named by dimension, value and trainer."""
    settings = sweeps.step_settings("pegasos", 1.0, (1.0, 3.0, 5.0))
    losses = sweeps.sweep(embedding_points(spark, folder), "pegasos", "step", settings,
                          iterations=34, reg=REG)
    base = fresh_path(spark, "traces")
    for value, _ in settings:
        one = losses.where(F.col("value") == value)
        trace = one.select("iter", (F.col("iter") * 10).cast("long").alias("elapsed_ms"), "loss")
        traces.write_trace(trace, f"{base}/{traces.trace_name('step', int(value), 'pegasos')}", 3)
    return base


@query
def trace_write(spark, folder):
    lines = spark.read.text(f"{trace_files(spark, folder)}/*")
    words = F.split("value", " ")
    return lines.select(
        words[0].alias("first_word"), r6(F.get(words, F.lit(1)).cast("double")).alias("loss")
    )


def read_trace_files(spark, folder):
    return traces.read_traces(spark, f"{trace_files(spark, folder)}/*")


@query
def trace_read(spark, folder):
    return read_trace_files(spark, folder).withColumn("loss", r6("loss"))


@query
def trace_tail(spark, folder):
    return traces.trace_tail(read_trace_files(spark, folder)).withColumn("loss", r6("loss"))


@query
def trace_summary(spark, folder):
    summary = traces.trace_summary(read_trace_files(spark, folder))
    return summary.withColumns({c: r6(c) for c in ("last_loss", "least_loss")})


@query
def sweep_read(spark, folder):
    counts = [
        table(spark, folder, name).groupBy(F.col(column).cast("double").alias("value")).agg(
            F.count(F.lit(1)).cast("double").alias("seconds")
        ).select(F.lit(name).alias("dimension"), "value", "seconds")
        for name, column in (("embeddings", "label"), ("labels", "quality"),
                             ("lineitem", "l_linenumber"))
    ]
    path = fresh_path(spark, "sweep")
    traces.write_sweep(counts[0].union(counts[1]).union(counts[2]), path)
    return traces.read_sweep(spark, path)


# Projections, predicates, checks


@query
def label_to_sign(spark, folder):
    return embedding_points(spark, folder).select("id", signed_label(F.col("label")).alias("y"))


@query
def append_bias_query(spark, folder):
    points = embedding_points(spark, folder)
    return cells(points.withColumn("features", append_bias(F.col("features"))), "id")


@query
def split_bias_query(spark, folder):
    weights, intercept = split_bias(F.col("features"))
    points = embedding_points(spark, folder)
    split = points.select("id", weights.alias("features"), r6(intercept).alias("intercept"))
    return cells(split, "id", "intercept")


@query
def margin_violations(spark, folder):
    margin = signed_margin(F.col("label"), F.col("features"), REFERENCE_WEIGHTS)
    scored = embedding_points(spark, folder).select("id", margin.alias("margin"))
    return scored.where("margin < 1").withColumn("margin", r6("margin"))


@query
def label_check(spark, folder):
    checks = [("labels", "quality"), ("labels", "toxic"), ("embeddings", "label"),
              ("lineitem", "l_linenumber")]
    parts = [
        table(spark, folder, name).agg(
            F.count(F.lit(1)).alias("n_rows"), validate.bad_labels(column)
        ).select(F.lit(f"{name}.{column}").alias("source"), "n_rows", "bad_labels")
        for name, column in checks
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def preflight(spark, folder):
    return validate.preflight(embedding_points(spark, folder))


@query
def preflight_lineitem(spark, folder):
    return validate.preflight(lineitem_points(spark, folder))


# Sampling


@query
def minibatch(spark, folder):
    return sampling.minibatch(order_ids(spark, folder), 0.1, 1)


@query
def landmarks(spark, folder):
    return sampling.landmarks(order_ids(spark, folder), 30, seed=5)


@query
def row_index(spark, folder):
    return ordering.row_index(order_ids(spark, folder))


@query
def draws(spark, folder):
    return sampling.draws(order_ids(spark, folder), ALPHA_DRAWS)


@query
def train_test_split(spark, folder):
    train, test = sampling.random_split(order_ids(spark, folder))
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


# Aggregates and update rules


@query
def hinge_gradient(spark, folder):
    sums = gradient_sums(embedding_points(spark, folder), REFERENCE_WEIGHTS, REFERENCE_INTERCEPT)
    return sums.withColumns({c: r6(c) for c in ("gradient", "loss_sum")})


@query
def hinge_gradient_batch(spark, folder):
    sums = gradient_sums(embedding_points(spark, folder), REFERENCE_WEIGHTS, None, 0.1)
    return sums.withColumns({c: r6(c) for c in ("gradient", "loss_sum")})


@query
def hinge_gradient_lineitem(spark, folder):
    sums = gradient_sums(lineitem_points(spark, folder), LINEITEM_WEIGHTS, LINEITEM_INTERCEPT)
    # Large sums of prices: fewer decimals are certain.
    return sums.withColumns({c: F.round(c, 3) for c in ("gradient", "loss_sum")})


def one_step(spark, folder, rate):
    sums = gradient_sums(embedding_points(spark, folder), REFERENCE_WEIGHTS)
    ordered = F.array_sort(F.collect_list(F.struct("dim", "gradient")))
    vector = sums.agg(ordered["gradient"].alias("g"), F.first("batch_rows").alias("n"))
    stepped = updated_weights(literal_vector(REFERENCE_WEIGHTS), F.col("g"), F.col("n"), rate, REG)
    return cells(vector.select(stepped.alias("features")))


@query
def pegasos_step(spark, folder):
    return one_step(spark, folder, pegasos_rate(1.0, 3, REG))


@query
def sqrt_step(spark, folder):
    return one_step(spark, folder, sqrt_rate(1.0, 3, REG))


def drawn_alphas(spark, folder):
    drawn = sampling.draws(embedding_points(spark, folder), ALPHA_DRAWS)
    return drawn.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("alpha"))


def support_table(spark, folder):
    return support_vectors(embedding_points(spark, folder), drawn_alphas(spark, folder),
                           most_rows=ALPHA_DRAWS)


@query
def support_vectors_query(spark, folder):
    return cells(support_table(spark, folder), "id", "y", "alpha")


@query
def kernel_score(spark, folder):
    targets = sampling.landmarks(embedding_points(spark, folder), 10, seed=5)
    return kernel_scores(support_table(spark, folder), targets, GAUSSIAN).withColumn("score", r6("score"))


@query
def gram_query(spark, folder):
    return cells(gram(embedding_points(spark, folder), 30, GAUSSIAN, seed=5), "id",
                 column="kernel_row")


@query
def objective(spark, folder):
    value = metrics.objective(embedding_points(spark, folder), REFERENCE_WEIGHTS, 0.0, REG)
    return value.withColumn("objective", r6("objective"))


@query
def objective_lineitem(spark, folder):
    value = metrics.objective(lineitem_points(spark, folder), LINEITEM_WEIGHTS,
                              LINEITEM_INTERCEPT, REG)
    return value.withColumn("objective", r6("objective"))


@query
def scale_features_query(spark, folder):
    return cells(scale_features(embedding_points(spark, folder)), "id")


@query
def auroc(spark, folder):
    scored = predict(embedding_points(spark, folder), reference_model().without_threshold(),
                     "score")
    return metrics.auroc(scored).withColumn("auroc", r6("auroc"))


@query
def auroc_ties(spark, folder):
    points = lineitem_points(spark, folder)
    scored = points.select("label", F.col("features")[2].alias("score"))
    return metrics.auroc(scored).withColumn("auroc", r6("auroc"))


# Trainers


@query
def train_linear_pegasos(spark, folder):
    return trained(spark, linear.train_linear_pegasos(
        embedding_points(spark, folder), iterations=5, reg=REG))


@query
def train_linear_pegasos_batch(spark, folder):
    return trained(spark, linear.train_linear_pegasos(
        embedding_points(spark, folder), iterations=12, reg=REG, fraction=0.1, bias=False))


@query
def train_linear_pegasos_lineitem(spark, folder):
    scaled = scale_features(lineitem_points(spark, folder))
    return trained(spark, linear.train_linear_pegasos(scaled, iterations=5, reg=REG))


@query
def train_linear_pegasos_small_batch(spark, folder):
    """Batches that are taken out for many iterations at once."""
    return trained(spark, linear.train_linear_pegasos(
        embedding_points(spark, folder), iterations=12, reg=REG, fraction=0.02, bias=False))


@query
def train_defaults(spark, folder):
    return trained(spark, linear.train_linear_pegasos(embedding_points(spark, folder)))


@query
def train_own_map(spark, folder):
    """A feature map of the caller's, applied while the points are packed."""
    mapping = RandomFourierMap.seeded(WIDTH, 40, seed=7)
    return trained(spark, linear.train_pegasos(
        embedding_points(spark, folder), iterations=5, step=2.0, reg=REG, feature_map=mapping.block))


@query
def train_pegasos(spark, folder):
    return trained(spark, linear.train_pegasos(
        embedding_points(spark, folder), iterations=6, step=2.0, reg=REG, fraction=0.5))


@query
def train_svm_sgd(spark, folder):
    return trained(spark, linear.train_svm_sgd(
        embedding_points(spark, folder), iterations=6, step=3.0, reg=REG))


@query
def train_warm_start(spark, folder):
    return trained(spark, linear.train_svm_sgd(
        embedding_points(spark, folder), iterations=5, reg=REG,
        initial_weights=REFERENCE_WEIGHTS))


@query
def train_with_intercept(spark, folder):
    return trained(spark, linear.train_svm_sgd(
        embedding_points(spark, folder), iterations=5, step=2.0, reg=REG, intercept=True))


@query
def train_scaled(spark, folder):
    return trained(spark, linear.train_svm_sgd(
        embedding_points(spark, folder), iterations=5, reg=REG, intercept=True, scale=True))


@query
def train_rff(spark, folder):
    _, result = linear.train_rff(embedding_points(spark, folder), components=40, map_seed=7,
                                 iterations=5, reg=REG)
    return trained(spark, result)


@query
def train_nystrom(spark, folder):
    _, result = linear.train_nystrom(embedding_points(spark, folder), landmarks=30, map_seed=5,
                                     iterations=5, reg=REG)
    return trained(spark, result)


def kernel_model(spark, folder):
    return train_kernel_pegasos(embedding_points(spark, folder), iterations=ALPHA_DRAWS, reg=REG,
                                kernel="gaussian", biased=True)


@query
def train_kernel_pegasos_query(spark, folder):
    return kernel_model(spark, folder).support.select("id", "y", "alpha")


@query
def predict_kernel(spark, folder):
    model = kernel_model(spark, folder).without_threshold()
    scored = predict(embedding_points(spark, folder), model, "score")
    return scored.select("id", r6("score").alias("score"))


def sweep_result(spark, folder, trainer, dimension, settings, iterations):
    losses = sweeps.sweep(embedding_points(spark, folder), trainer, dimension, settings,
                          iterations=iterations, reg=REG)
    return losses.withColumn("loss", r6("loss"))


@query
def sweep_step(spark, folder):
    pegasos = sweep_result(spark, folder, "pegasos", "step", sweeps.step_settings("pegasos"), 6)
    svm = sweep_result(spark, folder, "svm", "step", sweeps.step_settings("svm"), 6)
    return pegasos.union(svm)


@query
def sweep_batch(spark, folder):
    return sweep_result(spark, folder, "pegasos", "batch", sweeps.batch_settings(), 5)


@query
def sweep_size(spark, folder):
    return sweep_result(spark, folder, "svm", "size", sweeps.size_settings(2.0), 5)


# Feature maps and kernels


@query
def rff_transform(spark, folder):
    points = embedding_points(spark, folder)
    return cells(RandomFourierMap.for_points(points, 40, seed=7).transform(points), "id")


@query
def nystrom_fit(spark, folder):
    fitted = NystromMap.fit(embedding_points(spark, folder), 30, "gaussian", seed=5)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(fitted.normalization)]
    return cells(spark.createDataFrame(rows, "pos int, features array<double>"), "pos")


@query
def nystrom_transform(spark, folder):
    points = embedding_points(spark, folder)
    return cells(NystromMap.fit(points, 30, "gaussian", seed=5).transform(points), "id")


def neighbour_kernel(spark, folder, kernel):
    """Kernel of every point with the next one in the order of ids; the last meets the first."""
    points = ordering.row_index(embedding_points(spark, folder))
    rows = points.count()
    following = points.select(
        F.pmod(F.col("idx") - 1, F.lit(rows)).alias("idx"), F.col("features").alias("other"))
    value = kernel.column(F.col("features"), F.col("other"))
    return points.join(following, "idx").select("id", r6(value).alias("value"))


@query
def kernel_linear(spark, folder):
    return neighbour_kernel(spark, folder, LINEAR)


@query
def kernel_gaussian(spark, folder):
    return neighbour_kernel(spark, folder, GAUSSIAN)


@query
def kernel_polynomial(spark, folder):
    return neighbour_kernel(spark, folder, POLYNOMIAL)


# Prediction


def reference_model():
    return LinearModel(REFERENCE_WEIGHTS, REFERENCE_INTERCEPT)


@query
def predict_linear(spark, folder):
    scored = predict(embedding_points(spark, folder), reference_model().without_threshold(),
                     "score")
    return scored.select("id", r6("score").alias("score"))


@query
def predict_label(spark, folder):
    return predict(embedding_points(spark, folder), reference_model().with_threshold(0.1)).select(
        "id", "prediction")


@query
def predict_label_lineitem(spark, folder):
    model = LinearModel(LINEITEM_WEIGHTS, LINEITEM_INTERCEPT)
    return predict(lineitem_points(spark, folder), model).groupBy("label", "prediction").agg(
        F.count(F.lit(1)).alias("n_rows"))


def narrow_model(spark, folder, axes):
    points = narrow_points(spark, folder, axes)
    return linear.train_linear_pegasos(points, iterations=5, reg=REG).model


@query
def surface_3d_kernel(spark, folder):
    """Surface of a Gaussian kernel model of a generated ball, one point per order.

    The model's weights are those of landmarks: every landmark counts once.
    """
    rows = order_ids(spark, folder).count()
    ball = generators.shape(order_positions(spark, folder), rows, "ball", 3, 0.4, seed=3)
    chosen = sampling.landmarks(ball, 12, seed=5)
    support = support_vectors(chosen, chosen.select("id", F.lit(1.0).alias("alpha")), most_rows=12)
    surface = surfaces.surface_3d(spark, KernelModel(support, GAUSSIAN, 12.0, False, size=(12, 3)))
    return surface.select(r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query
def kernel_gaussian_lineitem(spark, folder):
    """Gaussian kernel of line items, at prices of up to 100,000, against their landmarks."""
    points = lineitem_points(spark, folder)
    near = points.withColumn("features", F.transform("features", lambda v: v / F.lit(50.0)))
    chosen = sampling.landmarks(near, 5, seed=5)
    rows = kernel_rows(near, collect_anchors(chosen), GAUSSIAN)
    return cells(rows.select(F.col("id"), F.col("kernel_row")), "id", column="kernel_row")


@query
def minibatch_lineitem(spark, folder):
    return sampling.minibatch(lineitem_points(spark, folder), 0.1, 3).select("id", "label")


@query
def predict_one(spark, folder):
    """Score of the single vector that is the mean of all embeddings."""
    mean = embedding_points(spark, folder).select(F.posexplode("features").alias("pos", "v")).groupBy(
        "pos").agg(F.avg("v").alias("v")).orderBy("pos")
    vector = [row["v"] for row in mean.collect()]  # one number per dimension
    score = predict_vector(spark, reference_model().without_threshold(), vector)
    label = predict_vector(spark, reference_model().with_threshold(0.1), vector)
    return spark.createDataFrame([(score, label)], "score double, prediction double").withColumn(
        "score", r6("score"))


@query
def own_validators(spark, folder):
    """Whether checks of one's own accept the points: 1 for accepted, 0 for refused."""
    points = embedding_points(spark, folder)
    checks = {
        "width": F.count_if(F.size("features") != 64),
        "unit_length": F.count_if(F.abs(dot(F.col("features"), F.col("features")) - 1.0) > 1e-3),
        "positive": F.count_if(F.exists("features", lambda v: v < 0)),
    }
    return spark.createDataFrame(
        [(name, int(validate.accepted(points, [check]))) for name, check in checks.items()],
        "name string, accepted int")


def absolute_gradient(scores, labels):
    """Distance of score and signed label, and its sub-gradient factor: a rule of one's own."""
    gap = scores - (labels * 2.0 - 1.0)[:, None]
    return np.abs(gap), np.sign(gap)


def halving_update(weights, mean_gradient, step, iteration, reg):
    """A step that halves every iteration, without regularisation."""
    return weights - step * 0.5 ** iteration * mean_gradient, 0.0


@query
def train_own_rule(spark, folder):
    result = linear.train_with_rule(embedding_points(spark, folder), halving_update, iterations=5,
                                    step=2.0, gradient=absolute_gradient)
    return trained(spark, result)


@query
def surface_2d(spark, folder):
    surface = surfaces.surface_2d(spark, narrow_model(spark, folder, 2))
    return surface.select(r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query
def surface_3d(spark, folder):
    surface = surfaces.surface_3d(spark, narrow_model(spark, folder, 3))
    return surface.select(r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


# Generated data: one point per order


def order_positions(spark, folder):
    return ordering.row_index(order_ids(spark, folder)).select("idx")


@query
def gen_linear(spark, folder):
    made = generators.gaussian_classes(order_positions(spark, folder), 8, seed=3)
    return cells(made, "id", "label")


def made_shape(spark, folder, name, axes, sigma):
    rows = order_ids(spark, folder).count()
    made = generators.shape(order_positions(spark, folder), rows, name, axes, sigma, seed=3)
    return cells(made, "id", "label")


for _name, _axes, _sigma in (("linear", 2, 1.0), ("linear", 3, 1.0), ("circle", 2, 0.3),
                             ("mixture", 2, 0.5), ("checkers", 2, 1.0), ("clowns", 2, 0.8),
                             ("ball", 3, 0.4)):
    REGISTERED[f"gen_shape_{_name}_{_axes}d"] = (
        lambda spark, folder, shape=(_name, _axes, _sigma): made_shape(spark, folder, *shape)
    )

_SUFFIX = "_query"
REGISTERED = {k.removesuffix(_SUFFIX): v for k, v in REGISTERED.items()}
