"""Times the headline queries and prints one JSON line.

``wide_*`` trains on 1,000 features for 100 iterations, one generated point per
row of ``orders``: 150,000 points at sf0.1, as text about 1 GB. Its time is that
of the training loop on cached data; packing is timed on its own.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WIDE_FEATURES = 1000
WIDE_ITERATIONS = 100


def session(cpus: str | None = None) -> SparkSession:
    # One thread per task for dense algebra; tasks already use all cores.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def wide_trainings(spark: SparkSession, timed) -> None:
    from hingeworks.operators.blocks import pack_and_check
    from hingeworks.operators.ordering import row_index
    from hingeworks.operators.updates import pegasos_update
    from hingeworks.plans.descent import Descent, Setting, descend
    from hingeworks.sources.generators import gaussian_classes
    from query_catalog.inputs import order_ids

    indices = row_index(order_ids(spark, FOLDER)).select("idx")
    points = gaussian_classes(indices.repartition(32), WIDE_FEATURES, seed=1)
    start = np.zeros(WIDE_FEATURES)
    descent = Descent(WIDE_ITERATIONS, 0.01, pegasos_update)
    # The layout that a trainer packs for these fractions.
    for name, by_row, fractions in (("wide_pack", False, (1.0,)), ("wide_pack_rows", True, (0.1, 0.01))):
        packed = []
        timed(name, lambda: packed.append(pack_and_check(points, by_row=by_row)))
        for fraction in fractions:
            timed(f"wide_pegasos_batch_{fraction}",
                  lambda: descend(packed[0], start, descent, [Setting(3.0, fraction)]))
        packed[0].release()


def main() -> None:
    spark = session()
    from query_catalog.queries import REGISTERED

    seconds: dict[str, float] = {}

    def timed(name, action):
        began = time.monotonic()
        action()
        seconds[name] = round(time.monotonic() - began, 3)

    # The first Python task of a session starts the workers.
    REGISTERED["predict_linear"](spark, FOLDER).count()
    REGISTERED["hinge_gradient"](spark, FOLDER).count()
    for name in (
        "hinge_gradient", "hinge_gradient_lineitem", "objective_lineitem", "auroc_ties",
        "row_index", "minibatch", "landmarks", "train_test_split", "draws", "rff_transform",
        "nystrom_transform", "predict_linear", "predict_label_lineitem",
        "train_linear_pegasos", "train_linear_pegasos_lineitem", "train_pegasos",
        "train_svm_sgd", "train_kernel_pegasos", "predict_kernel", "sweep_batch", "surface_3d",
        "gen_linear",
    ):
        timed(name, lambda: REGISTERED[name](spark, FOLDER).write.format("noop").mode(
            "overwrite").save())
    wide_trainings(spark, timed)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
