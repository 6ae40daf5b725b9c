"""Early stopping with patience for boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame

# Up to this number of rows all fits of a model run side by side.
FEW_ROWS = 2_000_000
# Rows that a partition may hold when partitions are put together for fits side by side.
PARTITION_ROWS = 500_000


def best_round(errors: Sequence[float], patience: int) -> int:
    """Number of rounds to keep: those up to the smallest error before ``patience`` rounds in a row brought no smaller one."""
    best, at = float("inf"), 0
    for i, error in enumerate(errors, 1):
        if error < best:
            best, at = error, i
        elif i - at >= patience:
            break
    return at or len(errors)


def keep_rounds(model, rounds: int):
    """The same boosted model with its first ``rounds`` trees. MLlib has no such call in Python, so the ensemble is built
    by its constructor in the JVM."""
    context, java = SparkContext.getOrCreate(), model._java_obj
    package, trees, steps = context._jvm.org.apache.spark.ml, java.trees(), java.treeWeights()
    kept = context._gateway.new_array(package.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for i in range(rounds):
        kept[i], weights[i] = trees[i], steps[i]
    if isinstance(model, GBTClassificationModel):
        short = GBTClassificationModel(package.classification.GBTClassificationModel(model.uid, kept, weights, model.numFeatures, 2))
    else:
        short = GBTRegressionModel(package.regression.GBTRegressionModel(model.uid, kept, weights, model.numFeatures))
    return model._copyValues(short)


def fit_with_patience(learner, train: DataFrame, validation: DataFrame, patience: int):
    """Fits all rounds on ``train`` and keeps those up to the best round on ``validation``.

    MLlib's own rule ends at the first round that gains too little; here a plateau ends training only after ``patience``
    rounds. The errors of all rounds come from one pass over the validation rows. Returns the model and the number of rounds
    kept; without validation rows all are.
    """
    model = learner.fit(train)
    if validation.isEmpty():
        return model, model.getNumTrees
    classifier = isinstance(model, GBTClassificationModel)
    errors = model.evaluateEachIteration(validation) if classifier else model.evaluateEachIteration(validation, "squared")
    kept = best_round(list(errors), patience)
    return (model if kept == model.getNumTrees else keep_rounds(model, kept)), kept


def fits_at_once(rows: DataFrame) -> int:
    """How many fits over ``rows`` run at once: each holds its own binned rows, in memory as long as they are few."""
    return 8 if rows.count() <= FEW_ROWS else 4


def in_few_partitions(rows: DataFrame, fits: int, most: int = PARTITION_ROWS) -> DataFrame:
    """``rows`` in fewer partitions, of up to about ``most`` rows, when ``fits`` boosted fits side by side still keep all cores busy.

    A round caches two blocks per partition, and Spark samples each to estimate its size: work per block, whatever it holds.
    """
    parts, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-3 * cores // (2 * fits)), -(-rows.count() // most))
    # As many old partitions in each new one.
    return rows.coalesce(-(-parts // (parts // wanted))) if parts >= 2 * wanted else rows


def in_parallel(jobs: Sequence[Callable[[], object]], threads: int = 4) -> list:
    """Results of independent Spark jobs, submitted from a few threads."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(job)(), jobs)
