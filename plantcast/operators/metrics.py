"""Model quality as aggregate queries over a frame of actual and predicted columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.functions.columns import exact_round
from plantcast.operators.ordered import running_before

# Fixed value: smallest divisor of the percentage error.
PERCENT_EPSILON = 2.220446049250313e-16


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def mae(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(_num(actual) - _num(predicted)))


def rmse(actual: str, predicted: str) -> Column:
    return F.sqrt(F.avg(F.pow(_num(actual) - _num(predicted), F.lit(2.0))))


def mape(actual: str, predicted: str) -> Column:
    """Mean share of the absolute error; the divisor is at least the smallest double step."""
    size = F.abs(_num(actual))
    divisor = F.when(size < PERCENT_EPSILON, F.lit(PERCENT_EPSILON)).otherwise(size)
    return F.avg(F.abs(_num(actual) - _num(predicted)) / divisor)


def accuracy(actual: str, predicted: str) -> Column:
    return F.avg((F.col(actual) == F.col(predicted)).cast("double"))


def r2(actual: str, predicted: str) -> Column:
    """1 - SSE/SST over the rows that have both, in one pass: Spark's variance keeps central moments, so large values
    keep their digits. A constant target scores 0, or 1 when every prediction is exact."""
    known = F.when(F.col(predicted).isNotNull(), _num(actual))
    sse = F.sum(F.pow(known - _num(predicted), F.lit(2.0)))
    sst = F.var_pop(known) * F.count(known)
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


def regression_columns(actual: str, predicted: str) -> dict[str, Column]:
    """Aggregates over the rows that have both values."""
    return {
        "mae": mae(actual, predicted), "rmse": rmse(actual, predicted), "r2": r2(actual, predicted), "mape": mape(actual, predicted),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, rmse, r2, mape."""
    return df.agg(*[c.alias(n) for n, c in regression_columns(actual, predicted).items()])


def _counts(actual: str, predicted: str, positive: int = 1) -> tuple[Column, Column, Column]:
    a, p = F.col(actual) == positive, F.col(predicted) == positive
    return F.count_if(a & p), F.count_if(~a & p), F.count_if(a & ~p)


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def binary_columns(actual: str, predicted: str) -> dict[str, Column]:
    """Aggregates accuracy, precision, recall, F1 of class 1; a zero divisor scores 0."""
    tp, fp, fn = _counts(actual, predicted)
    return {
        "accuracy": accuracy(actual, predicted), "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn),
        "f1_score": _safe(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of class 1."""
    return df.agg(*[c.alias(n) for n, c in binary_columns(actual, predicted).items()])


def roc_auc(df: DataFrame, actual: str, score: str, chunks: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half. Equal scores are merged first; the running count
    of negatives below a score is built from chunks of scores. Rows without a label or a score are left out."""
    positive = F.col(actual) == 1
    known = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    placed = running_before(counts, [score], {"neg_below": F.col("neg")}, chunks=chunks)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    return placed.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def classifier_metrics_frame(df: DataFrame, actual: str, predicted: str, score: str) -> DataFrame:
    """One row: accuracy, precision, recall, F1 and roc_auc."""
    return binary_metrics(df, actual, predicted).withColumn("roc_auc", roc_auc(df, actual, score).scalar())


def class_report(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means and the accuracy."""
    pairs = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    labels = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    # The pair table has at most (classes squared) rows.
    spread = pairs.select("*", labels)
    is_actual, is_predicted = F.col(actual) == F.col("class"), F.col(predicted) == F.col("class")
    tally = spread.groupBy("class").agg(
        F.sum(F.when(is_actual & is_predicted, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_predicted, F.col("n")).otherwise(0)).alias("chosen"),
        F.sum(F.when(is_actual, F.col("n")).otherwise(0)).alias("support"),
    )
    scored = tally.select(
        F.col("class").cast("string").alias("class"),
        _safe(F.col("tp"), F.col("chosen")).alias("precision"),
        _safe(F.col("tp"), F.col("support")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("chosen") + F.col("support")).alias("f1_score"),
        "support",
    )
    names = ("precision", "recall", "f1_score")
    macro = scored.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[_safe(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    hit = tally.agg(_safe(F.sum("tp"), F.sum("support")).alias("a"), F.sum("support").alias("support"))
    total = hit.select(F.lit("accuracy").alias("class"), *[F.col("a").alias(n) for n in names], "support")
    return (
        scored.unionByName(total)
        .unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def long_metrics(wide: DataFrame, model: str, decimals: int | None = 4) -> DataFrame:
    """A one-row metric frame as rows (model, metric, value), rounded."""
    names = wide.columns
    values = [(exact_round(F.col(n).cast("double"), decimals) if decimals is not None else F.col(n).cast("double")) for n in names]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in zip(names, values)])
    return wide.select(F.explode(pairs).alias("m")).select(F.lit(model).alias("model"), "m.metric", "m.value")


def stack_metrics(parts: Mapping[str, DataFrame], decimals: int | None = 4) -> DataFrame:
    """Metric frames of several models as one long table."""
    out = None
    for model, wide in parts.items():
        part = long_metrics(wide, model, decimals)
        out = part if out is None else out.unionByName(part)
    return out


def importance_frame(spark, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Feature importances, one row per feature of the model."""
    return spark.createDataFrame(list(zip(names, map(float, weights))), "feature string, importance double")
