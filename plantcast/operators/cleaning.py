"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.operators.ordered import quantiles


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the given columns. Said per column, so that a left join whose columns must be known
    becomes an inner one and rows leave before later joins."""
    kinds = dict(df.dtypes)
    known = [F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNotNull() for c in columns]
    return df.where(reduce(and_, known)) if known else df


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def fill_constants(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.na.fill(dict(values))


def fill_mean(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None) -> DataFrame:
    """Null becomes the mean of the column: one aggregate row, read back as a scalar subquery. ``over`` is a
    narrower frame with the same values to average, when ``df`` is expensive."""
    source = df if over is None else over
    means = source.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means.getField(c)) for c in columns})


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the exact median of the column."""
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    medians = quantiles(df.select(F.explode(values).alias("p")).select("p.*"), "v", {"median": 0.5}, ["name"])
    row = medians.agg(F.struct(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), row.getField(c)) for c in columns})


def median_imputer(columns: Sequence[str], relative_error: float = 0.001) -> Imputer:
    """Approximate medians as a pipeline stage, fitted on the training rows."""
    return Imputer(strategy="median", inputCols=list(columns), outputCols=list(columns), relativeError=relative_error)


def drop_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Drop target columns that are present."""
    return df.drop(*targets)


def feature_projection(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features in order as doubles: an absent feature is 0, a null is 0."""
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f)
            for f in features
        ],
    )
