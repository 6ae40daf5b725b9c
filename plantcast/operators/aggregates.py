"""Grain aggregates of the fact tables and descriptive aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantcast.operators.ordered import quantiles
from plantcast.sources.schemas import KEYS

WEEK_KEYS = ("week_no", "scenario")


def production_by_grain(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*KEYS).agg(
        F.avg("start_delay_hrs").alias("avg_start_delay"),
        F.avg("finish_delay_hrs").alias("avg_finish_delay"),
        F.avg("overload_probability").alias("avg_overload_prob"),
        F.avg("throughput_deviation_pct").alias("avg_throughput_dev"),
        F.count("production_order_no").alias("n_orders"),
    )


def scrap_by_grain(lots: DataFrame) -> DataFrame:
    return lots.groupBy(*KEYS).agg(
        F.avg("defect_rate_pct").alias("avg_defect_rate"),
        F.avg("scrap_rate_pct").alias("avg_scrap_rate"),
        F.avg("scrap_risk_probability").alias("avg_scrap_risk"),
        F.coalesce(F.sum("scrap_cost_eur"), F.lit(0.0)).alias("total_scrap_cost"),
    )


def customers_by_grain(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*KEYS).agg(
        F.coalesce(F.sum("requested_qty"), F.lit(0)).alias("total_requested_qty"),
        F.coalesce(F.sum("confirmed_qty"), F.lit(0)).alias("total_confirmed_qty"),
        F.count("customer_order_no").alias("n_customer_orders"),
        F.count_if(F.col("vip_flag") == "Y").alias("vip_order_count"),
        F.count_if(F.col("delivery_status") == "At Risk").alias("at_risk_order_count"),
    )


def work_centres_by_week(utilization: DataFrame) -> DataFrame:
    return utilization.groupBy(*WEEK_KEYS).agg(
        F.avg("utilization_pct").alias("avg_wc_utilization"),
        F.avg("downtime_hrs").alias("avg_wc_downtime"),
        F.avg("delay_hrs").alias("avg_wc_delay"),
        F.avg("overload_probability").alias("avg_wc_overload"),
        F.max("utilization_pct").alias("max_wc_utilization"),
    )


def describe(df: DataFrame, columns: Sequence[str], chunks: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (exact) and max; one row per column."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(values).alias("p")).select("p.*")
    basic = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    quarters = quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"], chunks)
    return basic.join(quarters, "column_name", "left").select("column_name", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def group_share_pct(df: DataFrame, key: str, counted: str, out: str) -> DataFrame:
    """Rows of each group as a percentage of all rows, one row per group."""
    counts = df.groupBy(key).agg(F.count(counted).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy())
    return counts.select(key, (F.col("_n") / total * 100).alias(out))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of (actual, predicted) pairs."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    wide = df.groupBy(actual).agg(*[F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes])
    return wide


# Size of distinct-count sketches as a power of two: the standard error is about 0.8 % at 14.
SKETCH_POWER = 14


def distinct_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], power: int = SKETCH_POWER) -> DataFrame:
    """One mergeable sketch of the distinct values of each column per group, under the column's name. Unlike exact counts
    they have a fixed size, can be stored per week and merged later. Nulls are not counted."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), power).alias(c) for c in columns])


def merged_distinct(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values over all groups of stored sketches, or per coarser group."""
    merged = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c) for c in columns]
    return sketches.groupBy(*by).agg(*merged) if by else sketches.agg(*merged)
