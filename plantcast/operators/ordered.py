"""Operations that need an order over many rows, without one task ever holding a whole group.

A key may own a third of all rows, and a global order has no key at all. Rows are therefore dealt to range partitions of all
order columns, and the number of its partition, the chunk, is written with each row: range bounds are sampled, so they would
differ from one evaluation to the next. What a chunk needs from the ones before it (a running total, the last few rows) travels
as a small summary per chunk. There is one path for every size; how many chunks there are changes nothing in the results.

Null order values come first. Groups of a null key are groups like any other, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantcast.session import work_path

CHUNK = "_chunk"


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def with_chunk(df: DataFrame, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder with an integer column that never falls along ``order``; by default there are as
    many chunks as shuffle partitions. This write is the only job that an ordered operation runs while it is built."""
    spark = df.sparkSession
    number = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = df.repartitionByRange(number, *_ascending(order)).withColumn(CHUNK, F.spark_partition_id())
    path = work_path(spark, "chunks")
    marked.write.parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns (at least one) of equal names in which null equals null; the left ones stay."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    condition = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(other, condition, how).drop(*[f"_on_{c}" for c in on])


def running_before(
    df: DataFrame, order: Sequence[str], totals: Mapping[str, Column], by: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Per row, the sum of each expression over all rows that come before it in ``order`` (unique within ``by``)."""
    chunked = with_chunk(df, order, chunks)
    group = [*by, CHUNK]
    sums = chunked.groupBy(*group).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()])
    # One row per group and chunk.
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals])
    inside = Window.partitionBy(*group).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumns({f"_l_{n}": F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in totals.items()})
    joined = null_safe_join(local, offsets, group, "left")
    out = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in totals})
    return out.drop(CHUNK, *[f"_l_{n}" for n in totals], *[f"_o_{n}" for n in totals])


def value_counts_before(df: DataFrame, value: str, by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Distinct values that are not null with their count ``n`` and the number of rows below them, ``below``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_before(counts, [value], {"below": F.col("n")}, by, chunks)


def quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles of the values that are not null. Repeated values are counted first, ranks come from
    running counts, so neither the values of a group nor their histogram sit in one task."""
    ranked = value_counts_before(df, value, by, chunks)
    # The size of a group is the rank after its largest value, so the values are not read again.
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("_size"))
    placed = null_safe_join(ranked, sizes, by) if by else ranked.withColumn("_size", sizes.scalar())
    below, after = F.col("below"), F.col("below") + F.col("n")
    picks = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("_size") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((below <= at) & (at < after), F.col(value))).alias(f"_{name}_{side}"))
    picked = placed.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    results = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("_size") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return picked.select(*by, *results)


def kth_row(df: DataFrame, order: Sequence[str], k: Column, by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """The ``k``-th row (from 1) in an order without ties: one struct ``at`` of the order columns per group.

    Counts per chunk locate the chunk that holds the row, and only that chunk is sorted. ``k`` may use
    ``total``, the number of rows of the group.
    """
    chunked = with_chunk(df.select(*by, *order), order, chunks)
    cells = chunked.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select(
        *by, CHUNK, "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("below"),
        F.sum("n").over(Window.partitionBy(*by)).alias("total"),
    ).withColumn("_k", k)
    cell = placed.where((F.col("below") < F.col("_k")) & (F.col("_k") <= F.col("below") + F.col("n"))).select(
        *by, CHUNK, (F.col("_k") - F.col("below")).alias("_rank")
    )
    inside = null_safe_join(chunked, cell, [*by, CHUNK])
    rank = F.row_number().over(Window.partitionBy(*by, CHUNK).orderBy(*_ascending(order)))
    return inside.withColumn("_at", rank).where(F.col("_at") == F.col("_rank")).select(*by, F.struct(*order).alias("at"))


def rolling_means(
    df: DataFrame, value: str, means: Mapping[str, str], order: Sequence[str], rows: int, chunks: int | None = None
) -> DataFrame:
    """Mean of the last ``rows`` rows (fewer at the start) per key in ``order`` (date and id); ``means`` maps each
    new column to its key. A row with a null key belongs to no group and has no mean.

    Rows are grouped by (key, chunk of the order), not by key alone, so three shifts do not mean three tasks.
    The first rows of a group take what they lack from the last rows of the groups before it.
    """
    if rows < 2:
        return df.withColumns({out: F.when(F.col(key).isNotNull(), F.col(value)) for out, key in means.items()}).drop(CHUNK)
    # A frame that holds its chunks already was written for several uses.
    chunked = df if CHUNK in df.columns else with_chunk(df, order, chunks)
    result = chunked
    for out, key in means.items():
        carried = _carried_rows(chunked, value, key, order, rows - 1)
        result = _rolling_by_chunk(result, carried, value, key, order, rows, out)
    return result.drop(CHUNK)


def _carried_rows(chunked: DataFrame, value: str, key: str, order: Sequence[str], prior: int) -> DataFrame:
    """Per (key, chunk), the values of the last rows of up to ``prior`` chunks of the key before it."""
    inside = Window.partitionBy(key, CHUNK).orderBy(*_ascending(order))
    slim = chunked.where(F.col(key).isNotNull()).select(key, CHUNK, *order, value)
    last = slim.withColumn("_next", F.lead(F.lit(1), prior).over(inside)).where(F.col("_next").isNull())
    # At most ``prior`` rows are left per (key, chunk).
    tails = last.groupBy(key, CHUNK).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("_tail"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(-prior, -1)
    return tails.select(key, CHUNK, F.flatten(F.collect_list("_tail").over(before))[value].alias("_carried"))


def _rolling_by_chunk(
    df: DataFrame, carried: DataFrame, value: str, key: str, order: Sequence[str], rows: int, out: str
) -> DataFrame:
    inside = Window.partitionBy(key, CHUNK).orderBy(*_ascending(order))
    frame = inside.rowsBetween(-(rows - 1), 0)
    local = df.select(
        "*",
        F.coalesce(F.sum(value).over(frame), F.lit(0.0)).alias("_sum"),
        F.count(value).over(frame).alias("_count"),
        F.row_number().over(inside).alias("_rank"),
    )
    joined = local.join(carried, [key, CHUNK], "left")
    lacking = F.greatest(F.lit(rows) - F.col("_rank"), F.lit(0))
    size = F.size("_carried")
    borrowed = F.filter(
        F.slice("_carried", F.greatest(size - lacking + 1, F.lit(1)), lacking), lambda x: x.isNotNull()
    )
    known = (lacking > 0) & (size > 0)
    borrowed_sum = F.when(known, F.aggregate(borrowed, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    borrowed_count = F.when(known, F.size(borrowed)).otherwise(0)
    total, count = F.col("_sum") + borrowed_sum, F.col("_count") + borrowed_count
    return joined.withColumn(out, F.when(F.col(key).isNotNull(), F.try_divide(total, count))).drop("_sum", "_count", "_rank", "_carried")


def weekly_lags(df: DataFrame, by: str, week: str, lags: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Earlier values of weekly rows. A key has at most one row per week here, so its group is bounded by
    the calendar and a plain window fits."""
    order = Window.partitionBy(by).orderBy(week)
    return df.withColumns({out: F.lag(c, n).over(order) for out, (c, n) in lags.items()})


def weekly_rolling(df: DataFrame, by: str, week: str, rows: int, means: Mapping[str, str]) -> DataFrame:
    """Mean over the last ``rows`` weekly rows of a key (bounded like :func:`weekly_lags`)."""
    frame = Window.partitionBy(by).orderBy(week).rowsBetween(-(rows - 1), 0)
    return df.withColumns({out: F.avg(c).over(frame) for out, c in means.items()})


def calendar_lags(df: DataFrame, by: Sequence[str], week: str, lags: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Values of the row exactly so many weeks earlier, whatever weeks are missing between; null if there is none.

    ``by`` names the series: with the scenario among its columns, scenarios of one week do not mix. A series has at most one
    row per week, so its group is bounded by the calendar. Rows with a null week have no earlier row.
    """
    order = Window.partitionBy(*by).orderBy(week)
    known = F.col(week).isNotNull()
    return df.withColumns({out: F.when(known, F.first(c).over(order.rangeBetween(-n, -n))) for out, (c, n) in lags.items()})


def calendar_rolling(df: DataFrame, by: Sequence[str], week: str, weeks: int, means: Mapping[str, str]) -> DataFrame:
    """Mean over the rows of the last ``weeks`` calendar weeks of a series, this one included; missing weeks count nothing."""
    frame = Window.partitionBy(*by).orderBy(week).rangeBetween(-(weeks - 1), 0)
    return df.withColumns({out: F.when(F.col(week).isNotNull(), F.avg(c).over(frame)) for out, c in means.items()})
