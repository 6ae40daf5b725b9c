"""Mixing of sources to target weights by weighted sampling without replacement.

A source's target in words is met with complete passes over it first; the fraction that remains is a weighted sample.
Each row draws an exponential key ``-ln(u) / weight`` from a hash of the row, rows are taken in ascending order of the
key, and the running sum of sizes ends where it comes nearest to the budget. Only one row of each source marks that
end. It is found without sorting a source: sizes are summed in ``BUCKETS`` ranges of the key per source, and only the
range in which the budget ends is sorted. Every row then compares its key with the mark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantcast.llm.shared import stored, text_batches

BUCKETS = 1 << 14
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
LEAST_QUALITY = 0.05
# Marks that ordinary prose rarely repeats.
JUNK = b"*$%&#@~^<>{}[]|\\=+_/"


def words_and_quality(text: Column) -> Column:
    """Struct of ``size`` (number of words) and ``quality`` (share of bytes that are no junk marks, at least
    ``LEAST_QUALITY``). A null text has no words and the least quality."""

    @F.pandas_udf("size long, quality double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            raws = [t or b"" for t in texts]
            sizes = np.array([len(r.split()) for r in raws], np.int64)
            shares = [len(r.translate(None, JUNK)) / len(r) if r else 0.0 for r in raws]
            yield pd.DataFrame({"size": sizes, "quality": np.maximum(shares, LEAST_QUALITY).astype(float)})

    return of_texts(text.cast("binary"))


def sampling_key(parts: Sequence[Column], quality: Column, seed: int) -> dict[str, Column]:
    """``draw`` (hash of the row) and ``order`` (its exponential key)."""
    draw = F.xxhash64(*parts, F.lit(seed))
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(2.0**53)
    return {"draw": draw, "order": -F.log(u) / quality}


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``source`` and ``source_size``, one row per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. No target passes
    ``max_passes`` times its source's size; what is cut off goes to the others by weight. With sources sorted by limit
    per weight, those below a common level per weight are at their limit, so the level follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_passes)
    ratio = F.col("limit") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumns({"_level": level, "_ratio": ratio})
    common = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)
    return levels.withColumn("_common", common).select(
        "source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("_common._level")).alias("target")
    )


def _bucket(order: Column) -> Column:
    return F.least(F.floor((1 - F.exp(-order)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def decisions(rows: DataFrame, weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``passes`` and ``at``, the last key that the sample takes.

    ``rows`` has ``source``, ``size``, ``order`` and ``draw`` and should be a written table. Rows equal in all four share
    one fate.
    """
    sums = stored(
        rows.groupBy("source", _bucket(F.col("order")).alias("bucket")).agg(F.sum("size").alias("size")), "key-ranges"
    )
    sizes = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = targets(sizes, weights, max_passes).withColumn("passes", passes)
    budgets = stored(wanted.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "budgets")
    # At most BUCKETS rows per source.
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("size").over(running)).withColumnRenamed("source", "_s")
    crossing = ends.join(budgets, F.col("_s").eqNullSafe(F.col("source"))).where(
        (F.col("end") >= F.col("budget")) & (F.col("end") - F.col("size") < F.col("budget"))
    )
    crossing = stored(
        crossing.select(F.col("_s"), F.col("bucket").alias("_b"), (F.col("end") - F.col("size")).alias("before"), "budget"), "crossing"
    )
    inside = rows.join(crossing, F.col("source").eqNullSafe(F.col("_s")) & (_bucket(F.col("order")) == F.col("_b")))
    units = inside.groupBy("source", "before", "budget", "_b", "order", "draw").agg(F.sum("size").alias("size"))
    # One range of the key of each source.
    inner = Window.partitionBy("source").orderBy("order", "draw").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    nearer = units.withColumn("start", start).withColumn("taken", F.col("start") + F.col("size") / 2 <= F.col("budget"))
    marks = nearer.groupBy("source").agg(
        F.max(F.when(F.col("taken"), F.struct("order", "draw"))).alias("_at"), F.max("_b").alias("bucket")
    )
    marks = marks.withColumnRenamed("source", "_s")
    return budgets.join(marks, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "passes", F.col("_at").alias("at"), "bucket"
    )


def mix(rows: DataFrame, table: DataFrame, weights: Sequence[float] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``, the number of times that the mix takes the row.

    ``table`` holds ``source``, ``size``, ``order`` and ``draw`` of the same rows, written. The decisions are one row per
    source, written so that the planner broadcasts them only when they are small.
    """
    decided = stored(decisions(table, weights, max_passes), "decisions")
    joined = rows.join(decided, F.col("source").eqNullSafe(F.col("_source")), "left")
    own = _bucket(F.col("order"))
    sampled = (own < F.col("bucket")) | ((own == F.col("bucket")) & (F.struct("order", "draw") <= F.col("at")))
    copies = F.col("passes") + F.coalesce(sampled, F.lit(False)).cast("long")
    return joined.withColumn("copies", copies).drop("_source", "passes", "at", "bucket")


def with_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """Each row as the struct ``doc``, with ``source``, ``size``, ``draw`` and ``order``.

    Rows with equal key and text draw the same key and share one fate; null keys, texts and sources are values like any
    other. Rows without words have size 0 and are taken no times beyond their source's complete passes.
    """
    text_batches(docs.sparkSession)
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    measured = whole.withColumn("_m", words_and_quality(F.col(f"doc.{text}")))
    keys = sampling_key([F.col(f"doc.{key}"), F.col(f"doc.{text}")], F.col("_m.quality"), seed)
    return measured.select("doc", F.col(f"doc.{source}").alias("source"), F.col("_m.size").alias("size"), *[c.alias(n) for n, c in keys.items()])


def mix_table(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """Without the texts: ``key``, ``source``, ``size``, ``draw`` and ``order`` of every row."""
    keyed = with_keys(docs.select(key, text, source), key, text, source, seed)
    return keyed.select(F.col(f"doc.{key}").alias("key"), "source", "size", "draw", "order")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the same columns."""
    table = stored(mix_table(docs, key, text, source, seed), "mix")
    mixed = mix(with_keys(docs, key, text, source, seed), table)
    times = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return mixed.where(F.col("copies") > 0).select("doc", F.explode(times)).select("doc.*")
