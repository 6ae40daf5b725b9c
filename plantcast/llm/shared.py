"""Helpers of the operators: written intermediate tables and joins that a hot key cannot unbalance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.session import work_path

SALTS = 64
TEXT_ROWS = 1000
TEXT_BYTES = 8 << 20


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage at a table that survives lost executors, fixes values that depend on row order, and tells
    the planner the size in bytes: it broadcasts the table below its limit and shuffles above it.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, name: str, compression: str = "snappy") -> DataFrame:
    """``stored`` in one file per hash bucket of ``key``: later joins on ``key`` shuffle only their other side. ``df`` is shuffled
    once, or not at all if it lies in as many buckets."""
    spark = df.sparkSession
    path = work_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    dealt = df.repartition(buckets, key).write.option("compression", compression).option("path", path)
    dealt.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return spark.table(table)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``), with the rows of a key dealt to ``salts`` partitions.

    ``spread`` is any expression that differs between the rows of a key. The table is copied only to the salts
    that a key really uses, so a key with few rows costs few copies. Null keys match nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    used = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct()
    copies = used.join(table, key)
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def text_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, on both sides of the Python workers: ``TEXT_ROWS`` rows and
    ``TEXT_BYTES``. Spark's own bounds let a batch take 64 MB, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def group_count(rows: int, per_group: int) -> int:
    """Number of groups that hold about ``per_group`` rows each."""
    return max(1, -(-rows // per_group))


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)
