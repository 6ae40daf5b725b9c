"""Train/test splits and folds that do not depend on partitioning.

A split is a threshold in a total order (hash and key, or date and id). Finding the threshold needs counts and
one small sort; applying it is a comparison per row, without a shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.functions.columns import key_hash
from plantcast.operators.ordered import kth_row, null_safe_join, running_before


def _before_or_at(at: Column, *order: str) -> Column:
    """Whether the row's order columns are not after the threshold; a null threshold admits nothing."""
    return F.coalesce(F.struct(*order) <= at, F.lit(False))


def time_split(
    df: DataFrame, date: str, id_col: str, train_share: float = 0.8, out: str = "is_train",
    chunks: int | None = None,
) -> DataFrame:
    """First ``int(share * n)`` rows by date, ties by id."""
    k = F.floor(F.lit(train_share) * F.col("total"))
    at = kth_row(df, [date, id_col], k, chunks=chunks).select("at").scalar()
    return df.withColumn(out, _before_or_at(at, date, id_col))


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", key_hash(key, seed=seed))


def random_split(
    df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, out: str = "is_train",
    chunks: int | None = None,
) -> DataFrame:
    """Exactly ``n - ceil(share * n)`` training rows, the lowest by seeded hash of a unique key."""
    hashed = _hashed(df, key, seed)
    k = F.col("total") - F.ceil(F.lit(test_share) * F.col("total"))
    at = kth_row(hashed, ["_h", key], k, (), chunks).select("at").scalar()
    return hashed.withColumn(out, _before_or_at(at, "_h", key)).drop("_h")


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42, out: str = "is_train",
    chunks: int | None = None,
) -> DataFrame:
    """The same per class; a null label is a class."""
    hashed = _hashed(df, key, seed)
    k = F.col("total") - F.ceil(F.lit(test_share) * F.col("total"))
    found = kth_row(hashed, ["_h", key], k, (label,), chunks).withColumnRenamed("at", "_at")
    # Joined on the class alone, all rows of a class would meet in one task; each threshold is repeated for every part of it.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hashed.withColumn("_part", F.coalesce(F.pmod("_h", F.lit(parts)), F.lit(0)).cast("int"))
    repeated = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    joined = null_safe_join(placed, repeated, [label, "_part"], "left")
    return joined.withColumn(out, _before_or_at(F.col("_at"), "_h", key)).drop("_h", "_part", "_at")


def hash_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number from the hash of the key: narrow, nearly equal sizes."""
    return df.withColumn(out, (key_hash(key, seed=seed) % folds).cast("int"))


def stratified_folds(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, out: str = "fold",
    chunks: int | None = None,
) -> DataFrame:
    """Fold sizes per class differ by at most one: position in hash order modulo the number of folds."""
    hashed = _hashed(df, key, seed)
    placed = running_before(hashed, ["_h", key], {"_before": F.lit(1)}, (label,), chunks)
    return placed.withColumn(out, (F.col("_before") % folds).cast("int")).drop("_h", "_before")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by seeded hash; the same rows whatever the partitioning (a top-n, not a sort)."""
    return df.withColumn("_h", key_hash(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")
