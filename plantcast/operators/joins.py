"""Joins of the star schema.

File-backed dimensions are joined without a hint: Spark knows their size and broadcasts below its limit;
above it, the shuffle join is split on hot keys by adaptive execution. The same holds for derived frames, whose bytes
adaptive execution knows at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def left_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join with only the wanted columns of the other side."""
    return df.join(dim.select(*on, *columns), list(on), "left")


def left_lookup_renamed(df: DataFrame, dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys; both keys stay."""
    return df.join(dim, F.col(left_key) == F.col(right_key), "left")


def unseen_keys(df: DataFrame, known: DataFrame, column: str, known_column: str = "value") -> DataFrame:
    """Distinct keys of ``df`` that the encoder has not seen."""
    keys = df.select(column).distinct()
    return keys.join(known.select(F.col(known_column).alias(column)), column, "left_anti")


def known_rows(df: DataFrame, known: DataFrame, column: str, known_column: str = "value") -> DataFrame:
    """Rows whose key the encoder knows."""
    return df.join(known.select(F.col(known_column).alias(column)), column, "left_semi")
