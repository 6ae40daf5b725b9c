"""Category encoders as two-column frames (value, code)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.operators.ordered import running_before

# Codes of shifts and defect types.
SHIFT_CODES = {"Morning": 0, "Afternoon": 1, "Night": 2}
DEFECT_CODES = {
    "Operator Error": 0, "Dimensional": 1, "Material Fault": 2, "Surface Finish": 3, "Machine Setup": 4,
}


def fit_encoder(df: DataFrame, column: str, chunks: int | None = None) -> DataFrame:
    """Codes 0, 1, ... by sorted distinct value; nulls have no code."""
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    coded = running_before(values, ["value"], {"code": F.lit(1)}, chunks=chunks)
    return coded.select("value", F.col("code").cast("int").alias("code"))


def apply_encoder(df: DataFrame, encoder: DataFrame, column: str, out: str, unknown: int = 0) -> DataFrame:
    """Add the code of a column; unseen values (and nulls) get ``unknown``."""
    codes = encoder.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(codes, F.col(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(unknown))).drop("_value", "_code")


def fixed_code(c: Column, codes: Mapping[str, int], unknown: int = 0) -> Column:
    """Code from a fixed dictionary."""
    pairs = [F.lit(part) for pair in codes.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(unknown))


def named_encoders(encoders: Mapping[str, DataFrame]) -> DataFrame:
    """Several encoders as one frame (encoder, value, code), ready to be written."""
    out = None
    for name, frame in encoders.items():
        part = frame.select(F.lit(name).alias("encoder"), "value", "code")
        out = part if out is None else out.unionByName(part)
    return out


def pick_encoder(stored: DataFrame, name: str) -> DataFrame:
    return stored.where(F.col("encoder") == name).select("value", "code")
