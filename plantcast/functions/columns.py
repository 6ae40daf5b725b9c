"""Small column helpers shared by features, rules and metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6


def nz(c: Column | str) -> Column:
    """Null as zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0.0))


def flag(condition: Column) -> Column:
    """Condition as 0/1; an unknown condition counts as not met."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with the small constant that keeps the divisor away from zero."""
    return numerator / (denominator + F.lit(EPSILON))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value and keep null as null."""
    out = c
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    return out


def zero_to_one(c: Column) -> Column:
    """Replace a zero divisor by one."""
    return F.when(c == 0, F.lit(1).cast("double")).otherwise(c)


def number_text(c: Column, decimals: int) -> Column:
    """Fixed decimals, no thousands mark, rounded half-even on the exact binary value.

    The formatter drops a value just above half a unit of the last place, so values below one unit are
    settled by a comparison first.
    """
    if decimals == 0:
        return F.call_function("format_number", c, F.lit("0"))
    unit, half = float(f"1e-{decimals}"), float(f"5e-{decimals + 1}")
    size = F.abs(c)
    settled = F.when((size < unit) & (size >= half), F.signum(c) * unit).otherwise(c)
    return F.call_function("format_number", settled, F.lit("0." + "0" * decimals))


def exact_round(c: Column, decimals: int) -> Column:
    """Rounding on the exact binary value (``F.round`` rounds the decimal text of the double)."""
    return number_text(c, decimals).cast("double")


def percent_text(c: Column, decimals: int) -> Column:
    return F.concat(number_text(c * 100, decimals), F.lit("%"))


def title_text(c: Column) -> Column:
    """``model_name`` as ``Model Name``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Absent columns become the default; absent fields (null) of present columns too."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names stripped, lower case, blanks as underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def key_hash(*keys: Column | str, seed: int = 0) -> Column:
    """Portable 32-bit hash of a key: the same number on every engine that has md5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys],
                       F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
