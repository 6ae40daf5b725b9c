"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.sources.casting import PlanningTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the planning tables under a name, with the SQL that gives the same rows."""

    def keep(build: Callable[[PlanningTables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(PlanningTables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def rounded(name: str, digits: int = 8) -> Column:
    """Rounded column under its own name: sums of doubles differ in the last bits between engines."""
    return F.round(F.col(name).cast("double"), digits).alias(name)


def sql_rounded(names: list[str] | tuple[str, ...], digits: int = 8) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) AS {n}" for n in names)
