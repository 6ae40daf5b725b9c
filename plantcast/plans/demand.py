"""Demand product: star join at the grain (week, material, scenario) and its feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.functions.columns import flag, nz, ratio
from plantcast.functions.features import demand_features, planning_expressions
from plantcast.functions.rules import recommended_order, shortage_flag, shortage_reason
from plantcast.operators.aggregates import (
    WEEK_KEYS,
    customers_by_grain,
    production_by_grain,
    scrap_by_grain,
    work_centres_by_week,
)
from plantcast.operators.encode import apply_encoder, fit_encoder
from plantcast.operators.joins import left_lookup
from plantcast.operators.ordered import weekly_lags, weekly_rolling
from plantcast.sources.schemas import KEYS

REPLENISHMENT = ("stock_level", "shortage_flag", "shortage_probability", "replenishment_order_qty", "supplier_otif_pct")
MATERIAL = ("unit_cost_eur", "reorder_point", "safety_stock", "standard_batch_qty")
SUPPLIER = ("otif_pct", "avg_lead_time_days", "risk_score_m5", "scrap_contribution_pct")


def with_replenishment(forecast: DataFrame, replenishment: DataFrame) -> DataFrame:
    """Stock and replenishment of the same grain; the replenishment's probability keeps its own name."""
    side = replenishment.select(*KEYS, *REPLENISHMENT).withColumnRenamed(
        "shortage_probability", "shortage_probability_replen"
    )
    return forecast.join(side, list(KEYS), "left")


def star_join(
    forecast: DataFrame,
    replenishment: DataFrame,
    production: DataFrame | None = None,
    scrap: DataFrame | None = None,
    customers: DataFrame | None = None,
    work_centres: DataFrame | None = None,
    materials: DataFrame | None = None,
    suppliers: DataFrame | None = None,
) -> DataFrame:
    """Left joins around the forecast. Facts are aggregated to the grain before they are joined, which
    leaves them partitioned by the join keys; a table that is not given is not joined."""
    df = with_replenishment(forecast, replenishment)
    if production is not None:
        df = df.join(production_by_grain(production), list(KEYS), "left")
    if scrap is not None:
        df = df.join(scrap_by_grain(scrap), list(KEYS), "left")
    if customers is not None:
        df = df.join(customers_by_grain(customers), list(KEYS), "left")
    if work_centres is not None:
        df = df.join(work_centres_by_week(work_centres), list(WEEK_KEYS), "left")
    if materials is not None:
        df = left_lookup(df, materials, ["material_no"], MATERIAL)
    if suppliers is not None:
        df = left_lookup(df, suppliers, ["supplier_id"], SUPPLIER)
    return df


def star_from(tables) -> DataFrame:
    """The full star join over a set of planning tables."""
    return star_join(
        tables.demand_forecast(), tables.material_replenishment(), tables.production_orders(),
        tables.scrap_quality(), tables.customer_orders(), tables.work_centre_utilization(),
        tables.material_master(), tables.supplier_master(),
    )


def feature_table(joined: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Joined frame with all demand features."""
    return demand_features(joined, extra)


def demand_encoders(df: DataFrame) -> dict[str, DataFrame]:
    return {"material": fit_encoder(df, "material_no"), "scenario": fit_encoder(df, "scenario")}


def encode_demand(df: DataFrame, encoders: Mapping[str, DataFrame]) -> DataFrame:
    """Codes of material and scenario; unseen values take the first class."""
    out = apply_encoder(df, encoders["material"], "material_no", "material_encoded")
    return apply_encoder(out, encoders["scenario"], "scenario", "scenario_encoded")


def planning_features(joined: DataFrame, probability: str = "shortage_probability_replen") -> DataFrame:
    """Features of the three-target variant: buffers, supplier risk, lags and rolling means per material."""
    df = joined.withColumns(planning_expressions())
    df = weekly_lags(
        df, "material_no", "week_no",
        {
            "stock_level_lag1": ("stock_level", 1),
            "stock_level_lag2": ("stock_level", 2),
            "shortage_prob_lag1": (probability, 1),
        },
    )
    return weekly_rolling(
        df, "material_no", "week_no", 3, {"stock_roll3": "stock_level", "demand_roll3": "forecast_qty"}
    )


def shortage_report(tables) -> DataFrame:
    """Gap, order quantity and reason per forecast row, by the rules alone (probability 0)."""
    joined = star_join(
        tables.demand_forecast(), tables.material_replenishment(), customers=tables.customer_orders(),
        materials=tables.material_master(), suppliers=tables.supplier_master(),
    )
    c = F.col
    gap = c("forecast_qty") - (c("stock_level") + c("replenishment_order_qty"))
    none = F.lit(0.0)
    requested = F.coalesce(c("total_requested_qty"), F.lit(0))
    return joined.select(
        *KEYS,
        "supplier_id",
        gap.alias("demand_gap"),
        flag(c("stock_level") < c("safety_stock")).alias("below_safety_stock"),
        ratio(nz("vip_order_count"), nz("n_customer_orders")).alias("vip_order_ratio"),
        requested.alias("requested_qty"),
        c("otif_pct"),
        shortage_flag(none, gap).alias("shortage_flag"),
        recommended_order(gap).alias("recommended_order_qty"),
        shortage_reason(none, gap).alias("reason"),
    )
