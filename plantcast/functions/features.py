"""Scalar features of both products. Each entry is one column expression; Catalyst folds a dict of
them into one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.functions.columns import clip, flag, nz, ratio, zero_to_one

# Limits used by the features.
OTIF_LIMIT, SUPPLIER_RISK_LIMIT = 85, 60
CAPACITY_LIMIT, DOWNTIME_LIMIT = 80, 0.5
PEAK_WEEKS = (48, 49, 50, 51, 52)
TARGET_RISK = 0.40


def demand_expressions() -> dict[str, Column]:
    """Features of one (week, material, scenario) row of the joined demand frame."""
    c = F.col
    supply = c("stock_level") + c("replenishment_order_qty")
    deviation = c("forecast_qty") - c("historical_avg_qty")
    return {
        "available_supply": supply,
        "demand_gap": c("forecast_qty") - supply,
        "qty_deviation": deviation,
        "qty_deviation_pct": ratio(deviation, c("historical_avg_qty")),
        "stock_coverage_weeks": ratio(c("stock_level"), c("forecast_qty")),
        "below_safety_stock": flag(c("stock_level") < c("safety_stock")),
        "below_reorder": flag(c("stock_level") < c("reorder_point")),
        "quality_risk_score": nz("avg_scrap_rate") + nz("avg_defect_rate"),
        "supplier_risk_flag": F.greatest(
            flag(c("otif_pct") < OTIF_LIMIT), flag(c("risk_score_m5") > SUPPLIER_RISK_LIMIT)
        ),
        "delay_signal": nz("avg_start_delay") + nz("avg_finish_delay"),
        "customer_demand_gap": nz("total_requested_qty") - nz("total_confirmed_qty"),
        "customer_confirmation_rate": ratio(nz("total_confirmed_qty"), nz("total_requested_qty")),
        "vip_order_ratio": ratio(nz("vip_order_count"), nz("n_customer_orders")),
        "at_risk_order_ratio": ratio(nz("at_risk_order_count"), nz("n_customer_orders")),
        "capacity_constraint_flag": flag(nz("avg_wc_utilization") > CAPACITY_LIMIT),
        "high_downtime_flag": flag(nz("avg_wc_downtime") > DOWNTIME_LIMIT),
    }


def demand_features(df: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """All demand features; ``extra`` adds the caller's own expressions."""
    return df.withColumns({**demand_expressions(), **(extra or {})})


def planning_expressions(ordered_qty: str = "total_requested_qty") -> dict[str, Column]:
    """Supply-buffer, supplier and calendar features of the three-target variant."""
    c = F.col
    return {
        "stock_buffer_ratio": (c("stock_level") - c("reorder_point")) / (c("reorder_point") + 1),
        "stock_vs_safety": c("stock_level") - c("safety_stock"),
        "otif_gap": F.lit(100) - c("supplier_otif_pct"),
        "lead_time_risk": c("supplier_lead_time_days") * (1 - c("supplier_otif_pct") / 100),
        "scrap_adj_demand": nz(ordered_qty) * (1 + nz("avg_scrap_rate") / 100),
        "demand_vs_batch": nz(ordered_qty) / zero_to_one(c("standard_batch_qty").cast("double")),
        "is_peak_season": flag(c("week_no").isin(*PEAK_WEEKS)),
        "quarter": (F.floor(c("week_no") / 13) + 1).cast("int"),
    }


def machine_lag_expressions(as_of: str) -> dict[str, Column]:
    """Days since calibration and maintenance at a given date, and whether they are over their interval."""
    day = F.lit(as_of).cast("date")
    out: dict[str, Column] = {}
    for kind in ("calibration", "maintenance"):
        lag = F.datediff(day, F.col(f"last_{kind}_date"))
        out[f"{kind}_lag_days"] = lag
        out[f"{kind}_overdue"] = flag(lag > F.col(f"{kind}_interval_days"))
    return out


def scrap_cost_expressions() -> dict[str, Column]:
    return {"scrap_cost_eur": F.col("scrap_qty") * F.col("unit_cost_eur")}


def lot_ratio_expressions() -> dict[str, Column]:
    """Ratios computed the same way for training rows and scoring records."""
    c = F.col
    return {
        "rework_share": ratio(c("rework_qty"), c("scrap_qty") + c("rework_qty")),
        "scrap_cost_per_unit": ratio(c("scrap_cost_eur"), c("inspected_qty")),
    }


def overload_share(utilization: Column) -> Column:
    """How far a utilisation above the limit reaches into the last 20 points."""
    return F.when(utilization > CAPACITY_LIMIT, (utilization - CAPACITY_LIMIT) / 20).otherwise(F.lit(0.0))


def standard_score_clipped(value: Column, mean: Column, deviation: Column) -> Column:
    return clip((value - mean) / F.nullif(deviation, F.lit(0.0)), 0.0, 1.0)


def deviation_pct(value: Column, mean: Column) -> Column:
    return (value - mean) / F.nullif(mean, F.lit(0.0)) * 100


def risk_target(probability: Column) -> Column:
    return flag(probability >= TARGET_RISK)
