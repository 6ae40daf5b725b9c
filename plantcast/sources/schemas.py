"""Table schemas, record defaults and validation limits."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def struct_of(text: str) -> T.StructType:
    """``"a string, b int"`` as a StructType of nullable fields."""
    fields = [item.split() for item in text.replace("\n", " ").split(",") if item.strip()]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


KEYS = ("week_no", "material_no", "scenario")

# Column names and types of the input tables.
TABLES: dict[str, T.StructType] = {
    "demand_forecast": struct_of("""
        forecast_id string, week_no int, week_start_date date, week_end_date date, material_no string,
        supplier_id string, forecast_qty double, historical_avg_qty double, seasonal_index double,
        deviation_flag int, confidence_score double, shortage_probability double,
        supplier_lead_time_days int, scenario string"""),
    "material_replenishment": struct_of("""
        replenishment_id string, week_no int, week_start_date date, material_no string, supplier_id string,
        stock_level int, reorder_point int, replenishment_order_qty int, expected_delivery_date date,
        supplier_lead_time_days int, supplier_otif_pct double, shortage_flag int,
        shortage_probability double, scenario string"""),
    "customer_orders": struct_of("""
        customer_order_no string, customer_id string, customer_name string, customer_priority string,
        production_order_no bigint, material_no string, requested_qty int, confirmed_qty int,
        order_date date, requested_delivery_date date, confirmed_delivery_date date, delivery_status string,
        region string, sales_rep string, contract_value_eur double, vip_flag string, scenario string,
        week_no int"""),
    "scrap_quality": struct_of("""
        inspection_lot string, production_order_no bigint, material_no string, work_centre string,
        machine_id string, shift string, inspection_date date, defect_type string, defect_rate_pct double,
        inspected_qty int, scrap_qty int, rework_qty int, scrap_rate_pct double, rework_rate_pct double,
        scrap_risk_probability double, scrap_cost_eur double, action_taken string, inspector_id string,
        scenario string, week_no int"""),
    "material_master": struct_of("""
        material_no string, material_name string, material_group string, primary_supplier_id string,
        unit_cost_eur double, currency string, standard_batch_qty int, unit_of_measure string,
        reorder_point int, safety_stock int, shelf_life_days int"""),
    "supplier_master": struct_of("""
        supplier_id string, supplier_name string, country string, category string, contact_email string,
        contract_start date, contract_end date, avg_lead_time_days int, otif_pct int,
        scrap_contribution_pct double, rework_contribution_pct double, risk_score_m5 int"""),
    "machine_master": struct_of("""
        machine_id string, machine_name string, work_centre string, machine_type string, manufacturer string,
        last_calibration_date date, calibration_interval_days int, last_maintenance_date date,
        maintenance_interval_days int, status string, capacity_units_per_hr int,
        operator_skill_required string"""),
    "production_orders": struct_of("""
        production_order_no bigint, week_no int, material_no string, scenario string,
        start_delay_hrs double, finish_delay_hrs double, overload_probability double,
        throughput_deviation_pct double"""),
    "work_centre_utilization": struct_of("""
        work_centre string, week_no int, scenario string, utilization_pct double, downtime_hrs double,
        delay_hrs double, overload_probability double"""),
    "predictions": struct_of("""
        week_no int, material_no string, actual_shortage_flag int, actual_shortage_prob double,
        actual_order_qty int, pred_shortage_flag int, pred_shortage_confidence double,
        pred_shortage_prob double, pred_order_qty int, stock_level int, reorder_point int,
        supplier_otif double"""),
    "ml_predictions": struct_of("""
        week_no int, material_no string, ml_shortage_flag int, ml_shortage_probability double,
        ml_forecast_qty int, predicted_at timestamp"""),
    "metrics": struct_of("run_ts timestamp, model string, metric string, value double"),
}

# Scoring record of the demand product and the defaults of its optional fields.
DEMAND_REQUIRED = (
    "material_no", "week_no", "scenario", "forecast_qty", "stock_level", "replenishment_order_qty",
)
DEMAND_DEFAULTS: dict[str, float | int] = {
    "historical_avg_qty": 180.0,
    "seasonal_index": 1.0,
    "deviation_flag": 0,
    "confidence_score": 0.8,
    "supplier_lead_time_days": 7,
    "supplier_otif_pct": 85.0,
    "reorder_point": 0.0,
    "safety_stock": 0.0,
    "standard_batch_qty": 0.0,
    "unit_cost_eur": 0.0,
    "otif_pct": 85.0,
    "avg_lead_time_days": 7,
    "risk_score_m5": 50.0,
    "scrap_contribution_pct": 0.0,
    "avg_start_delay": 0.0,
    "avg_finish_delay": 0.0,
    "avg_overload_prob": 0.0,
    "avg_throughput_dev": 0.0,
    "n_orders": 1,
    "avg_defect_rate": 0.0,
    "avg_scrap_rate": 0.0,
    "avg_scrap_risk": 0.0,
    "total_scrap_cost": 0.0,
    "total_requested_qty": 0.0,
    "total_confirmed_qty": 0.0,
    "n_customer_orders": 0,
    "vip_order_count": 0,
    "at_risk_order_count": 0,
    "avg_wc_utilization": 70.0,
    "avg_wc_downtime": 0.0,
    "avg_wc_delay": 0.0,
    "avg_wc_overload": 0.0,
    "max_wc_utilization": 85.0,
}
DEMAND_RECORD = T.StructType(
    [
        T.StructField("material_no", T.StringType()),
        T.StructField("week_no", T.IntegerType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("forecast_qty", T.DoubleType()),
        T.StructField("stock_level", T.DoubleType()),
        T.StructField("replenishment_order_qty", T.DoubleType()),
        *[
            T.StructField(name, T.IntegerType() if isinstance(value, int) else T.DoubleType())
            for name, value in DEMAND_DEFAULTS.items()
        ],
    ]
)

# Scoring record of the scrap product.
INSPECTION_RECORD = struct_of("""
    inspection_lot string, production_order_no bigint, inspection_date string,
    defect_rate_pct double, scrap_rate_pct double, rework_rate_pct double, defect_type string, shift string,
    inspected_qty int, scrap_qty int, rework_qty int, scrap_cost_eur double,
    machine_id string, machine_name string, machine_type string,
    calibration_lag_days int, maintenance_lag_days int, calibration_overdue int, maintenance_overdue int,
    supplier_name string, supplier_otif_pct double, supplier_scrap_pct double, supplier_risk_score double,
    work_centre string, wc_utilization double, wc_overload_prob double, order_overload_prob double,
    throughput_deviation_pct double, material_no string, material_group string,
    rolling_scrap_4w_machine_id double, rolling_scrap_4w_shift double""")
INSPECTION_OPTIONAL = ("inspection_date",)

# Accepted ranges (low, high, low is open) of the inspection record.
INSPECTION_RANGES: dict[str, tuple[float, float | None, bool]] = {
    "defect_rate_pct": (0, 100, False),
    "scrap_rate_pct": (0, 100, False),
    "rework_rate_pct": (0, 100, False),
    "inspected_qty": (0, None, True),
    "scrap_qty": (0, None, False),
    "rework_qty": (0, None, False),
    "scrap_cost_eur": (0, None, False),
    "calibration_lag_days": (0, None, False),
    "maintenance_lag_days": (0, None, False),
    "calibration_overdue": (0, 1, False),
    "maintenance_overdue": (0, 1, False),
    "supplier_otif_pct": (0, 100, False),
    "supplier_scrap_pct": (0, 100, False),
    "supplier_risk_score": (0, 100, False),
    "wc_utilization": (0, 100, False),
    "wc_overload_prob": (0, 1, False),
    "order_overload_prob": (0, 1, False),
}

# Ordered feature lists of the models.
FORECAST_FEATURES = (
    "week_no", "material_encoded", "scenario_encoded",
    "historical_avg_qty", "seasonal_index", "deviation_flag", "confidence_score", "supplier_lead_time_days",
    "stock_level", "reorder_point", "replenishment_order_qty",
    "avg_start_delay", "avg_finish_delay", "avg_overload_prob", "avg_throughput_dev", "n_orders",
    "avg_defect_rate", "avg_scrap_rate", "avg_scrap_risk",
    "unit_cost_eur", "safety_stock", "standard_batch_qty",
    "otif_pct", "avg_lead_time_days", "risk_score_m5",
    "qty_deviation", "qty_deviation_pct", "stock_coverage_weeks", "below_safety_stock", "below_reorder",
    "quality_risk_score", "supplier_risk_flag", "delay_signal", "demand_gap",
    "total_requested_qty", "total_confirmed_qty", "n_customer_orders", "vip_order_count",
    "at_risk_order_count", "customer_demand_gap", "customer_confirmation_rate", "vip_order_ratio",
    "at_risk_order_ratio",
    "avg_wc_utilization", "avg_wc_downtime", "avg_wc_delay", "avg_wc_overload", "max_wc_utilization",
    "capacity_constraint_flag", "high_downtime_flag",
)
SHORTAGE_FEATURES = (
    "week_no", "material_encoded", "scenario_encoded",
    "forecast_qty", "historical_avg_qty", "seasonal_index", "confidence_score", "supplier_lead_time_days",
    "stock_level", "reorder_point", "replenishment_order_qty", "available_supply", "demand_gap",
    "supplier_otif_pct", "avg_start_delay", "avg_overload_prob", "avg_throughput_dev", "avg_scrap_risk",
    "quality_risk_score", "unit_cost_eur", "safety_stock", "otif_pct", "risk_score_m5",
    "qty_deviation_pct", "stock_coverage_weeks", "below_safety_stock", "below_reorder",
    "supplier_risk_flag", "delay_signal",
    "total_confirmed_qty", "n_customer_orders", "vip_order_count", "at_risk_order_count",
    "customer_confirmation_rate", "vip_order_ratio", "at_risk_order_ratio",
    "avg_wc_utilization", "avg_wc_overload", "max_wc_utilization",
    "capacity_constraint_flag", "high_downtime_flag",
)
SCRAP_FEATURES = (
    "defect_rate_pct", "scrap_rate_pct", "rework_rate_pct", "defect_type_encoded", "shift_encoded",
    "calibration_lag_days", "maintenance_lag_days", "calibration_overdue", "maintenance_overdue",
    "machine_type_encoded",
    "supplier_otif_pct", "supplier_scrap_pct", "supplier_risk_score",
    "wc_utilization", "wc_overload_prob", "order_overload_prob", "throughput_deviation_pct",
    "rolling_scrap_4w_machine_id", "rolling_scrap_4w_shift", "material_group_encoded",
    "rework_share", "scrap_cost_per_unit",
)

# Output columns of the scoring jobs.
DEMAND_OUTPUT = (
    "material_no", "week_no", "scenario", "ml_forecast_qty", "ml_shortage_probability", "ml_shortage_flag",
    "demand_gap", "recommended_order_qty", "risk_level", "reason",
)
INSPECTION_CONTEXT = (
    "defect_type", "machine_id", "machine_name", "shift", "work_centre", "supplier_name",
    "supplier_risk_score", "supplier_otif_pct", "calibration_lag_days", "calibration_overdue",
    "maintenance_overdue", "scrap_rate_pct", "rework_rate_pct", "scrap_cost_eur", "wc_utilization",
    "material_no",
)
