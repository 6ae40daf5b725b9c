import datetime

import pytest
from pyspark.sql import functions as F

from plantcast.functions import rules
from plantcast.functions.columns import clip, exact_round, number_text, title_text, zero_to_one
from plantcast.functions.features import demand_features, overload_share, planning_expressions
from plantcast.plans.scoring import decide_demand
from plantcast.sources import records
from plantcast.sources.schemas import INSPECTION_RECORD

# Forecast, stock, replenishment, expected order quantity.
ORDER_CASES = [(200.0, 50.0, 50.0, 100.0), (200.0, 250.0, 50.0, 0.0), (500.0, 100.0, 200.0, 200.0), (100.0, 150.0, 0.0, 0.0)]


def decided(spark, rows, probability):
    """Records (material, forecast, stock, replenishment) through checks, features and decisions."""
    base = spark.createDataFrame(
        [(m, 1, "NORMAL", f, s, r) for m, f, s, r in rows],
        "material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double",
    )
    ready = demand_features(records.complete_demand(records.accepted(records.check_demand(base))))
    return {r.material_no: r for r in decide_demand(ready, F.col("forecast_qty"), F.lit(probability)).collect()}


def test_order_quantity_cases(spark):
    got = decided(spark, [(f"M-{i}", f, s, r) for i, (f, s, r, _) in enumerate(ORDER_CASES)], 0.1)
    assert [got[f"M-{i}"].recommended_order_qty for i in range(4)] == [c[3] for c in ORDER_CASES]


@pytest.mark.parametrize("probability", [0.0, 0.3, 0.5])
def test_healthy_stock_is_no_shortage(spark, probability):
    got = decided(spark, [(f"M-{i}", 200.0, 200.0 + 5 * i, 150.0) for i in range(50)], probability)
    assert {r.ml_shortage_flag for r in got.values()} == {0}
    assert "High" not in {r.risk_level for r in got.values()}


@pytest.mark.parametrize("probability", [0.0, 0.5, 0.9])
def test_positive_gap_is_always_a_shortage(spark, probability):
    got = decided(spark, [(f"M-{i}", 500.0 + 10 * i, 50.0, 50.0) for i in range(50)], probability)
    assert {r.ml_shortage_flag for r in got.values()} == {1}
    assert all(r.reason == f"Demand exceeds supply by {400 + 10 * i:.1f} units" for i, r in ((int(m[2:]), r) for m, r in got.items()))


def test_single_cases(spark):
    got = decided(spark, [("M-A", 196.0, 343.0, 458.0), ("M-B", 150.0, 50.0, 80.0)], 0.05)
    assert (got["M-A"].demand_gap, got["M-A"].ml_shortage_flag, got["M-A"].risk_level, got["M-A"].recommended_order_qty) == (-605.0, 0, "Low", 0.0)
    assert got["M-B"].demand_gap == 20.0 and got["M-B"].reason == "Demand exceeds supply by 20.0 units"
    assert decided(spark, [("M-A", 196.0, 343.0, 458.0)], 0.61237)["M-A"].reason == "ML predicted shortage (probability: 61.24%)"


def test_required_fields_are_never_defaulted(spark):
    rows = spark.createDataFrame(
        [("M-1", 1, "NORMAL", 200.0, None, 100.0), ("M-2", 1, "NORMAL", 200.0, 100.0, None), ("M-3", 1, "NORMAL", 200.0, 100.0, 1.0)],
        "material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double",
    )
    checked = records.check_demand(rows)
    assert [r.material_no for r in records.accepted(checked).collect()] == ["M-3"]
    assert {r.material_no: r.violations for r in records.rejected(checked).collect()} == {
        "M-1": ["stock_level missing"], "M-2": ["replenishment_order_qty missing"]}


def test_boundaries(spark):
    values = spark.createDataFrame([(v,) for v in (0.39, 0.4, 0.5, 0.51, 0.59, 0.6, 0.69, 0.7)], "p double")
    got = {r.p: r for r in values.select(
        "p", rules.model_flag(F.col("p")).alias("f"), rules.risk_level(F.col("p")).alias("r"), rules.alert_level(F.col("p")).alias("a")).collect()}
    assert [got[p].f for p in (0.5, 0.51)] == [0, 1]
    assert [got[p].r for p in (0.39, 0.4, 0.69, 0.7)] == ["Low", "Medium", "Medium", "High"]
    assert [got[p].a for p in (0.39, 0.4, 0.59, 0.6)] == ["OK", "WARN", "WARN", "ESCALATE"]
    pct = spark.createDataFrame([(4.99,), (5.0,), (9.99,), (10.0,), (None,)], "x double")
    assert [r.s for r in pct.select(rules.scrap_severity(F.col("x")).alias("s")).collect()] == [
        "LOW (Green)", "MEDIUM (Yellow)", "MEDIUM (Yellow)", "HIGH (Red)", None]


def test_null_gap_orders_nothing_and_follows_the_model(spark):
    row = spark.range(1).select(F.lit(None).cast("double").alias("g"), F.lit(0.9).alias("p"))
    got = row.select(rules.recommended_order(F.col("g")), rules.shortage_flag(F.col("p"), F.col("g"))).first()
    assert tuple(got) == (0.0, 1)


def test_number_text_is_exact(spark):
    values = [k / 8 for k in range(-40, 41)] + [k / 1000 for k in range(-60, 61)] + [5e-05, 0.00015, 2.675, 1e-9, 123456.785]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 4):
        for r in df.select("x", number_text(F.col("x"), digits).alias("t"), exact_round(F.col("x"), digits).alias("n")).collect():
            assert r.t == f"{r.x:.{digits}f}"
            assert r.n == round(r.x, digits)


def test_clip_keeps_null_and_titles(spark):
    row = spark.range(1).select(
        clip(F.lit(None).cast("double"), 0.0, 1.0), clip(F.lit(-2.0), 0.0), clip(F.lit(3.0), 0.0, 1.0), zero_to_one(F.lit(0)), title_text(F.lit("order_qty")))
    assert tuple(row.first()) == (None, 0.0, 1.0, 1.0, "Order Qty")


def test_unknown_comparisons_count_as_not_met(spark):
    names = ("stock_level", "replenishment_order_qty", "forecast_qty", "historical_avg_qty", "safety_stock", "reorder_point", "avg_scrap_rate",
             "avg_defect_rate", "otif_pct", "risk_score_m5", "avg_start_delay", "avg_finish_delay", "total_requested_qty", "total_confirmed_qty",
             "vip_order_count", "n_customer_orders", "at_risk_order_count", "avg_wc_utilization", "avg_wc_downtime")
    row = demand_features(spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])).first()
    flags = ("below_safety_stock", "below_reorder", "supplier_risk_flag", "capacity_constraint_flag", "high_downtime_flag")
    assert [row[f] for f in flags] == [0] * 5
    assert row.demand_gap is None and row.customer_confirmation_rate == 0.0


def test_supplier_risk_needs_only_one_known_reason(spark):
    rows = spark.createDataFrame([(80, None, 1), (None, 70, 1), (None, 10, 0), (90, 60, 0), (85, 61, 1)], "otif_pct int, risk_score_m5 int, want int")
    other = [n for n in ("stock_level", "replenishment_order_qty", "forecast_qty", "historical_avg_qty", "safety_stock", "reorder_point", "avg_scrap_rate",
             "avg_defect_rate", "avg_start_delay", "avg_finish_delay", "total_requested_qty", "total_confirmed_qty", "vip_order_count",
             "n_customer_orders", "at_risk_order_count", "avg_wc_utilization", "avg_wc_downtime")]
    full = rows.withColumns({n: F.lit(1.0) for n in other})
    assert all(r.supplier_risk_flag == r.want for r in demand_features(full).collect())


def test_planning_features(spark):
    row = spark.range(1).select(
        F.lit(150).alias("stock_level"), F.lit(199).alias("reorder_point"), F.lit(50).alias("safety_stock"), F.lit(80.0).alias("supplier_otif_pct"),
        F.lit(10).alias("supplier_lead_time_days"), F.lit(100).alias("total_requested_qty"), F.lit(2.5).alias("avg_scrap_rate"),
        F.lit(0).alias("standard_batch_qty"), F.lit(52).alias("week_no"))
    got = row.withColumns(planning_expressions()).first()
    assert got.stock_buffer_ratio == pytest.approx(-49 / 200)
    assert (got.stock_vs_safety, got.otif_gap, got.demand_vs_batch, got.is_peak_season, got.quarter) == (100, 20.0, 100.0, 1, 5)
    assert got.lead_time_risk == pytest.approx(2.0) and got.scrap_adj_demand == pytest.approx(102.5)


def test_overload_share(spark):
    df = spark.createDataFrame([(79.0,), (80.0,), (90.0,), (100.0,)], "u double")
    assert [r[0] for r in df.select(overload_share(F.col("u"))).collect()] == [0.0, 0.0, 0.5, 1.0]


def record_values(**changes):
    record = dict(
        inspection_lot="IL-1", production_order_no=1, inspection_date=None, defect_rate_pct=12.5, scrap_rate_pct=8.2, rework_rate_pct=15.3,
        defect_type="Dimensional", shift="Night", inspected_qty=200, scrap_qty=16, rework_qty=31, scrap_cost_eur=850.5, machine_id="MC-02",
        machine_name="Lathe", machine_type="CNC Lathe", calibration_lag_days=105, maintenance_lag_days=22, calibration_overdue=1, maintenance_overdue=0,
        supplier_name="S", supplier_otif_pct=78.5, supplier_scrap_pct=14.2, supplier_risk_score=72.0, work_centre="WC-01", wc_utilization=88.5,
        wc_overload_prob=0.42, order_overload_prob=0.55, throughput_deviation_pct=-12.3, material_no="M-1", material_group="Metal",
        rolling_scrap_4w_machine_id=9.1, rolling_scrap_4w_shift=10.8)
    record.update(changes)
    return tuple(record[n] for n in INSPECTION_RECORD.fieldNames())


def inspection(spark, **changes):
    return spark.createDataFrame([record_values(**changes)], INSPECTION_RECORD)


@pytest.mark.parametrize("change, broken", [
    ({}, []),
    ({"inspected_qty": 0}, ["inspected_qty out of range"]),
    ({"wc_overload_prob": 1.01}, ["wc_overload_prob out of range"]),
    ({"supplier_name": None, "scrap_rate_pct": -1.0}, ["supplier_name missing", "scrap_rate_pct out of range"]),
    ({"throughput_deviation_pct": -500.0}, []),
])
def test_inspection_ranges(spark, change, broken):
    assert records.check_inspection(inspection(spark, **change)).first().violations == broken


def test_status_texts(spark):
    rows = [("classifier", "roc_auc", 0.96, "EXCELLENT"), ("classifier", "roc_auc", 0.95, "NEEDS REVIEW"), ("probability", "r2", 0.61, "GOOD"),
            ("probability", "r2", 0.6, "NEEDS TUNING"), ("order_qty", "r2", 0.51, "GOOD"), ("order_qty", "r2", 0.5, "ACCEPTABLE"), ("order_qty", "r2", -0.1, "POOR")]
    df = spark.createDataFrame(rows, "t string, m string, v double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", rules.model_status(F.col("m"), F.col("v"), F.col("t"))).collect())


def test_retrain_reasons(spark):
    from plantcast.plans.reports import retrain_reasons

    old = spark.createDataFrame([(datetime.datetime(2026, 1, 1), "m", "roc_auc", 0.9)], "run_ts timestamp, model string, metric string, value double")
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("x",)], "key string")
    now = F.lit("2026-01-29").cast("timestamp")
    assert [r.reason for r in retrain_reasons(old, none, none, now).collect()] == ["schedule"]
    early = F.lit("2026-01-28").cast("timestamp")
    assert [r.reason for r in retrain_reasons(old, some, none, early).collect()] == ["new keys"]
