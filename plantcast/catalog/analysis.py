"""Queries: aggregates, windows, top-k, features, encoders, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantcast.catalog.registry import query, rounded, sql_rounded
from plantcast.catalog.views import flag, with_views
from plantcast.functions.columns import key_hash
from plantcast.functions.features import PEAK_WEEKS, lot_ratio_expressions, planning_expressions
from plantcast.operators import aggregates as agg
from plantcast.operators import metrics, split
from plantcast.operators.encode import DEFECT_CODES, SHIFT_CODES, apply_encoder, fit_encoder, fixed_code
from plantcast.operators.keyed import latest_per_key
from plantcast.operators.ordered import calendar_lags, calendar_rolling, quantiles, rolling_means, weekly_lags, weekly_rolling
from plantcast.plans import demand, scrap
from plantcast.plans.reports import high_risk
from plantcast.sources.schemas import KEYS, SCRAP_FEATURES

# Aggregates.

_PRODUCTION = ("avg_start_delay", "avg_finish_delay", "avg_overload_prob", "avg_throughput_dev")


@query("agg_production", with_views(f"SELECT week_no, material_no, scenario, n_orders, {sql_rounded(_PRODUCTION)} FROM production_grain", "production_grain"))
def agg_production(t):
    return agg.production_by_grain(t.production_orders()).select(*KEYS, "n_orders", *[rounded(c) for c in _PRODUCTION])


_SCRAP = ("avg_defect_rate", "avg_scrap_rate", "avg_scrap_risk", "total_scrap_cost")


@query("agg_scrap", with_views(f"SELECT week_no, material_no, scenario, {sql_rounded(_SCRAP)} FROM scrap_grain", "scrap_grain"))
def agg_scrap(t):
    return agg.scrap_by_grain(t.scrap_quality()).select(*KEYS, *[rounded(c) for c in _SCRAP])


@query("agg_customers", with_views("SELECT * FROM customer_grain", "customer_grain"))
def agg_customers(t):
    return agg.customers_by_grain(t.customer_orders())


_WC = ("avg_wc_utilization", "avg_wc_downtime", "avg_wc_delay", "avg_wc_overload", "max_wc_utilization")


@query("agg_work_centres", with_views(f"SELECT week_no, scenario, {sql_rounded(_WC)} FROM work_centre_week", "work_centre_week"))
def agg_work_centres(t):
    return agg.work_centres_by_week(t.work_centre_utilization()).select("week_no", "scenario", *[rounded(c) for c in _WC])


@query("agg_conditional_counts", with_views("""
  SELECT count(*) FILTER (forecast_qty > stock_level + replenishment_order_qty) AS n_shortage, count(*) FILTER (stock_level IS NULL) AS n_without_stock,
    count(*) FILTER (scenario = 'NORMAL') AS n_normal, count(*) AS n
  FROM demand_forecast LEFT JOIN material_replenishment USING (week_no, material_no, scenario)""", "demand_forecast", "material_replenishment"))
def agg_conditional_counts(t):
    df = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    c = F.col
    return df.agg(
        F.count_if(c("forecast_qty") > c("stock_level") + c("replenishment_order_qty")).alias("n_shortage"),
        F.count_if(c("stock_level").isNull()).alias("n_without_stock"),
        F.count_if(c("scenario") == "NORMAL").alias("n_normal"),
        F.count(F.lit(1)).alias("n"),
    )


@query("agg_means_and_spread", with_views("""
  SELECT round(avg(inspected_qty), 8) AS mean_qty, round(stddev_samp(inspected_qty), 8) AS std_qty, round(avg(scrap_rate_pct), 8) AS mean_rate,
    min(inspection_date) AS first_date, max(inspection_date) AS last_date, count(DISTINCT machine_id) AS n_machines, count(DISTINCT material_no) AS n_materials
  FROM scrap_quality""", "scrap_quality"))
def agg_means_and_spread(t):
    return t.scrap_quality().agg(
        F.round(F.avg("inspected_qty"), 8).alias("mean_qty"), F.round(F.stddev_samp("inspected_qty"), 8).alias("std_qty"),
        F.round(F.avg("scrap_rate_pct"), 8).alias("mean_rate"), F.min("inspection_date").alias("first_date"),
        F.max("inspection_date").alias("last_date"), F.count_distinct("machine_id").alias("n_machines"),
        F.count_distinct("material_no").alias("n_materials"),
    )


SKETCHED = ("machine_id", "material_no", "inspection_lot")


@query("agg_distinct_sketches", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, true AS weeks_within_bound FROM scrap_quality" for c in SKETCHED), "scrap_quality"))
def agg_distinct_sketches(t):
    """Distinct counts from sketches kept per day and merged, beside the exact counts: they must lie within four standard
    errors (3.3 %, or one)."""
    lots = t.scrap_quality().select("inspection_date", *SKETCHED)
    estimated = agg.merged_distinct(agg.distinct_sketches(lots, ["inspection_date"], SKETCHED), SKETCHED)
    exact = lots.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED])
    values = [df.unpivot([], list(SKETCHED), "column_name", name) for df, name in ((exact, "n_exact"), (estimated, "n_merged"))]
    both = values[0].join(values[1], "column_name")
    bound = F.greatest(F.lit(1.0), F.col("n_exact") * 0.033)
    return both.select("column_name", "n_exact", (F.abs(F.col("n_merged") - F.col("n_exact")) <= bound).alias("weeks_within_bound"))


def _describe_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count({column}) AS n, round(avg({column}), 8) AS mean, round(stddev_samp({column}), 8) AS std,
      round(min({column})::DOUBLE, 8) AS min, round(quantile_cont({column}::DOUBLE, 25e-2), 8) AS q25, round(quantile_cont({column}::DOUBLE, 5e-1), 8) AS q50,
      round(quantile_cont({column}::DOUBLE, 75e-2), 8) AS q75, round(max({column})::DOUBLE, 8) AS max FROM {source}"""


@query("agg_describe", with_views(" UNION ALL ".join(_describe_sql("scrap_quality", c) for c in ("scrap_risk_probability", "inspected_qty", "defect_rate_pct")), "scrap_quality"))
def agg_describe(t):
    out = agg.describe(t.scrap_quality(), ["scrap_risk_probability", "inspected_qty", "defect_rate_pct"])
    return out.select("column_name", "n", *[rounded(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("agg_describe_gap", with_views(_describe_sql("features", "demand_gap"), "features"))
def agg_describe_gap(t):
    df = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    gap = df.select((F.col("forecast_qty") - (F.col("stock_level") + F.col("replenishment_order_qty"))).alias("demand_gap"))
    return agg.describe(gap, ["demand_gap"]).select("column_name", "n", *[rounded(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("agg_class_distribution", with_views(f"""
  SELECT target, count(*) AS n, round(count(*) / (SELECT count(*) FROM scrap_quality), 8) AS share
  FROM (SELECT {flag('scrap_risk_probability >= 4e-1')} AS target FROM scrap_quality) GROUP BY 1""", "scrap_quality"))
def agg_class_distribution(t):
    labelled = t.scrap_quality().select((F.col("scrap_risk_probability") >= 0.4).cast("int").alias("target"))
    return agg.class_distribution(labelled, "target").select("target", "n", rounded("share"))


@query("agg_median_by_group", with_views("SELECT defect_type, round(median(scrap_rate_pct), 8) AS median_rate FROM scrap_quality GROUP BY 1", "scrap_quality"))
def agg_median_by_group(t):
    return quantiles(t.scrap_quality(), "scrap_rate_pct", {"median_rate": 0.5}, ["defect_type"]).select("defect_type", rounded("median_rate"))


@query("agg_confusion", with_views("SELECT actual_shortage_flag, pred_shortage_flag, count(*) AS n FROM predictions GROUP BY 1, 2", "predictions"))
def agg_confusion(t):
    return agg.confusion(t.predictions(), "actual_shortage_flag", "pred_shortage_flag")


@query("agg_confusion_matrix", with_views("""
  SELECT actual_shortage_flag, count(*) FILTER (pred_shortage_flag = 0) AS pred_0, count(*) FILTER (pred_shortage_flag = 1) AS pred_1
  FROM predictions GROUP BY 1""", "predictions"))
def agg_confusion_matrix(t):
    return agg.confusion_matrix(t.predictions(), "actual_shortage_flag", "pred_shortage_flag")


# Windows.


@query("win_rolling_machine", with_views("SELECT inspection_lot, round(rolling_scrap_4w_machine_id, 8) AS rolling_scrap_4w_machine_id FROM lot_load", "lot_load"))
def win_rolling_machine(t):
    lots = t.scrap_quality().select("inspection_lot", "machine_id", "inspection_date", "scrap_rate_pct")
    out = rolling_means(lots, "scrap_rate_pct", {"rolling_scrap_4w_machine_id": "machine_id"}, ["inspection_date", "inspection_lot"], 4)
    return out.select("inspection_lot", rounded("rolling_scrap_4w_machine_id"))


@query("win_rolling_shift", with_views("SELECT inspection_lot, round(rolling_scrap_4w_shift, 8) AS rolling_scrap_4w_shift FROM lot_load", "lot_load"))
def win_rolling_shift(t):
    lots = t.scrap_quality().select("inspection_lot", "shift", "inspection_date", "scrap_rate_pct")
    out = rolling_means(lots, "scrap_rate_pct", {"rolling_scrap_4w_shift": "shift"}, ["inspection_date", "inspection_lot"], 4)
    return out.select("inspection_lot", rounded("rolling_scrap_4w_shift"))


_LOAD = ("wc_utilization", "wc_overload_prob", "order_overload_prob", "throughput_deviation_pct")


@query("win_lot_load", with_views(f"SELECT inspection_lot, {sql_rounded(_LOAD)} FROM lot_load", "lot_load"))
def win_lot_load(t):
    """Group shares, standard scores and deviations from the machine mean."""
    return scrap.load_features(t.scrap_quality()).select("inspection_lot", *[rounded(c) for c in _LOAD])


@query("win_weekly_lags", with_views("""
  SELECT week_no, material_no, lag(stock_level, 1) OVER w AS stock_level_lag1, lag(stock_level, 2) OVER w AS stock_level_lag2,
    lag(shortage_probability_replen, 1) OVER w AS shortage_prob_lag1,
    round(avg(stock_level) OVER (w ROWS 2 PRECEDING), 8) AS stock_roll3, round(avg(forecast_qty) OVER (w ROWS 2 PRECEDING), 8) AS demand_roll3
  FROM (SELECT f.week_no, f.material_no, forecast_qty, stock_level, r.shortage_probability AS shortage_probability_replen
    FROM demand_forecast f LEFT JOIN material_replenishment r USING (week_no, material_no, scenario))
  WINDOW w AS (PARTITION BY material_no ORDER BY week_no)""", "demand_forecast", "material_replenishment"))
def win_weekly_lags(t):
    df = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    df = weekly_lags(df, "material_no", "week_no", {
        "stock_level_lag1": ("stock_level", 1), "stock_level_lag2": ("stock_level", 2), "shortage_prob_lag1": ("shortage_probability_replen", 1)})
    df = weekly_rolling(df, "material_no", "week_no", 3, {"stock_roll3": "stock_level", "demand_roll3": "forecast_qty"})
    return df.select("week_no", "material_no", "stock_level_lag1", "stock_level_lag2", "shortage_prob_lag1", rounded("stock_roll3"), rounded("demand_roll3"))


SERIES = ("material_no", "scenario")


@query("win_calendar_lags", with_views("""
  SELECT week_no, material_no, scenario, max(stock_level) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS stock_lag1,
    max(stock_level) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS stock_lag2, round(avg(stock_level) OVER (w RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 8) AS stock_roll3
  FROM (SELECT week_no, material_no, 'PLAN' AS scenario, stock_level::DOUBLE AS stock_level FROM material_replenishment WHERE week_no % 5 <> 0
    UNION ALL SELECT week_no, material_no, 'WHAT_IF', stock_level + 10e0 FROM material_replenishment WHERE week_no % 3 <> 0)
  WINDOW w AS (PARTITION BY material_no, scenario ORDER BY week_no)""", "material_replenishment"))
def win_calendar_lags(t):
    """Lags and means by calendar distance over series with missing weeks and two scenarios in a week."""
    stock = t.material_replenishment().select("week_no", "material_no", F.col("stock_level").cast("double").alias("stock_level"))
    plan = stock.where("week_no % 5 <> 0").withColumn("scenario", F.lit("PLAN"))
    what_if = stock.where("week_no % 3 <> 0").withColumns({"scenario": F.lit("WHAT_IF"), "stock_level": F.col("stock_level") + 10})
    df = calendar_lags(plan.unionByName(what_if), SERIES, "week_no", {"stock_lag1": ("stock_level", 1), "stock_lag2": ("stock_level", 2)})
    df = calendar_rolling(df, SERIES, "week_no", 3, {"stock_roll3": "stock_level"})
    return df.select("week_no", *SERIES, "stock_lag1", "stock_lag2", rounded("stock_roll3"))


@query("win_latest_per_key", with_views("""
  SELECT week_no, material_no, row_id, pred_order_qty FROM (
    SELECT *, row_number() OVER (PARTITION BY week_no, material_no ORDER BY predicted_at DESC, row_id DESC) AS rn FROM predictions) WHERE rn = 1""", "predictions"))
def win_latest_per_key(t):
    return latest_per_key(t.predictions(), ("week_no", "material_no"), ("predicted_at", "row_id")).select("week_no", "material_no", "row_id", "pred_order_qty")


# Order and limits.


@query("top_sorted_lots", with_views("SELECT inspection_lot, inspection_date, scrap_rate_pct FROM scrap_quality ORDER BY inspection_date, inspection_lot", "scrap_quality"))
def top_sorted_lots(t):
    return t.scrap_quality().select("inspection_lot", "inspection_date", "scrap_rate_pct").orderBy("inspection_date", "inspection_lot")


@query("top_high_risk_ten", with_views("""
  SELECT row_id, week_no, material_no, round(pred_shortage_confidence, 8) AS pred_shortage_confidence, pred_order_qty FROM predictions
  WHERE pred_shortage_confidence > 7e-1 ORDER BY predictions.pred_shortage_confidence DESC, row_id LIMIT 10""", "predictions"))
def top_high_risk_ten(t):
    return high_risk(t.predictions(), 10, ["row_id"]).select("row_id", "week_no", "material_no", rounded("pred_shortage_confidence"), "pred_order_qty")


@query("top_five_materials", with_views("""
  SELECT material_no, n FROM (SELECT material_no, count(*) AS n FROM predictions WHERE pred_shortage_confidence > 7e-1 GROUP BY 1)
  ORDER BY n DESC, material_no LIMIT 5""", "predictions"))
def top_five_materials(t):
    counts = t.predictions().where("pred_shortage_confidence > 0.7").groupBy("material_no").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "material_no").limit(5)


@query("top_five_risk_rows", with_views("""
  SELECT row_id, material_no, week_no FROM predictions WHERE pred_shortage_confidence > 7e-1 ORDER BY pred_shortage_confidence DESC, row_id LIMIT 5""", "predictions"))
def top_five_risk_rows(t):
    return high_risk(t.predictions(), 5, ["row_id"]).select("row_id", "material_no", "week_no")


@query("top_first_rows", with_views("SELECT row_id, week_no, material_no FROM predictions WHERE actual_shortage_flag = 1 ORDER BY week_no, material_no, row_id LIMIT 10", "predictions"))
def top_first_rows(t):
    return t.predictions().where("actual_shortage_flag = 1").orderBy("week_no", "material_no", "row_id").limit(10).select("row_id", "week_no", "material_no")


@query("top_seeded_sample", with_views("""
  SELECT forecast_id, forecast_qty FROM demand_forecast ORDER BY ('0x' || substr(md5(forecast_id || '|42'), 1, 8))::BIGINT, forecast_id LIMIT 5""", "demand_forecast"))
def top_seeded_sample(t):
    return split.seeded_sample(t.demand_forecast(), "forecast_id", 5).select("forecast_id", "forecast_qty")


@query("top_row_at_position", with_views("SELECT inspection_lot, scrap_rate_pct FROM scrap_quality ORDER BY inspection_date, inspection_lot LIMIT 1 OFFSET 5", "scrap_quality"))
def top_row_at_position(t):
    ordered = t.scrap_quality().orderBy("inspection_date", "inspection_lot")
    return ordered.offset(5).limit(1).select("inspection_lot", "scrap_rate_pct")


# Features.

_INT_FEATURES = ("below_safety_stock", "below_reorder", "supplier_risk_flag", "capacity_constraint_flag", "high_downtime_flag")
_REAL_FEATURES = ("available_supply", "demand_gap", "qty_deviation", "qty_deviation_pct", "stock_coverage_weeks", "quality_risk_score", "delay_signal",
                  "customer_demand_gap", "customer_confirmation_rate", "vip_order_ratio", "at_risk_order_ratio")


@query("feat_demand", with_views(f"SELECT week_no, material_no, scenario, {', '.join(_INT_FEATURES)}, {sql_rounded(_REAL_FEATURES)} FROM features", "features"))
def feat_demand(t):
    df = demand.feature_table(demand.star_from(t))
    return df.select(*KEYS, *_INT_FEATURES, *[rounded(c) for c in _REAL_FEATURES])


_PLANNING_REAL = ("stock_buffer_ratio", "stock_vs_safety", "otif_gap", "lead_time_risk", "scrap_adj_demand", "demand_vs_batch")


@query("feat_planning", with_views(f"""
  SELECT week_no, material_no, scenario, {flag('week_no IN (48, 49, 50, 51, 52)')} AS is_peak_season, CAST(floor(week_no / 13) + 1 AS INTEGER) AS quarter,
    {sql_rounded(_PLANNING_REAL)} FROM (
    SELECT *, (stock_level - reorder_point) / (reorder_point + 1) AS stock_buffer_ratio, stock_level - safety_stock AS stock_vs_safety,
      100 - supplier_otif_pct AS otif_gap, supplier_lead_time_days * (1 - supplier_otif_pct / 100) AS lead_time_risk,
      coalesce(total_requested_qty, 0) * (1 + coalesce(avg_scrap_rate, 0) / 100) AS scrap_adj_demand,
      coalesce(total_requested_qty, 0) / CASE WHEN standard_batch_qty = 0 THEN 1 ELSE standard_batch_qty END AS demand_vs_batch FROM star)""", "star"))
def feat_planning(t):
    joined = demand.star_join(
        t.demand_forecast(), t.material_replenishment(), scrap=t.scrap_quality(), customers=t.customer_orders(), materials=t.material_master())
    return joined.withColumns(planning_expressions()).select(*KEYS, "is_peak_season", "quarter", *[rounded(c) for c in _PLANNING_REAL])


@query("feat_custom", with_views(f"""
  SELECT week_no, material_no, scenario, demand_gap, {flag('week_no IN (48, 49, 50, 51, 52)')} AS peak, round(forecast_qty * seasonal_index, 8) AS seasonal_qty FROM features""", "features"))
def feat_custom(t):
    """A caller's own features next to the built-in ones."""
    extra = {"peak": F.col("week_no").isin(*PEAK_WEEKS).cast("int"), "seasonal_qty": F.round(F.col("forecast_qty") * F.col("seasonal_index"), 8)}
    return demand.feature_table(demand.star_from(t), extra).select(*KEYS, "demand_gap", "peak", "seasonal_qty")


_MACHINE_STATE = ("calibration_lag_days", "maintenance_lag_days", "calibration_overdue", "maintenance_overdue")


@query("feat_machine_state", with_views(
    "SELECT inspection_lot, CAST(calibration_lag_days AS INTEGER) AS calibration_lag_days, CAST(maintenance_lag_days AS INTEGER) AS maintenance_lag_days, "
    "calibration_overdue, maintenance_overdue, round(scrap_cost_eur, 8) AS scrap_cost_eur FROM lot_features", "lot_features"))
def feat_machine_state(t):
    lots = scrap.with_masters(t.scrap_quality(), t.machine_master(), t.material_master(), t.supplier_master())
    return scrap.machine_state(lots).select("inspection_lot", *_MACHINE_STATE, rounded("scrap_cost_eur"))


@query("feat_lot_ratios", with_views("""
  SELECT inspection_lot, round(rework_qty / (scrap_qty + rework_qty + 1e-6), 8) AS rework_share, round(scrap_cost_eur / (inspected_qty + 1e-6), 8) AS scrap_cost_per_unit
  FROM scrap_quality""", "scrap_quality"))
def feat_lot_ratios(t):
    return t.scrap_quality().withColumns(lot_ratio_expressions()).select("inspection_lot", rounded("rework_share"), rounded("scrap_cost_per_unit"))


@query("feat_scrap", with_views(f"SELECT inspection_lot, target, {sql_rounded(SCRAP_FEATURES)} FROM lot_features", "lot_features"))
def feat_scrap(t):
    """All 22 features of the scrap models and the target."""
    coded = scrap.encode_lots(scrap.enriched_from(t), scrap.encoders_from(t), unknown=-1)
    return coded.select("inspection_lot", "target", *[rounded(c) for c in SCRAP_FEATURES])


# Encoders.


@query("enc_material_codes", with_views("""
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT material_no AS value FROM demand_forecast)""", "demand_forecast"))
def enc_material_codes(t):
    return fit_encoder(t.demand_forecast(), "material_no")


@query("enc_demand", with_views("""
  SELECT forecast_id, CAST(dense_rank() OVER (ORDER BY material_no) - 1 AS INTEGER) AS material_encoded,
    CAST(dense_rank() OVER (ORDER BY scenario) - 1 AS INTEGER) AS scenario_encoded FROM demand_forecast""", "demand_forecast"))
def enc_demand(t):
    forecast = t.demand_forecast()
    return demand.encode_demand(forecast, demand.demand_encoders(forecast)).select("forecast_id", "material_encoded", "scenario_encoded")


@query("enc_unknown_first", with_views("""
  SELECT f.forecast_id, coalesce(e.code, 0) AS material_encoded FROM demand_forecast f LEFT JOIN (
    SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT material_no AS value FROM scrap_quality)) e
  ON f.material_no = e.value""", "demand_forecast", "scrap_quality"))
def enc_unknown_first(t):
    """Codes learned on one table and applied to another: unseen materials take code 0."""
    encoder = fit_encoder(t.scrap_quality(), "material_no")
    return apply_encoder(t.demand_forecast(), encoder, "material_no", "material_encoded").select("forecast_id", "material_encoded")


@query("enc_fixed_codes", with_views("SELECT inspection_lot, shift_encoded, defect_type_encoded FROM lot_features", "lot_features"))
def enc_fixed_codes(t):
    return t.scrap_quality().select(
        "inspection_lot", fixed_code(F.col("shift"), SHIFT_CODES).alias("shift_encoded"), fixed_code(F.col("defect_type"), DEFECT_CODES).alias("defect_type_encoded"))


@query("enc_category_codes", with_views("SELECT inspection_lot, machine_type_encoded, material_group_encoded FROM lot_features", "lot_features"))
def enc_category_codes(t):
    """Sorted category codes, -1 where the category is missing."""
    lots = scrap.with_masters(t.scrap_quality(), t.machine_master(), t.material_master(), t.supplier_master())
    for name, encoder in scrap.encoders_from(t).items():
        lots = apply_encoder(lots, encoder, name, f"{name}_encoded", unknown=-1)
    return lots.select("inspection_lot", "machine_type_encoded", "material_group_encoded")


# Splits.

_HASHED = "SELECT {cols}, ('0x' || substr(md5({key} || '|42'), 1, 8))::BIGINT AS h FROM {table}"


@query("split_random", with_views(f"""
  SELECT forecast_id, row_number() OVER (ORDER BY h, forecast_id) <= count(*) OVER () - ceil(2e-1 * count(*) OVER ()) AS is_train
  FROM ({_HASHED.format(cols='forecast_id', key='forecast_id', table='demand_forecast')})""", "demand_forecast"))
def split_random(t):
    return split.random_split(t.demand_forecast().select("forecast_id"), "forecast_id")


@query("split_stratified", with_views(f"""
  SELECT replenishment_id, shortage_flag, row_number() OVER (PARTITION BY shortage_flag ORDER BY h, replenishment_id)
    <= count(*) OVER (PARTITION BY shortage_flag) - ceil(2e-1 * count(*) OVER (PARTITION BY shortage_flag)) AS is_train
  FROM ({_HASHED.format(cols='replenishment_id, shortage_flag', key='replenishment_id', table='material_replenishment')})""", "material_replenishment"))
def split_stratified(t):
    rows = t.material_replenishment().select("replenishment_id", "shortage_flag")
    return split.stratified_split(rows, "replenishment_id", "shortage_flag")


@query("split_time", with_views("""
  SELECT inspection_lot, inspection_date, row_number() OVER (ORDER BY inspection_date, inspection_lot) <= floor(8e-1 * count(*) OVER ()) AS is_train
  FROM scrap_quality""", "scrap_quality"))
def split_time(t):
    return split.time_split(t.scrap_quality().select("inspection_lot", "inspection_date"), "inspection_date", "inspection_lot")


@query("split_folds", with_views(f"""
  SELECT forecast_id, CAST(h % 5 AS INTEGER) AS fold FROM ({_HASHED.format(cols='forecast_id', key='forecast_id', table='demand_forecast')})""", "demand_forecast"))
def split_folds(t):
    return split.hash_folds(t.demand_forecast().select("forecast_id"), "forecast_id")


@query("split_stratified_folds", with_views(f"""
  SELECT replenishment_id, shortage_flag, CAST((row_number() OVER (PARTITION BY shortage_flag ORDER BY h, replenishment_id) - 1) % 5 AS INTEGER) AS fold
  FROM ({_HASHED.format(cols='replenishment_id, shortage_flag', key='replenishment_id', table='material_replenishment')})""", "material_replenishment"))
def split_stratified_folds(t):
    return split.stratified_folds(t.material_replenishment().select("replenishment_id", "shortage_flag"), "replenishment_id", "shortage_flag")


@query("split_is_complete", with_views("SELECT 0::BIGINT AS in_both, 0::BIGINT AS missing, count(*) AS n FROM scrap_quality", "scrap_quality"))
def split_is_complete(t):
    """Both parts of a split are disjoint and together give the table."""
    rows = t.scrap_quality().select("inspection_lot", "inspection_date")
    parts = split.time_split(rows, "inspection_date", "inspection_lot")
    train, test = parts.where("is_train").drop("is_train"), parts.where("NOT is_train").drop("is_train")
    both = train.intersect(test).agg(F.count(F.lit(1))).scalar()
    missing = rows.exceptAll(train.unionAll(test)).agg(F.count(F.lit(1))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n")).select(both.alias("in_both"), missing.alias("missing"), "n")


# Metrics.


@query("metric_regression", with_views("""
  SELECT round(avg(abs(a - p)), 8) AS mae, round(sqrt(avg(pow(a - p, 2))), 8) AS rmse, round(1 - sum(pow(a - p, 2)) / sum(pow(a - m, 2)), 8) AS r2
  FROM (SELECT actual_shortage_prob AS a, pred_shortage_prob AS p, avg(actual_shortage_prob) OVER () AS m FROM predictions)""", "predictions"))
def metric_regression(t):
    out = metrics.regression_metrics(t.predictions(), "actual_shortage_prob", "pred_shortage_prob")
    return out.select(rounded("mae"), rounded("rmse"), rounded("r2"))


@query("metric_mape", with_views("""
  SELECT round(avg(abs(a - p) / greatest(abs(a), 1e0)), 8) AS guarded_mape, round(log10(avg(abs(a - p) / greatest(abs(a), 2.220446049250313e-16))), 8) AS log_mape
  FROM (SELECT actual_order_qty AS a, pred_order_qty AS p FROM predictions)""", "predictions"))
def metric_mape(t):
    """Zero actuals blow the percentage error up, as published; its logarithm is compared."""
    p = t.predictions()
    size = F.abs(F.col("actual_order_qty"))
    guarded = F.abs(F.col("actual_order_qty") - F.col("pred_order_qty")) / F.greatest(size, F.lit(1))
    return p.agg(F.round(F.avg(guarded), 8).alias("guarded_mape"), F.round(F.log10(metrics.mape("actual_order_qty", "pred_order_qty")), 8).alias("log_mape"))


@query("metric_r2_constant", with_views("SELECT 0e0 AS constant_r2, 1e0 AS exact_r2 FROM predictions LIMIT 1", "predictions"))
def metric_r2_constant(t):
    """A constant target scores 0, or 1 when predicted exactly."""
    p = t.predictions().select(F.lit(200.0).alias("a"), F.col("pred_order_qty").cast("double").alias("p"), F.lit(200.0).alias("same"))
    return p.agg(metrics.r2("a", "p").alias("constant_r2"), metrics.r2("a", "same").alias("exact_r2"))


@query("metric_roc_auc", with_views("""
  SELECT round(sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)), 8) AS roc_auc FROM (
    SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM (
      SELECT pred_shortage_confidence AS s, count(*) FILTER (actual_shortage_flag = 1) AS pos, count(*) FILTER (actual_shortage_flag = 0) AS neg
      FROM predictions GROUP BY 1))""", "predictions"))
def metric_roc_auc(t):
    return metrics.roc_auc(t.predictions(), "actual_shortage_flag", "pred_shortage_confidence").select(rounded("roc_auc"))


@query("metric_binary", with_views("""
  SELECT round(acc, 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1_score
  FROM (SELECT avg(CASE WHEN actual_shortage_flag = pred_shortage_flag THEN 1e0 ELSE 0e0 END) AS acc,
      count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 1) AS tp, count(*) FILTER (actual_shortage_flag = 0 AND pred_shortage_flag = 1) AS fp,
      count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 0) AS fn FROM predictions)""", "predictions"))
def metric_binary(t):
    out = metrics.binary_metrics(t.predictions(), "actual_shortage_flag", "pred_shortage_flag")
    return out.select(*[rounded(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("metric_class_report", with_views("""
  , per AS (SELECT c::VARCHAR AS class, tp / chosen AS precision, tp / support AS recall, 2 * tp / (chosen + support) AS f1_score, support, tp FROM (
    SELECT c, count(*) FILTER (actual_shortage_flag = c AND pred_shortage_flag = c) AS tp, count(*) FILTER (pred_shortage_flag = c) AS chosen,
      count(*) FILTER (actual_shortage_flag = c) AS support FROM predictions, (VALUES (0), (1)) v(c) GROUP BY c))
  SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1_score, 8) AS f1_score, support::BIGINT AS support FROM (
    SELECT class, precision, recall, f1_score, support FROM per
    UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM per
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM per)""",
    "predictions").replace("\n\n  , per AS", ", per AS").replace("\n\n", "\n"))
def metric_class_report(t):
    out = metrics.class_report(t.predictions(), "actual_shortage_flag", "pred_shortage_flag")
    return out.select("class", rounded("precision"), rounded("recall"), rounded("f1_score"), F.col("support").cast("bigint").alias("support"))


@query("metric_hash_balance", with_views(f"""
  SELECT CAST(h % 10 AS INTEGER) AS bucket, count(*) AS n FROM ({_HASHED.format(cols='forecast_id', key='forecast_id', table='demand_forecast')}) GROUP BY 1""", "demand_forecast"))
def metric_hash_balance(t):
    """How evenly the split hash spreads the keys."""
    return t.demand_forecast().groupBy((key_hash("forecast_id", seed=42) % 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
