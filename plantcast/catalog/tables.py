"""Queries: sources, sinks, cleaning and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantcast.catalog.registry import query, rounded, sql_rounded
from plantcast.catalog.views import with_views
from plantcast.functions.columns import clip, exact_round, normalise_names, number_text, percent_text, zero_to_one
from plantcast.functions.rules import alert_level
from plantcast.operators import cleaning, joins
from plantcast.operators.encode import fit_encoder, named_encoders
from plantcast.operators.keyed import latest_per_key, merge_latest
from plantcast.operators.metrics import binary_metrics, regression_metrics, stack_metrics
from plantcast.plans import demand, scrap
from plantcast.session import work_path
from plantcast.sources import records, tables
from plantcast.sources.schemas import FORECAST_FEATURES, KEYS, TABLES

LOT_COLUMNS = ("inspection_lot", "machine_id", "shift", "inspection_date", "inspected_qty", "scrap_rate_pct")


@query("src_csv_dates", with_views(f"SELECT {', '.join(LOT_COLUMNS)}, dayofweek(inspection_date)::INTEGER AS weekday FROM scrap_quality", "scrap_quality"))
def src_csv_dates(t):
    """Headed CSV written once and read with the fixed schema, dates included."""
    path = work_path(t.spark, "lots-csv")
    lots = t.scrap_quality()
    names = [n for n in TABLES["scrap_quality"].fieldNames()]
    full = lots.select(*[F.col(n) if n in lots.columns else F.lit(None).cast("string").alias(n) for n in names])
    full.write.option("header", True).csv(path)
    read = tables.read_csv(t.spark, path, "scrap_quality")
    return read.select(*LOT_COLUMNS, (F.dayofweek("inspection_date") - 1).alias("weekday"))


AUDITED = ("demand_forecast", "material_replenishment", "customer_orders", "scrap_quality", "material_master",
           "supplier_master", "machine_master", "production_orders", "work_centre_utilization")
AUDIT_COLUMNS = {"demand_forecast": 12, "material_replenishment": 10, "customer_orders": 12, "scrap_quality": 18,
                 "material_master": 8, "supplier_master": 7, "machine_master": 7, "production_orders": 8,
                 "work_centre_utilization": 7}


@query("src_audit", with_views(
    " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n_rows, {AUDIT_COLUMNS[n]} AS n_columns FROM {n}" for n in AUDITED)
    + " UNION ALL SELECT 'joined', count(*), 44 FROM star", *AUDITED, "star"))
def src_audit(t):
    """Rows and columns of every source and of the joined table."""
    return tables.audit({**{name: getattr(t, name)() for name in AUDITED}, "joined": demand.star_from(t)})


_METRIC_SQL = with_views("""
  SELECT model, metric, round(value, 4) AS value FROM (
    SELECT 'classifier' AS model, unnest(['accuracy', 'precision', 'recall', 'f1_score']) AS metric,
      unnest([acc, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)]) AS value
    FROM (SELECT avg(CASE WHEN actual_shortage_flag = pred_shortage_flag THEN 1e0 ELSE 0e0 END) AS acc,
      count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 1) AS tp,
      count(*) FILTER (actual_shortage_flag = 0 AND pred_shortage_flag = 1) AS fp,
      count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 0) AS fn FROM predictions)
    UNION ALL
    SELECT 'order_qty', unnest(['mae', 'rmse']), unnest([avg(abs(actual_order_qty - pred_order_qty)), sqrt(avg(pow(actual_order_qty - pred_order_qty, 2)))]) FROM predictions)""",
    "predictions")


@query("src_metrics_document", _METRIC_SQL)
def src_metrics_document(t):
    """Metrics written as one nested document and flattened on reading."""
    p = t.predictions()
    regression = regression_metrics(p, "actual_order_qty", "pred_order_qty").select("mae", "rmse")
    rows = stack_metrics({"classifier": binary_metrics(p, "actual_shortage_flag", "pred_shortage_flag"), "order_qty": regression})
    # One entry per model: the document has as many values as there are metrics.
    inner = rows.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    path = work_path(t.spark, "metrics-json")
    inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "m")))).alias("value")).write.text(path)
    return tables.read_nested_metrics(t.spark, path)


_ORDER_METRICS = """SELECT unnest(['mae', 'rmse', 'r2', 'log_mape']) AS metric, unnest([avg(abs(a - p)), sqrt(avg(pow(a - p, 2))),
      1 - sum(pow(a - p, 2)) / sum(pow(a - m, 2)), log10(avg(abs(a - p) / greatest(abs(a), 2.220446049250313e-16)))]) AS value
    FROM (SELECT actual_order_qty AS a, pred_order_qty AS p, avg(actual_order_qty) OVER () AS m FROM predictions)"""


@query("src_metric_log", with_views(f"""
  SELECT run_ts, 'order_qty' AS model, metric, round(value, 6) AS value, NULL::INTEGER AS position, NULL::VARCHAR AS feature FROM ({_ORDER_METRICS}), (VALUES ('run_1'), ('run_2')) r(run_ts)
  UNION ALL SELECT 'features', 'order_qty', NULL, NULL, i - 1, list_extract([{', '.join(repr(f) for f in FORECAST_FEATURES)}], i)
    FROM (SELECT unnest(range(1, {len(FORECAST_FEATURES) + 1}))::INTEGER AS i) WHERE EXISTS (SELECT 1 FROM predictions)""", "predictions"))
def src_metric_log(t):
    """Metrics of two runs appended to one log as a nested document gives them, and the feature list of the model, read back."""
    log, document, lists = (work_path(t.spark, n) for n in ("metric-log", "metric-document", "feature-lists"))
    found = regression_metrics(t.predictions(), "actual_order_qty", "pred_order_qty").withColumn("log_mape", F.log10("mape")).drop("mape")
    rows = stack_metrics({"order_qty": found}, 6)
    inner = rows.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "m")))).alias("value")).write.text(document)
    for run in ("run_1", "run_2"):
        tables.append_metrics(tables.read_nested_metrics(t.spark, document).withColumn("run_ts", F.lit(run)), log)
    tables.write_feature_lists(t.spark, {"order_qty": FORECAST_FEATURES}, lists)
    features = tables.read_feature_lists(t.spark, lists).withColumn("run_ts", F.lit("features"))
    both = t.spark.read.parquet(log).unionByName(features, allowMissingColumns=True)
    return both.select("run_ts", "model", "metric", "value", F.col("position").cast("int").alias("position"), "feature")


def lot_records(t):
    """Scoring records from enriched lots, as a client would send them."""
    return scrap.enriched_from(t).withColumn("inspection_date", F.col("inspection_date").cast("string"))




@query("src_rejected_lots", with_views("""
  SELECT * FROM (SELECT inspection_lot, concat_ws(';', CASE WHEN scrap_cost_eur IS NULL THEN 'scrap_cost_eur missing' END,
      CASE WHEN supplier_name IS NULL THEN 'supplier_name missing' END, CASE WHEN material_group IS NULL THEN 'material_group missing' END,
      CASE WHEN defect_rate_pct > 100 THEN 'defect_rate_pct out of range' END, CASE WHEN scrap_rate_pct > 100 THEN 'scrap_rate_pct out of range' END,
      CASE WHEN rework_rate_pct > 100 THEN 'rework_rate_pct out of range' END) AS violations FROM lot_features)
  WHERE violations <> ''""", "lot_features"))
def src_rejected_lots(t):
    """Records that break a rule, with every rule they break."""
    bad = records.rejected(records.check_inspection(lot_records(t)))
    return bad.select("inspection_lot", F.array_join("violations", ";").alias("violations"))


def demand_records(t):
    """Scoring records from forecasts and stocks."""
    joined = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    return joined.select(*KEYS, "forecast_qty", "stock_level", "replenishment_order_qty", "historical_avg_qty", "supplier_otif_pct")


@query("src_demand_defaults", with_views("""
  SELECT week_no, material_no, scenario, forecast_qty, CAST(stock_level AS DOUBLE) AS stock_level, historical_avg_qty, supplier_otif_pct,
    8e-1 AS confidence_score, 7 AS supplier_lead_time_days, 7e1 AS avg_wc_utilization, 1 AS n_orders
  FROM demand_forecast JOIN material_replenishment r USING (week_no, material_no, scenario)""",
    "demand_forecast", "material_replenishment"))
def src_demand_defaults(t):
    """Accepted records with the defaults of the fields they leave out."""
    good = records.complete_demand(records.accepted(records.check_demand(demand_records(t))))
    return good.select(*KEYS, "forecast_qty", "stock_level", "historical_avg_qty", "supplier_otif_pct",
                       "confidence_score", "supplier_lead_time_days", "avg_wc_utilization", "n_orders")


def odd_records(t):
    """Records in which some stocks are NaN, some orders are missing and some batches are zero."""
    nan, week = F.lit(float("nan")), F.col("week_no")
    return demand_records(t).withColumns({
        "stock_level": F.when(week % 7 == 3, nan).otherwise(F.col("stock_level").cast("double")),
        "replenishment_order_qty": F.when(week % 11 != 5, F.col("replenishment_order_qty")),
        "standard_batch_qty": week % 3,
    })


@query("src_demand_rejected", with_views("""
  SELECT week_no, material_no, scenario, concat_ws(';', CASE WHEN week_no % 7 = 3 THEN 'stock_level missing' END,
    CASE WHEN week_no % 11 = 5 THEN 'replenishment_order_qty missing' END) AS violations
  FROM demand_forecast JOIN material_replenishment r USING (week_no, material_no, scenario) WHERE week_no % 7 = 3 OR week_no % 11 = 5""",
    "demand_forecast", "material_replenishment"))
def src_demand_rejected(t):
    """A NaN is as missing as a null."""
    bad = records.rejected(records.check_demand(odd_records(t)))
    return bad.select(*KEYS, F.array_join("violations", ";").alias("violations"))


@query("src_demand_zero_batch", with_views("""
  SELECT week_no, material_no, scenario, CAST(stock_level AS DOUBLE) AS stock_level, CAST(greatest(week_no % 3, 1) AS DOUBLE) AS standard_batch_qty
  FROM demand_forecast JOIN material_replenishment r USING (week_no, material_no, scenario) WHERE week_no % 7 <> 3 AND week_no % 11 <> 5""",
    "demand_forecast", "material_replenishment"))
def src_demand_zero_batch(t):
    """Accepted records; a batch quantity of zero counts as one."""
    good = records.complete_demand(records.accepted(records.check_demand(odd_records(t))))
    return good.select(*KEYS, "stock_level", "standard_batch_qty")


_ALERT_SQL = "CASE WHEN scrap_risk_probability >= 6e-1 THEN 'ESCALATE' WHEN scrap_risk_probability >= 4e-1 THEN 'WARN' ELSE 'OK' END"
_ACTION_SQL = "CASE alert_level WHEN 'OK' THEN 'Log result only' WHEN 'WARN' THEN 'Notify quality team' ELSE 'Block order + escalate' END"


@query("src_route_alerts", with_views(
    f"SELECT *, {_ACTION_SQL} AS action FROM (SELECT inspection_lot, scrap_risk_probability, {_ALERT_SQL} AS alert_level FROM scrap_quality)", "scrap_quality"))
def src_route_alerts(t):
    """Scored lots in one folder per alert level, read back."""
    path = work_path(t.spark, "routes")
    scored = t.scrap_quality().select("inspection_lot", "scrap_risk_probability", alert_level(F.col("scrap_risk_probability")).alias("alert_level"))
    tables.route_by_alert(scored, path)
    return t.spark.read.parquet(path).select("inspection_lot", "scrap_risk_probability", "alert_level", "action")


@query("src_append_log", with_views(f"""
  SELECT inspection_lot, {_ALERT_SQL} AS alert_level, n AS entry FROM scrap_quality, (VALUES (1), (2)) v(n)""", "scrap_quality"))
def src_append_log(t):
    """Two runs appended to one log table."""
    path = work_path(t.spark, "log")
    scored = t.scrap_quality().select("inspection_lot", alert_level(F.col("scrap_risk_probability")).alias("alert_level"))
    for entry in (1, 2):
        tables.append_log(scored.withColumn("entry", F.lit(entry)), path)
    return t.spark.read.parquet(path)


LATEST_COLUMNS = ("week_no", "material_no", "row_id", "pred_shortage_flag", "pred_shortage_confidence", "pred_order_qty")
_LATEST_SQL = with_views(f"""
  SELECT {', '.join(LATEST_COLUMNS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY week_no, material_no ORDER BY predicted_at DESC, row_id DESC) AS rn FROM predictions)
  WHERE rn = 1""", "predictions")
KEYED = ("week_no", "material_no")
NEWEST = ("predicted_at", "row_id")


@query("src_upsert_predictions", _LATEST_SQL)
def src_upsert_predictions(t):
    """Keyed prediction table: first load, then a second batch merged into the weeks it touches."""
    path = work_path(t.spark, "predictions")
    p = t.predictions()
    first, second = p.where("actual_shortage_flag = 0"), p.where("actual_shortage_flag = 1")
    tables.upsert_predictions(latest_per_key(first, KEYED, NEWEST), path)
    stored = t.spark.read.parquet(path).select(*p.columns)
    tables.upsert_predictions(merge_latest(stored, second, KEYED, NEWEST), path)
    return t.spark.read.parquet(path).select(*LATEST_COLUMNS)


@query("src_predictions_csv", with_views("SELECT week_no, material_no, pred_shortage_flag, pred_order_qty, round(pred_shortage_prob, 8) AS pred_shortage_prob, '20260408' AS run FROM predictions", "predictions"))
def src_predictions_csv(t):
    """Predictions written as headed CSV, the run as a partition."""
    path = work_path(t.spark, "predictions-csv")
    p = t.predictions().select("week_no", "material_no", "pred_shortage_flag", "pred_order_qty", "pred_shortage_prob")
    tables.write_predictions_csv(p, path, "run_20260408")
    read = t.spark.read.schema("week_no int, material_no string, pred_shortage_flag int, pred_order_qty int, pred_shortage_prob double, run_ts string").option("header", True).csv(path)
    return read.select("week_no", "material_no", "pred_shortage_flag", "pred_order_qty", rounded("pred_shortage_prob"), F.substring("run_ts", 5, 8).alias("run"))


@query("enc_saved_encoders", with_views("""
  SELECT 'scenario' AS encoder, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT scenario AS value FROM demand_forecast)
  UNION ALL SELECT 'material_group', value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) FROM (SELECT DISTINCT material_group AS value FROM material_master)""",
    "demand_forecast", "material_master"))
def enc_saved_encoders(t):
    """Encoder frames written and read back."""
    path = work_path(t.spark, "encoders")
    named = named_encoders({"scenario": fit_encoder(t.demand_forecast(), "scenario"), "material_group": fit_encoder(t.material_master(), "material_group")})
    named.write.parquet(path)
    return t.spark.read.parquet(path)


# Cleaning.


@query("clean_complete_cases", with_views(
    "SELECT week_no, material_no, scenario, demand_gap FROM features WHERE " + " AND ".join(
        f"{c} IS NOT NULL" for c in FORECAST_FEATURES if c not in ("material_encoded", "scenario_encoded")), "features"))
def clean_complete_cases(t):
    df = demand.feature_table(demand.star_from(t))
    present = [c for c in FORECAST_FEATURES if c in df.columns]
    return cleaning.complete_cases(df, present).select(*KEYS, "demand_gap")


_FILL_ZERO = ("total_requested_qty", "n_customer_orders", "avg_scrap_rate", "total_scrap_cost")


@query("clean_fill_zero", with_views(
    "SELECT week_no, material_no, scenario, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 8) AS {c}" for c in _FILL_ZERO) + " FROM star", "star"))
def clean_fill_zero(t):
    return cleaning.fill_zero(demand.star_from(t), _FILL_ZERO).select(*KEYS, *[rounded(c) for c in _FILL_ZERO])


@query("clean_fill_mean", with_views(
    f"SELECT inspection_lot, {sql_rounded(['supplier_otif_pct', 'supplier_scrap_pct', 'supplier_risk_score'])} FROM lot_features", "lot_features"))
def clean_fill_mean(t):
    joined = scrap.with_masters(t.scrap_quality(), t.machine_master(), t.material_master(), t.supplier_master())
    names = list(scrap.SUPPLIER_NAMES.values())
    return cleaning.fill_mean(joined, names).select("inspection_lot", *[rounded(n) for n in names])


@query("clean_fill_constant", with_views("""
  SELECT week_no, material_no, scenario, coalesce(CAST(stock_level AS DOUBLE), 0) AS stock_level, coalesce(supplier_otif_pct, 95) AS supplier_otif_pct
  FROM demand_forecast LEFT JOIN material_replenishment USING (week_no, material_no, scenario)""", "demand_forecast", "material_replenishment"))
def clean_fill_constant(t):
    joined = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    typed = joined.withColumn("stock_level", F.col("stock_level").cast("double"))
    return cleaning.fill_constants(typed, {"stock_level": 0.0, "supplier_otif_pct": 95.0}).select(*KEYS, "stock_level", "supplier_otif_pct")


@query("clean_fill_median", with_views("""
  SELECT week_no, material_no, scenario, coalesce(CAST(stock_level AS DOUBLE), median(stock_level) OVER ()) AS stock_level,
    coalesce(supplier_otif_pct, median(supplier_otif_pct) OVER ()) AS supplier_otif_pct
  FROM demand_forecast LEFT JOIN material_replenishment USING (week_no, material_no, scenario)""", "demand_forecast", "material_replenishment"))
def clean_fill_median(t):
    joined = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    return cleaning.fill_median(joined, ["stock_level", "supplier_otif_pct"]).select(*KEYS, "stock_level", "supplier_otif_pct")


@query("clean_guard_divisor", with_views("""
  SELECT inspection_lot, CASE WHEN rework_qty = 0 THEN 1e0 ELSE rework_qty END AS divisor,
    round(scrap_qty / CASE WHEN rework_qty = 0 THEN 1 ELSE rework_qty END, 8) AS ratio FROM scrap_quality""", "scrap_quality"))
def clean_guard_divisor(t):
    divisor = zero_to_one(F.col("rework_qty"))
    return t.scrap_quality().select("inspection_lot", divisor.alias("divisor"), F.round(F.col("scrap_qty") / divisor, 8).alias("ratio"))


@query("clean_casts", with_views("""
  SELECT inspection_lot, CAST(inspected_qty AS DOUBLE) AS qty, CAST(trunc(scrap_rate_pct) AS INTEGER) AS whole_pct,
    CAST(trunc(-scrap_rate_pct) AS INTEGER) AS negative_pct FROM scrap_quality""", "scrap_quality"))
def clean_casts(t):
    rate = F.col("scrap_rate_pct")
    return t.scrap_quality().select("inspection_lot", F.col("inspected_qty").cast("double").alias("qty"), rate.cast("int").alias("whole_pct"), (-rate).cast("int").alias("negative_pct"))


_PROJECTED = ("forecast_qty", "stock_level", "demand_gap", "customer_confirmation_rate", "avg_scrap_rate")


@query("clean_feature_projection", with_views(
    "SELECT week_no AS week, material_no AS material, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 8) AS {c}" for c in _PROJECTED)
    + ", 0e0 AS not_there FROM features", "features"))
def clean_feature_projection(t):
    df = demand.feature_table(demand.star_from(t))
    keep = [F.col("week_no").alias("week"), F.col("material_no").alias("material")]
    out = cleaning.feature_projection(df, [*_PROJECTED, "not_there"], keep)
    return out.withColumns({c: F.round(F.col(c), 8) for c in _PROJECTED})


@query("clean_names_and_targets", with_views("SELECT inspection_lot AS lot_number, scrap_rate_pct AS scrap_rate FROM scrap_quality", "scrap_quality"))
def clean_names_and_targets(t):
    """Odd column names made plain, target columns dropped when present."""
    odd = t.scrap_quality().select(F.col("inspection_lot").alias(" Lot Number"), F.col("scrap_rate_pct").alias("Scrap Rate "), "scrap_risk_probability")
    return cleaning.drop_targets(normalise_names(odd), ["scrap_risk_probability", "shortage_flag"])


@query("clean_clip", with_views("""
  SELECT row_id, CASE WHEN d < -5 THEN -5e0 WHEN d > 5 THEN 5e0 ELSE d END AS both_sides, CASE WHEN d < 0 THEN 0e0 ELSE d END AS low_side
  FROM (SELECT row_id, CAST(pred_order_qty - actual_order_qty AS DOUBLE) AS d FROM predictions)""", "predictions"))
def clean_clip(t):
    d = (F.col("pred_order_qty") - F.col("actual_order_qty")).cast("double")
    return t.predictions().select("row_id", clip(d, -5.0, 5.0).alias("both_sides"), clip(d, 0.0).alias("low_side"))


@query("clean_number_text", with_views("""
  SELECT row_id, printf('%.1f', stock_level / 8) AS one_digit, printf('%.2f', pred_shortage_prob * 100) || '%' AS percent,
    printf('%.2f', stock_level / 8)::DOUBLE AS rounded FROM predictions""", "predictions"))
def clean_number_text(t):
    eighth = F.col("stock_level") / 8
    return t.predictions().select("row_id", number_text(eighth, 1).alias("one_digit"), percent_text(F.col("pred_shortage_prob"), 2).alias("percent"), exact_round(eighth, 2).alias("rounded"))


# Joins.


@query("join_replenishment", with_views("""
  SELECT week_no, material_no, scenario, f.shortage_probability, r.shortage_probability AS shortage_probability_replen, stock_level,
    replenishment_order_qty, supplier_otif_pct, shortage_flag
  FROM demand_forecast f LEFT JOIN material_replenishment r USING (week_no, material_no, scenario)""", "demand_forecast", "material_replenishment"))
def join_replenishment(t):
    joined = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    return joined.select(*KEYS, "shortage_probability", "shortage_probability_replen", "stock_level", "replenishment_order_qty", "supplier_otif_pct", "shortage_flag")


_STAR_ROUNDED = ("avg_start_delay", "avg_finish_delay", "avg_overload_prob", "avg_throughput_dev", "avg_defect_rate", "avg_scrap_rate",
                 "avg_scrap_risk", "total_scrap_cost", "avg_wc_utilization", "avg_wc_downtime", "avg_wc_delay", "avg_wc_overload")
_STAR_EXACT = ("forecast_qty", "stock_level", "n_orders", "total_requested_qty", "total_confirmed_qty", "n_customer_orders", "vip_order_count",
               "at_risk_order_count", "max_wc_utilization", "unit_cost_eur", "reorder_point", "safety_stock", "standard_batch_qty", "otif_pct",
               "avg_lead_time_days", "risk_score_m5", "scrap_contribution_pct")


@query("join_star", with_views(f"SELECT week_no, material_no, scenario, {', '.join(_STAR_EXACT)}, {sql_rounded(_STAR_ROUNDED)} FROM star", "star"))
def join_star(t):
    """All seven left joins of the demand product."""
    return demand.star_from(t).select(*KEYS, *_STAR_EXACT, *[rounded(c) for c in _STAR_ROUNDED])


@query("join_production", with_views(f"SELECT week_no, material_no, scenario, n_orders, {sql_rounded(_STAR_ROUNDED[:4])} FROM star", "star"))
def join_production(t):
    joined = demand.star_join(t.demand_forecast(), t.material_replenishment(), production=t.production_orders())
    return joined.select(*KEYS, "n_orders", *[rounded(c) for c in _STAR_ROUNDED[:4]])


@query("join_scrap", with_views(f"SELECT week_no, material_no, scenario, {sql_rounded(_STAR_ROUNDED[4:8])} FROM star", "star"))
def join_scrap(t):
    joined = demand.star_join(t.demand_forecast(), t.material_replenishment(), scrap=t.scrap_quality())
    return joined.select(*KEYS, *[rounded(c) for c in _STAR_ROUNDED[4:8]])


@query("join_customers", with_views("SELECT week_no, material_no, scenario, total_requested_qty, total_confirmed_qty, n_customer_orders, vip_order_count, at_risk_order_count FROM star", "star"))
def join_customers(t):
    joined = demand.star_join(t.demand_forecast(), t.material_replenishment(), customers=t.customer_orders())
    return joined.select(*KEYS, "total_requested_qty", "total_confirmed_qty", "n_customer_orders", "vip_order_count", "at_risk_order_count")


@query("join_work_centres", with_views(f"SELECT week_no, material_no, scenario, max_wc_utilization, {sql_rounded(_STAR_ROUNDED[8:])} FROM star", "star"))
def join_work_centres(t):
    joined = demand.star_join(t.demand_forecast(), t.material_replenishment(), work_centres=t.work_centre_utilization())
    return joined.select(*KEYS, "max_wc_utilization", *[rounded(c) for c in _STAR_ROUNDED[8:]])


@query("join_dimensions", with_views("SELECT week_no, material_no, scenario, unit_cost_eur, reorder_point, safety_stock, otif_pct, risk_score_m5 FROM star", "star"))
def join_dimensions(t):
    joined = demand.star_join(t.demand_forecast(), t.material_replenishment(), materials=t.material_master(), suppliers=t.supplier_master())
    return joined.select(*KEYS, "unit_cost_eur", "reorder_point", "safety_stock", "otif_pct", "risk_score_m5")


_LOT_MASTERS = ("machine_name", "machine_type", "material_group", "unit_cost_eur", "primary_supplier_id", "supplier_id", "supplier_name", "rework_contribution_pct")


@query("join_lot_masters", with_views(f"SELECT inspection_lot, {', '.join(_LOT_MASTERS)}, supplier_otif_raw AS supplier_otif_pct, supplier_risk_raw AS supplier_risk_score FROM lots", "lots"))
def join_lot_masters(t):
    """Lots with machine, material and, under another key name, the supplier."""
    joined = scrap.with_masters(t.scrap_quality(), t.machine_master(), t.material_master(), t.supplier_master())
    return joined.select("inspection_lot", *_LOT_MASTERS, "supplier_otif_pct", "supplier_risk_score")


@query("join_nine_tables", with_views("""
  SELECT q.inspection_lot, q.material_no, q.week_no, machine_type, material_group, supplier_name, forecast_qty, stock_level, n_customer_orders, n_orders
  FROM lots q LEFT JOIN star s ON q.week_no = s.week_no AND q.material_no = s.material_no AND q.scenario = s.scenario""", "lots", "star"))
def join_nine_tables(t):
    """Lots with their masters and the planning row of their week and material."""
    lots = scrap.with_masters(t.scrap_quality(), t.machine_master(), t.material_master(), t.supplier_master())
    plan = demand.star_join(
        t.demand_forecast(), t.material_replenishment(), t.production_orders(), t.scrap_quality(), t.customer_orders(), t.work_centre_utilization(),
    ).select(*KEYS, "forecast_qty", "stock_level", "n_customer_orders", "n_orders")
    return lots.join(plan, list(KEYS), "left").select(
        "inspection_lot", "material_no", "week_no", "machine_type", "material_group", "supplier_name", "forecast_qty", "stock_level", "n_customer_orders", "n_orders")


@query("join_predictions_back", with_views(f"""
  SELECT f.week_no, f.material_no, f.forecast_qty, p.pred_shortage_flag, p.pred_order_qty
  FROM demand_forecast f JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week_no, material_no ORDER BY predicted_at DESC, row_id DESC) AS rn
    FROM predictions) WHERE rn = 1) p ON f.week_no = p.week_no AND f.material_no = p.material_no""", "demand_forecast", "predictions"))
def join_predictions_back(t):
    latest = latest_per_key(t.predictions(), KEYED, NEWEST)
    return t.demand_forecast().join(latest, list(KEYED)).select("week_no", "material_no", "forecast_qty", "pred_shortage_flag", "pred_order_qty")


@query("join_unseen_materials", with_views("""
  SELECT DISTINCT material_no FROM material_master m WHERE NOT EXISTS (SELECT 1 FROM scrap_quality q WHERE q.material_no = m.material_no)""", "material_master", "scrap_quality"))
def join_unseen_materials(t):
    """Materials without a code in an encoder fitted on the lots."""
    return joins.unseen_keys(t.material_master(), fit_encoder(t.scrap_quality(), "material_no"), "material_no")


@query("join_known_materials", with_views("""
  SELECT forecast_id, material_no, forecast_qty FROM demand_forecast f WHERE EXISTS (SELECT 1 FROM scrap_quality q WHERE q.material_no = f.material_no)""", "demand_forecast", "scrap_quality"))
def join_known_materials(t):
    known = fit_encoder(t.scrap_quality(), "material_no")
    return joins.known_rows(t.demand_forecast(), known, "material_no").select("forecast_id", "material_no", "forecast_qty")
