"""Queries: business rules, reports and the decision steps of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantcast.catalog.registry import query, rounded
from plantcast.catalog.views import flag, with_views
from plantcast.functions import rules
from plantcast.functions.columns import exact_round
from plantcast.operators.encode import fit_encoder
from plantcast.operators.joins import unseen_keys
from plantcast.operators.metrics import classifier_metrics_frame, stack_metrics
from plantcast.plans import demand, reports, scoring
from plantcast.sources.casting import PlanningTables
from plantcast.sources.records import accepted, check_demand, complete_demand
from plantcast.sources.schemas import KEYS

# Rules. Where the reference runs a model, the probability is the one of the input table.

_P = "coalesce(shortage_probability_replen, 0e0)"
_MODEL_FLAG = f"CASE WHEN {_P} > 5e-1 THEN 1 ELSE 0 END"
_REASON = f"""CASE WHEN demand_gap > 0 THEN 'Demand exceeds supply by ' || printf('%.1f', demand_gap) || ' units'
  WHEN {_P} > 5e-1 THEN 'ML predicted shortage (probability: ' || printf('%.2f', {_P} * 100) || '%)' ELSE 'Sufficient supply available' END"""
_RISK = f"CASE WHEN {_P} >= 7e-1 THEN 'High' WHEN {_P} >= 4e-1 THEN 'Medium' ELSE 'Low' END"
_ALERT = "CASE WHEN scrap_risk_probability >= 6e-1 THEN 'ESCALATE' WHEN scrap_risk_probability >= 4e-1 THEN 'WARN' ELSE 'OK' END"
_SEVERITY = "CASE WHEN scrap_rate_pct >= 10 THEN 'HIGH (Red)' WHEN scrap_rate_pct >= 5 THEN 'MEDIUM (Yellow)' ELSE 'LOW (Green)' END"
_GAPS = ("""SELECT f.week_no, f.material_no, f.scenario, f.forecast_qty, r.stock_level, r.replenishment_order_qty, r.shortage_probability AS shortage_probability_replen,
  f.forecast_qty - (r.stock_level + r.replenishment_order_qty) AS demand_gap
  FROM demand_forecast f LEFT JOIN material_replenishment r USING (week_no, material_no, scenario)""")


def gaps(t: PlanningTables):
    joined = demand.with_replenishment(t.demand_forecast(), t.material_replenishment())
    gap = F.col("forecast_qty") - (F.col("stock_level") + F.col("replenishment_order_qty"))
    return joined.withColumns({"demand_gap": gap, "p": F.coalesce("shortage_probability_replen", F.lit(0.0))})


@query("rule_shortage_report", with_views(f"""
  SELECT week_no, material_no, scenario, supplier_id, demand_gap, below_safety_stock, round(vip_order_ratio, 8) AS vip_order_ratio,
    coalesce(total_requested_qty, 0) AS requested_qty, otif_pct, {flag('demand_gap > 0')} AS shortage_flag,
    CASE WHEN demand_gap > 0 THEN demand_gap ELSE 0e0 END AS recommended_order_qty,
    CASE WHEN demand_gap > 0 THEN 'Demand exceeds supply by ' || printf('%.1f', demand_gap) || ' units' ELSE 'Sufficient supply available' END AS reason
  FROM features""", "features"))
def rule_shortage_report(t):
    return demand.shortage_report(t).withColumn("vip_order_ratio", F.round("vip_order_ratio", 8))


@query("rule_shortage_decision", with_views(f"""
  SELECT week_no, material_no, scenario, {_MODEL_FLAG} AS model_flag, CASE WHEN demand_gap > 0 THEN 1 ELSE {_MODEL_FLAG} END AS final_flag,
    CASE WHEN demand_gap > 0 THEN demand_gap ELSE 0e0 END AS order_qty, {_RISK} AS risk_level, {_REASON} AS reason FROM ({_GAPS})""",
    "demand_forecast", "material_replenishment"))
def rule_shortage_decision(t):
    """Model flag, gap override, order quantity, risk level and reason."""
    p, gap = F.col("p"), F.col("demand_gap")
    return gaps(t).select(
        *KEYS, rules.model_flag(p).alias("model_flag"), rules.shortage_flag(p, gap).alias("final_flag"),
        rules.recommended_order(gap).alias("order_qty"), rules.risk_level(p).alias("risk_level"), rules.shortage_reason(p, gap).alias("reason"))


@query("rule_alerts", with_views(f"""
  SELECT inspection_lot, alert_level, severity, CASE alert_level WHEN 'OK' THEN 'Log result only' WHEN 'WARN' THEN 'Notify quality team'
    ELSE 'Block order + escalate' END AS action
  FROM (SELECT inspection_lot, {_ALERT} AS alert_level, {_SEVERITY} AS severity FROM scrap_quality)""", "scrap_quality"))
def rule_alerts(t):
    level = rules.alert_level(F.col("scrap_risk_probability"))
    return t.scrap_quality().select(
        "inspection_lot", level.alias("alert_level"), rules.scrap_severity(F.col("scrap_rate_pct")).alias("severity"), rules.alert_action(level).alias("action"))


@query("rule_severity_unknown", with_views("""
  SELECT inspection_lot, CASE WHEN shift = 'Night' THEN NULL WHEN scrap_rate_pct >= 10 THEN 'HIGH (Red)' WHEN scrap_rate_pct >= 5 THEN 'MEDIUM (Yellow)'
    ELSE 'LOW (Green)' END AS severity FROM scrap_quality""", "scrap_quality"))
def rule_severity_unknown(t):
    """No prediction, no severity."""
    pct = F.when(F.col("shift") != "Night", F.col("scrap_rate_pct"))
    return t.scrap_quality().select("inspection_lot", rules.scrap_severity(pct).alias("severity"))


_NUMBERS = """SELECT 'classifier' AS target, 'accuracy' AS metric, avg(CASE WHEN actual_shortage_flag = pred_shortage_flag THEN 1e0 ELSE 0e0 END) AS value FROM predictions
  UNION ALL SELECT 'classifier', 'precision', count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 1) / count(*) FILTER (pred_shortage_flag = 1) FROM predictions
  UNION ALL SELECT 'classifier', 'recall', count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 1) / count(*) FILTER (actual_shortage_flag = 1) FROM predictions
  UNION ALL SELECT 'classifier', 'f1_score', 2 * count(*) FILTER (actual_shortage_flag = 1 AND pred_shortage_flag = 1)
    / (count(*) FILTER (actual_shortage_flag = 1) + count(*) FILTER (pred_shortage_flag = 1)) FROM predictions
  UNION ALL SELECT 'probability', 'mae', avg(abs(actual_shortage_prob - pred_shortage_prob)) FROM predictions
  UNION ALL SELECT 'probability', 'r2', 1 - sum(pow(a - p, 2)) / sum(pow(a - m, 2)) FROM (SELECT actual_shortage_prob AS a, pred_shortage_prob AS p, avg(actual_shortage_prob) OVER () AS m FROM predictions)
  UNION ALL SELECT 'order_qty', 'mae', avg(abs(actual_order_qty - pred_order_qty)) FROM predictions
  UNION ALL SELECT 'order_qty', 'mape', avg(abs(actual_order_qty - pred_order_qty) / greatest(abs(actual_order_qty), 2.220446049250313e-16)) FROM predictions
  UNION ALL SELECT 'order_qty', 'r2', 1 - sum(pow(a - p, 2)) / sum(pow(a - m, 2)) FROM (SELECT actual_order_qty AS a, pred_order_qty AS p, avg(actual_order_qty) OVER () AS m FROM predictions)"""


@query("rule_model_status", with_views(f"""
  SELECT target, metric, round(value, 8) AS value, CASE target WHEN 'probability' THEN CASE WHEN value > 6e-1 THEN 'GOOD' ELSE 'NEEDS TUNING' END
    WHEN 'classifier' THEN CASE WHEN value > 95e-2 THEN 'EXCELLENT' ELSE 'NEEDS REVIEW' END
    ELSE CASE WHEN value > 5e-1 THEN 'GOOD' WHEN value > 0 THEN 'ACCEPTABLE' ELSE 'POOR' END END AS status
  FROM ({_NUMBERS}
    UNION ALL SELECT 'classifier', 'roc_auc', sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM (
        SELECT pred_shortage_confidence AS s, count(*) FILTER (actual_shortage_flag = 1) AS pos, count(*) FILTER (actual_shortage_flag = 0) AS neg FROM predictions GROUP BY 1)))
  WHERE metric = 'r2' OR metric = 'roc_auc'""", "predictions"))
def rule_model_status(t):
    p = t.predictions()
    area = classifier_metrics_frame(p, "actual_shortage_flag", "pred_shortage_flag", "pred_shortage_confidence")
    auc = stack_metrics({"classifier": area.select("roc_auc")}, None).withColumnRenamed("model", "target")
    numbers = reports.accuracy_numbers(p).unionByName(auc)
    return reports.status_report(numbers).select("target", "metric", rounded("value"), "status")


@query("rule_retrain", with_views("""
  SELECT 'schedule' AS reason FROM (SELECT max(predicted_at)::DATE AS d FROM predictions) WHERE date_diff('day', d, DATE '2026-04-10') / 7 >= 4
  UNION ALL SELECT 'auc' FROM (SELECT sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM (
        SELECT pred_shortage_confidence AS s, count(*) FILTER (actual_shortage_flag = 1) AS pos, count(*) FILTER (actual_shortage_flag = 0) AS neg FROM predictions GROUP BY 1)))
    WHERE auc < 8e-1
  UNION ALL SELECT 'new keys' WHERE EXISTS (SELECT 1 FROM material_master m WHERE NOT EXISTS (SELECT 1 FROM demand_forecast f WHERE f.material_no = m.material_no))
  UNION ALL SELECT 'disruption' WHERE EXISTS (SELECT 1 FROM demand_forecast WHERE scenario = 'SUPPLIER_FAILURE')""", "predictions", "material_master", "demand_forecast"))
def rule_retrain(t):
    """Reasons to retrain at a given date."""
    p = t.predictions()
    area = classifier_metrics_frame(p, "actual_shortage_flag", "pred_shortage_flag", "pred_shortage_confidence").select("roc_auc")
    newest = p.agg(F.max("predicted_at")).scalar()
    table = stack_metrics({"classifier": area}, None).withColumn("run_ts", newest)
    forecast = t.demand_forecast()
    fresh = unseen_keys(t.material_master(), fit_encoder(forecast, "material_no"), "material_no")
    return reports.retrain_reasons(table, fresh, forecast.where("scenario = 'SUPPLIER_FAILURE'"), F.lit("2026-04-10").cast("timestamp"))


# Reports.


@query("report_prediction_frame", with_views("""
  SELECT week_no, material_no, shortage_flag AS actual_shortage_flag, shortage_probability AS actual_shortage_prob, replenishment_order_qty AS actual_order_qty,
    shortage_flag AS pred_shortage_flag, shortage_probability AS pred_shortage_confidence, shortage_probability AS pred_shortage_prob,
    replenishment_order_qty AS pred_order_qty, stock_level, reorder_point FROM material_replenishment""", "material_replenishment"))
def report_prediction_frame(t):
    """Actuals and context appear only where the source has them (no supplier column here)."""
    scored = t.material_replenishment().drop("supplier_otif_pct").withColumns(
        {"pred_shortage_flag": F.col("shortage_flag"), "pred_shortage_confidence": F.col("shortage_probability"),
         "pred_shortage_prob": F.col("shortage_probability"), "pred_order_qty": F.col("replenishment_order_qty")})
    return reports.prediction_frame(scored)


@query("report_kpis", with_views("""
  SELECT count(DISTINCT material_no) AS total_materials, round(avg(pred_shortage_prob), 8) AS avg_shortage_prob,
    count(*) FILTER (pred_shortage_confidence > 7e-1) AS high_risk_count FROM predictions""", "predictions"))
def report_kpis(t):
    return reports.kpi_row(t.predictions()).select("total_materials", rounded("avg_shortage_prob"), "high_risk_count")


@query("report_high_risk", with_views("""
  SELECT week_no, material_no, round(pred_shortage_confidence, 8) AS pred_shortage_confidence, round(pred_shortage_prob, 8) AS pred_shortage_prob, pred_order_qty
  FROM (SELECT * FROM predictions WHERE pred_shortage_confidence > 7e-1 ORDER BY pred_shortage_confidence DESC, row_id LIMIT 10)""", "predictions"))
def report_high_risk(t):
    top = reports.high_risk(t.predictions(), 10, ["row_id"]).select(*reports.TOP_COLUMNS)
    return top.withColumns({c: F.round(F.col(c), 8) for c in ("pred_shortage_confidence", "pred_shortage_prob")})


@query("report_accuracy", with_views(f"""
  SELECT target, metric, CASE WHEN target = 'classifier' THEN printf('%.1f', value * 100) || '%' WHEN target = 'order_qty' AND metric = 'mae' THEN printf('%.2f', value) || ' units'
      WHEN metric = 'mape' THEN printf('%.2f', value * 100)[:9] || ' of ' || length(printf('%.2f', value * 100) || '%') ELSE printf('%.4f', value) END AS text,
    CASE target WHEN 'classifier' THEN 'Classifier' WHEN 'probability' THEN 'Probability' ELSE 'Order Qty' END AS target_label,
    CASE metric WHEN 'f1_score' THEN 'F1 Score' WHEN 'mape' THEN 'Mape' ELSE upper(metric[1]) || metric[2:] END AS metric_label FROM ({_NUMBERS})""", "predictions"))
def report_accuracy(t):
    """The percentage error is astronomically large here: its first digits and its length stand for its text."""
    long = F.concat(F.substring("text", 1, 9), F.lit(" of "), F.length("text"))
    return reports.accuracy_summary(t.predictions()).withColumn("text", F.when(F.col("metric") == "mape", long).otherwise(F.col("text")))


@query("report_shortage_cases", with_views("""
  SELECT week_no, material_no, row_id, stock_level, reorder_point, CASE WHEN pred_shortage_flag = 1 THEN 'SHORTAGE' ELSE 'NO SHORTAGE' END AS predicted,
    CASE WHEN pred_shortage_flag = actual_shortage_flag THEN '[OK]' ELSE '[WRONG]' END AS verdict,
    round(abs(actual_shortage_prob - pred_shortage_prob), 8) AS prob_error, abs(actual_order_qty - pred_order_qty) AS qty_error
  FROM predictions WHERE actual_shortage_flag = 1 ORDER BY week_no, material_no, row_id LIMIT 10""", "predictions"))
def report_shortage_cases(t):
    out = reports.shortage_cases(t.predictions(), 10, ["week_no", "material_no", "row_id"])
    return out.withColumn("prob_error", F.round("prob_error", 8))


@query("report_summary", with_views("""
  SELECT count(*) AS total, sum(actual_shortage_flag)::BIGINT AS actual_shortages, sum(pred_shortage_flag)::BIGINT AS predicted_shortages,
    round(avg(CASE WHEN actual_shortage_flag = pred_shortage_flag THEN 1e0 ELSE 0e0 END), 8) AS accuracy, count(*) FILTER (pred_shortage_confidence > 7e-1) AS high_risk,
    round(sum(actual_shortage_flag) / count(*), 8) AS actual_shortages_share, round(sum(pred_shortage_flag) / count(*), 8) AS predicted_shortages_share FROM predictions""", "predictions"))
def report_summary(t):
    out = reports.summary_row(t.predictions())
    return out.withColumns({c: F.round(F.col(c), 8) for c in ("accuracy", "actual_shortages_share", "predicted_shortages_share")})


@query("report_metric_table", with_views(f"""
  SELECT target AS model, metric, CASE WHEN metric = 'mape' THEN round(value / pow(10, floor(log10(value))), 6) ELSE printf('%.4f', value)::DOUBLE END AS value FROM ({_NUMBERS})""", "predictions"))
def report_metric_table(t):
    """Long metric table, rounded to four decimals; of the percentage error, far above one here, the leading digits."""
    numbers = reports.accuracy_numbers(t.predictions())
    return numbers.select(F.col("target").alias("model"), "metric", _shown(F.col("metric"), F.col("value")).alias("value"))


def _shown(metric, value):
    leading = F.round(value / F.pow(F.lit(10.0), F.floor(F.log10(value))), 6)
    return F.when(metric == "mape", leading).otherwise(exact_round(value, 4))


# Decision steps after the models.


@query("score_demand_decisions", with_views(f"""
  SELECT material_no, week_no, scenario, forecast_qty AS ml_forecast_qty, printf('%.4f', p)::DOUBLE AS ml_shortage_probability,
    CASE WHEN demand_gap > 0 OR p > 5e-1 THEN 1 ELSE 0 END AS ml_shortage_flag, demand_gap,
    CASE WHEN demand_gap > 0 THEN demand_gap ELSE 0e0 END AS recommended_order_qty,
    CASE WHEN p >= 7e-1 THEN 'High' WHEN p >= 4e-1 THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN demand_gap > 0 THEN 'Demand exceeds supply by ' || printf('%.1f', demand_gap) || ' units'
      WHEN p > 5e-1 THEN 'ML predicted shortage (probability: ' || printf('%.2f', p * 100) || '%)' ELSE 'Sufficient supply available' END AS reason
  FROM (SELECT *, 1 - supplier_otif_pct / 100 AS p, forecast_qty - (stock_level + replenishment_order_qty) AS demand_gap
    FROM demand_forecast JOIN material_replenishment USING (week_no, material_no, scenario))""", "demand_forecast", "material_replenishment"))
def score_demand_decisions(t):
    """Records through validation, defaults and decisions, with a probability computed from the delivery rate."""
    from plantcast.catalog.tables import demand_records
    from plantcast.functions.features import demand_features

    ready = demand_features(complete_demand(accepted(check_demand(demand_records(t)))))
    return scoring.decide_demand(ready, F.col("forecast_qty"), 1 - F.col("supplier_otif_pct") / 100)
