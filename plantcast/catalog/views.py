"""The planning tables and joined frames as SQL, for checking only."""

from __future__ import annotations

KEYS = "week_no, material_no, scenario"


def scenario(week: str) -> str:
    return (
        f"CASE {week} % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'DEMAND_SPIKE' "
        "WHEN 2 THEN 'SUPPLIER_FAILURE' ELSE 'MACHINE_BREAKDOWN' END"
    )


def week(ts: str) -> str:
    return f"CAST(weekofyear({ts}) AS INTEGER)"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (sql, needs)


def with_views(body: str, *names: str) -> str:
    """``WITH`` clause of the named views and all they need, in order, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in VIEWS[name][1]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in ordered) + "\n" + body


view("demand_forecast", f"""
  SELECT 'DFS-' || week_no || '-' || k AS forecast_id, week_no, 'M-' || k AS material_no, 'SUP-' || supplier AS supplier_id,
    forecast_qty, forecast_qty / years AS historical_avg_qty, 1 + (week_no % 5) / 10 AS seasonal_index,
    CAST((k + week_no) % 2 AS INTEGER) AS deviation_flag, 5e-1 + (k % 10) / 20 AS confidence_score,
    ((k + week_no) % 100) / 100 AS shortage_probability, CAST(5 + k % 22 AS INTEGER) AS supplier_lead_time_days,
    {scenario('week_no')} AS scenario
  FROM (SELECT {week('l_shipdate')} AS week_no, l_partkey AS k, sum(l_quantity) AS forecast_qty, min(l_suppkey) AS supplier,
          count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1, 2)""")
view("material_replenishment", f"""
  SELECT 'MR-' || week_no || '-' || k AS replenishment_id, week_no, 'M-' || k AS material_no, stock_level, 200 AS reorder_point,
    replenishment_order_qty, CAST(60 + (k + week_no) % 41 AS DOUBLE) AS supplier_otif_pct,
    {flag('stock_level < replenishment_order_qty')} AS shortage_flag, ((k * 7 + week_no) % 100) / 100 AS shortage_probability,
    {scenario('week_no')} AS scenario
  FROM (SELECT {week('l_shipdate')} AS week_no, l_partkey AS k,
          CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS INTEGER) AS stock_level,
          CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS INTEGER) AS replenishment_order_qty
        FROM lineitem GROUP BY 1, 2)""")
view("order_lines", f"""
  SELECT *, {week('l_shipdate')} AS week_no, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("customer_orders", f"""
  SELECT 'CO-' || o_orderkey AS customer_order_no, 'C-' || o_custkey AS customer_id, o_orderpriority AS customer_priority,
    'M-' || l_partkey AS material_no, CAST(l_quantity AS INTEGER) AS requested_qty,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS confirmed_qty, o_orderdate::DATE AS order_date,
    CASE o_orderstatus WHEN 'P' THEN 'At Risk' WHEN 'F' THEN 'Overdue' ELSE 'On Track' END AS delivery_status,
    l_extendedprice AS contract_value_eur, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS vip_flag,
    {scenario('week_no')} AS scenario, week_no FROM order_lines""", "order_lines")
view("production_orders", f"""
  SELECT l_orderkey * 10 + l_linenumber AS production_order_no, week_no, 'M-' || l_partkey AS material_no,
    {scenario('week_no')} AS scenario, CAST(days % 24 AS DOUBLE) AS start_delay_hrs, CAST(days % 48 AS DOUBLE) AS finish_delay_hrs,
    l_discount * 10 AS overload_probability, (l_tax - 4e-2) * 100 AS throughput_deviation_pct FROM order_lines""", "order_lines")
view("work_centre_utilization", f"""
  SELECT o_orderpriority AS work_centre, week_no, {scenario('week_no')} AS scenario, CAST(o_custkey % 101 AS DOUBLE) AS utilization_pct,
    (o_orderkey % 20) / 10 AS downtime_hrs, CAST(o_orderkey % 12 AS DOUBLE) AS delay_hrs, (o_custkey % 10) / 10 AS overload_probability
  FROM (SELECT *, {week('o_orderdate')} AS week_no FROM orders)""")
view("material_master", """
  SELECT 'M-' || p_partkey AS material_no, p_name AS material_name, p_type AS material_group, 'SUP-' || (p_partkey % 120) AS primary_supplier_id,
    p_retailprice AS unit_cost_eur, p_size AS standard_batch_qty, p_size * 4 AS reorder_point, p_size * 2 AS safety_stock FROM part""")
view("supplier_master", """
  SELECT 'SUP-' || s_suppkey AS supplier_id, s_name AS supplier_name, CAST(5 + s_suppkey % 10 AS INTEGER) AS avg_lead_time_days,
    CAST(70 + s_suppkey % 30 AS INTEGER) AS otif_pct, CAST(s_suppkey % 15 AS DOUBLE) AS scrap_contribution_pct,
    CAST(s_suppkey % 7 AS DOUBLE) AS rework_contribution_pct, CAST(s_suppkey % 100 AS INTEGER) AS risk_score_m5 FROM supplier""")
view("scrap_quality", f"""
  SELECT 'INS-' || lpad(event_id::VARCHAR, 12, '0') AS inspection_lot, event_id + 4701 AS production_order_no, 'M-' || user_id AS material_no,
    'WC-' || (user_id % 7) AS work_centre, 'MC-' || (user_id % 11) AS machine_id,
    CASE event_id % 3 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' ELSE 'Night' END AS shift, ts::DATE AS inspection_date,
    CASE event_type WHEN 'click' THEN 'Dimensional' WHEN 'view' THEN 'Surface Finish' WHEN 'error' THEN 'Material Fault'
      WHEN 'purchase' THEN 'Operator Error' ELSE event_type END AS defect_type,
    floor(value) AS defect_rate_pct, CAST(30 + event_id % 170 AS INTEGER) AS inspected_qty, CAST(event_id % 33 AS INTEGER) AS scrap_qty,
    CAST(event_id % 21 AS INTEGER) AS rework_qty, floor(value) / 2 AS scrap_rate_pct, floor(value) / 4 AS rework_rate_pct,
    least(value / 50, 1e0) AS scrap_risk_probability, CAST((event_id % 33) * 10 AS DOUBLE) AS scrap_cost_eur,
    {scenario('week_no')} AS scenario, week_no
  FROM (SELECT *, {week('ts')} AS week_no FROM events)""")
view("machine_master", """
  SELECT 'MC-' || n AS machine_id, 'Unit ' || n AS machine_name,
    CASE n % 4 WHEN 0 THEN 'CNC Lathe' WHEN 1 THEN 'CNC Mill' WHEN 2 THEN 'Press' ELSE 'Welding Robot' END AS machine_type,
    DATE '2025-12-20' + n * 9 AS last_calibration_date, 90 AS calibration_interval_days,
    DATE '2026-02-20' + n * 4 AS last_maintenance_date, 30 AS maintenance_interval_days
  FROM (SELECT DISTINCT CAST(user_id % 11 AS INTEGER) AS n FROM events)""")
view("predictions", f"""
  SELECT event_id AS row_id, {week('ts')} AS week_no, 'M-' || user_id AS material_no,
    {flag("event_type IN ('error', 'purchase')")} AS actual_shortage_flag, (event_id % 101) / 100 AS actual_shortage_prob,
    CAST(event_id % 400 AS INTEGER) AS actual_order_qty, {flag('value > 50')} AS pred_shortage_flag,
    least(value / 200, 1e0) AS pred_shortage_confidence, least(value / 150, 1e0) AS pred_shortage_prob,
    CAST(event_id % 400 + user_id % 37 - 18 AS INTEGER) AS pred_order_qty, CAST(event_id % 300 AS INTEGER) AS stock_level,
    200 AS reorder_point, CAST(60 + event_id % 41 AS DOUBLE) AS supplier_otif, ts AS predicted_at FROM events""")

view("production_grain", f"""
  SELECT {KEYS}, avg(start_delay_hrs) AS avg_start_delay, avg(finish_delay_hrs) AS avg_finish_delay,
    avg(overload_probability) AS avg_overload_prob, avg(throughput_deviation_pct) AS avg_throughput_dev,
    count(production_order_no) AS n_orders FROM production_orders GROUP BY ALL""", "production_orders")
view("scrap_grain", f"""
  SELECT {KEYS}, avg(defect_rate_pct) AS avg_defect_rate, avg(scrap_rate_pct) AS avg_scrap_rate,
    avg(scrap_risk_probability) AS avg_scrap_risk, sum(scrap_cost_eur) AS total_scrap_cost FROM scrap_quality GROUP BY ALL""", "scrap_quality")
view("customer_grain", f"""
  SELECT {KEYS}, CAST(sum(requested_qty) AS BIGINT) AS total_requested_qty, CAST(sum(confirmed_qty) AS BIGINT) AS total_confirmed_qty,
    count(customer_order_no) AS n_customer_orders, count(*) FILTER (vip_flag = 'Y') AS vip_order_count,
    count(*) FILTER (delivery_status = 'At Risk') AS at_risk_order_count FROM customer_orders GROUP BY ALL""", "customer_orders")
view("work_centre_week", """
  SELECT week_no, scenario, avg(utilization_pct) AS avg_wc_utilization, avg(downtime_hrs) AS avg_wc_downtime,
    avg(delay_hrs) AS avg_wc_delay, avg(overload_probability) AS avg_wc_overload, max(utilization_pct) AS max_wc_utilization
  FROM work_centre_utilization GROUP BY ALL""", "work_centre_utilization")
view("star", f"""
  SELECT f.*, r.stock_level, r.shortage_flag, r.shortage_probability AS shortage_probability_replen, r.replenishment_order_qty,
    r.supplier_otif_pct, p.* EXCLUDE ({KEYS}), s.* EXCLUDE ({KEYS}), c.* EXCLUDE ({KEYS}), w.* EXCLUDE (week_no, scenario),
    m.unit_cost_eur, m.reorder_point, m.safety_stock, m.standard_batch_qty,
    u.otif_pct, u.avg_lead_time_days, u.risk_score_m5, u.scrap_contribution_pct
  FROM demand_forecast f LEFT JOIN material_replenishment r USING ({KEYS}) LEFT JOIN production_grain p USING ({KEYS})
    LEFT JOIN scrap_grain s USING ({KEYS}) LEFT JOIN customer_grain c USING ({KEYS}) LEFT JOIN work_centre_week w USING (week_no, scenario)
    LEFT JOIN material_master m USING (material_no) LEFT JOIN supplier_master u USING (supplier_id)""",
     "demand_forecast", "material_replenishment", "production_grain", "scrap_grain", "customer_grain", "work_centre_week",
     "material_master", "supplier_master")
view("features", f"""
  SELECT *, stock_level + replenishment_order_qty AS available_supply, forecast_qty - (stock_level + replenishment_order_qty) AS demand_gap,
    forecast_qty - historical_avg_qty AS qty_deviation,
    (forecast_qty - historical_avg_qty) / (historical_avg_qty + 1e-6) AS qty_deviation_pct,
    stock_level / (forecast_qty + 1e-6) AS stock_coverage_weeks, {flag('stock_level < safety_stock')} AS below_safety_stock,
    {flag('stock_level < reorder_point')} AS below_reorder,
    coalesce(avg_scrap_rate, 0) + coalesce(avg_defect_rate, 0) AS quality_risk_score,
    {flag('coalesce(otif_pct < 85, false) OR coalesce(risk_score_m5 > 60, false)')} AS supplier_risk_flag,
    coalesce(avg_start_delay, 0) + coalesce(avg_finish_delay, 0) AS delay_signal,
    CAST(coalesce(total_requested_qty, 0) - coalesce(total_confirmed_qty, 0) AS DOUBLE) AS customer_demand_gap,
    coalesce(total_confirmed_qty, 0) / (coalesce(total_requested_qty, 0) + 1e-6) AS customer_confirmation_rate,
    coalesce(vip_order_count, 0) / (coalesce(n_customer_orders, 0) + 1e-6) AS vip_order_ratio,
    coalesce(at_risk_order_count, 0) / (coalesce(n_customer_orders, 0) + 1e-6) AS at_risk_order_ratio,
    {flag('coalesce(avg_wc_utilization, 0) > 80')} AS capacity_constraint_flag,
    {flag('coalesce(avg_wc_downtime, 0) > 5e-1')} AS high_downtime_flag FROM star""", "star")
view("lots", """
  SELECT q.*, m.* EXCLUDE (machine_id), t.material_group, t.unit_cost_eur, t.primary_supplier_id, u.supplier_id, u.supplier_name,
    u.otif_pct AS supplier_otif_raw, u.scrap_contribution_pct AS supplier_scrap_raw, u.risk_score_m5 AS supplier_risk_raw,
    u.rework_contribution_pct
  FROM scrap_quality q LEFT JOIN machine_master m USING (machine_id) LEFT JOIN material_master t USING (material_no)
    LEFT JOIN supplier_master u ON t.primary_supplier_id = u.supplier_id""",
     "scrap_quality", "machine_master", "material_master", "supplier_master")
view("lot_load", """
  SELECT *, wc_n / total_n * 100 AS wc_utilization,
    CASE WHEN wc_n / total_n * 100 > 80 THEN (wc_n / total_n * 100 - 80) / 20 ELSE 0e0 END AS wc_overload_prob,
    CASE WHEN z < 0 THEN 0e0 WHEN z > 1 THEN 1e0 ELSE z END AS order_overload_prob,
    (inspected_qty - machine_mean) / machine_mean * 100 AS throughput_deviation_pct
  FROM (SELECT *, count(*) OVER (PARTITION BY work_centre) AS wc_n, count(*) OVER () AS total_n,
          (inspected_qty - avg(inspected_qty) OVER ()) / stddev_samp(inspected_qty) OVER () AS z,
          avg(inspected_qty) OVER (PARTITION BY machine_id) AS machine_mean,
          avg(scrap_rate_pct) OVER (PARTITION BY machine_id ORDER BY inspection_date, inspection_lot ROWS 3 PRECEDING) AS rolling_scrap_4w_machine_id,
          avg(scrap_rate_pct) OVER (PARTITION BY shift ORDER BY inspection_date, inspection_lot ROWS 3 PRECEDING) AS rolling_scrap_4w_shift
        FROM scrap_quality)""", "scrap_quality")
view("lot_features", f"""
  SELECT l.* EXCLUDE (scrap_cost_eur), o.wc_utilization, o.wc_overload_prob, o.order_overload_prob, o.throughput_deviation_pct,
    o.rolling_scrap_4w_machine_id, o.rolling_scrap_4w_shift,
    coalesce(supplier_otif_raw, avg(supplier_otif_raw) OVER ()) AS supplier_otif_pct,
    coalesce(supplier_scrap_raw, avg(supplier_scrap_raw) OVER ()) AS supplier_scrap_pct,
    coalesce(supplier_risk_raw, avg(supplier_risk_raw) OVER ()) AS supplier_risk_score,
    l.scrap_qty * l.unit_cost_eur AS scrap_cost_eur,
    date_diff('day', last_calibration_date, DATE '2026-04-10') AS calibration_lag_days,
    date_diff('day', last_maintenance_date, DATE '2026-04-10') AS maintenance_lag_days,
    {flag("date_diff('day', last_calibration_date, DATE '2026-04-10') > calibration_interval_days")} AS calibration_overdue,
    {flag("date_diff('day', last_maintenance_date, DATE '2026-04-10') > maintenance_interval_days")} AS maintenance_overdue,
    l.rework_qty / (l.scrap_qty + l.rework_qty + 1e-6) AS rework_share,
    l.scrap_qty * l.unit_cost_eur / (l.inspected_qty + 1e-6) AS scrap_cost_per_unit,
    {flag('l.scrap_risk_probability >= 4e-1')} AS target,
    CASE l.shift WHEN 'Morning' THEN 0 WHEN 'Afternoon' THEN 1 WHEN 'Night' THEN 2 ELSE 0 END AS shift_encoded,
    CASE l.defect_type WHEN 'Operator Error' THEN 0 WHEN 'Dimensional' THEN 1 WHEN 'Material Fault' THEN 2
      WHEN 'Surface Finish' THEN 3 WHEN 'Machine Setup' THEN 4 ELSE 0 END AS defect_type_encoded,
    CASE WHEN l.machine_type IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY l.machine_type NULLS LAST) - 1 AS INTEGER) END AS machine_type_encoded,
    CASE WHEN l.material_group IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY l.material_group NULLS LAST) - 1 AS INTEGER) END AS material_group_encoded
  FROM lots l JOIN lot_load o USING (inspection_lot)""", "lots", "lot_load")
