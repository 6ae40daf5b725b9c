"""Planning tables as views over the benchmark's star schema and event table.

Every table is a projection or a grain aggregate of whole input tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.sources.schemas import KEYS

# The scenario of a calendar week, and the shifts of a day.
SCENARIOS = ("NORMAL", "DEMAND_SPIKE", "SUPPLIER_FAILURE", "MACHINE_BREAKDOWN")
SHIFTS = ("Morning", "Afternoon", "Night")
MACHINE_TYPES = ("CNC Lathe", "CNC Mill", "Press", "Welding Robot")


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def scenario_of(week: Column) -> Column:
    return pick(week % 4, SCENARIOS)


def material_id(key: Column) -> Column:
    return F.concat(F.lit("M-"), key.cast("string"))


def supplier_id(key: Column) -> Column:
    return F.concat(F.lit("SUP-"), key.cast("string"))


def with_planning_keys(lines: DataFrame) -> DataFrame:
    """Order lines with the planning keys. Grouping by these very columns leaves a table partitioned the
    way the joins need it."""
    week = F.weekofyear("l_shipdate")
    return lines.withColumns({"week_no": week, "material_no": material_id(F.col("l_partkey")), "scenario": scenario_of(week)})


class PlanningTables:
    """Lazy planning tables over one folder of benchmark files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _week_lines(self) -> DataFrame:
        return with_planning_keys(self.raw("lineitem"))

    def demand_forecast(self) -> DataFrame:
        week, part = F.col("week_no"), F.col("part")
        grain = self._week_lines().groupBy(*KEYS).agg(
            F.min("l_partkey").alias("part"),
            F.sum("l_quantity").alias("forecast_qty"),
            F.min("l_suppkey").alias("supplier"),
            # Distinct years as set bits: stays in the hash aggregate, unlike a collected set.
            F.expr("bit_count(bit_or(shiftleft(1L, year(l_shipdate) - 1970)))").alias("years"),
        )
        return grain.select(
            F.concat_ws("-", F.lit("DFS"), week.cast("string"), part.cast("string")).alias("forecast_id"),
            "week_no",
            "material_no",
            supplier_id(F.col("supplier")).alias("supplier_id"),
            "forecast_qty",
            (F.col("forecast_qty") / F.col("years")).alias("historical_avg_qty"),
            (1 + (week % 5) / 10).alias("seasonal_index"),
            ((part + week) % 2).cast("int").alias("deviation_flag"),
            (F.lit(0.5).cast("double") + (part % 10) / 20).alias("confidence_score"),
            (((part + week) % 100) / 100).alias("shortage_probability"),
            (5 + part % 22).cast("int").alias("supplier_lead_time_days"),
            "scenario",
        )

    def material_replenishment(self) -> DataFrame:
        week, part = F.col("week_no"), F.col("part")
        quantity, returned, closed = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus") == "F"
        grain = self._week_lines().groupBy(*KEYS).agg(
            F.min("l_partkey").alias("part"),
            F.sum(F.when(closed & (returned == "R"), quantity).otherwise(0.0)).cast("int").alias("stock_level"),
            F.sum(F.when(closed & (returned == "A"), quantity).otherwise(0.0)).cast("int").alias("replenishment_order_qty"),
        )
        return grain.select(
            F.concat_ws("-", F.lit("MR"), week.cast("string"), part.cast("string")).alias("replenishment_id"),
            "week_no",
            "material_no",
            "stock_level",
            F.lit(200).alias("reorder_point"),
            "replenishment_order_qty",
            (60 + (part + week) % 41).cast("double").alias("supplier_otif_pct"),
            F.when(F.col("stock_level") < F.col("replenishment_order_qty"), 1).otherwise(0).alias("shortage_flag"),
            (((part * 7 + week) % 100) / 100).alias("shortage_probability"),
            "scenario",
        )

    def _order_lines(self) -> DataFrame:
        """Lines with their order. The keys are made after the join, whose shuffle then carries numbers instead of names."""
        return with_planning_keys(self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")))

    def customer_orders(self) -> DataFrame:
        qty = F.col("l_quantity").cast("int")
        return self._order_lines().select(
            F.concat(F.lit("CO-"), F.col("o_orderkey").cast("string")).alias("customer_order_no"),
            F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("customer_id"),
            F.col("o_orderpriority").alias("customer_priority"),
            "material_no",
            qty.alias("requested_qty"),
            F.when(F.col("l_returnflag") != "R", qty).otherwise(0).alias("confirmed_qty"),
            F.to_date("o_orderdate").alias("order_date"),
            pick_status(F.col("o_orderstatus")).alias("delivery_status"),
            F.col("l_extendedprice").alias("contract_value_eur"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Y").otherwise("N").alias("vip_flag"),
            "scenario",
            "week_no",
        )

    def production_orders(self) -> DataFrame:
        days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
        return self._order_lines().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("production_order_no"),
            *KEYS,
            (days % 24).cast("double").alias("start_delay_hrs"),
            (days % 48).cast("double").alias("finish_delay_hrs"),
            (F.col("l_discount") * 10).alias("overload_probability"),
            ((F.col("l_tax") - F.lit(0.04).cast("double")) * 100).alias("throughput_deviation_pct"),
        )

    def work_centre_utilization(self) -> DataFrame:
        week = F.weekofyear("o_orderdate")
        return self.raw("orders").select(
            F.col("o_orderpriority").alias("work_centre"),
            week.alias("week_no"),
            scenario_of(week).alias("scenario"),
            (F.col("o_custkey") % 101).cast("double").alias("utilization_pct"),
            ((F.col("o_orderkey") % 20) / 10).alias("downtime_hrs"),
            (F.col("o_orderkey") % 12).cast("double").alias("delay_hrs"),
            ((F.col("o_custkey") % 10) / 10).alias("overload_probability"),
        )

    def material_master(self) -> DataFrame:
        size = F.col("p_size")
        return self.raw("part").select(
            material_id(F.col("p_partkey")).alias("material_no"),
            F.col("p_name").alias("material_name"),
            F.col("p_type").alias("material_group"),
            supplier_id(F.col("p_partkey") % 120).alias("primary_supplier_id"),
            F.col("p_retailprice").alias("unit_cost_eur"),
            size.alias("standard_batch_qty"),
            (size * 4).alias("reorder_point"),
            (size * 2).alias("safety_stock"),
        )

    def supplier_master(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            supplier_id(key).alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            (5 + key % 10).cast("int").alias("avg_lead_time_days"),
            (70 + key % 30).cast("int").alias("otif_pct"),
            (key % 15).cast("double").alias("scrap_contribution_pct"),
            (key % 7).cast("double").alias("rework_contribution_pct"),
            (key % 100).cast("int").alias("risk_score_m5"),
        )

    def scrap_quality(self) -> DataFrame:
        return inspections(self.raw("events"))

    def machine_master(self) -> DataFrame:
        number = F.col("n")
        numbers = self.raw("events").select((F.col("user_id") % 11).cast("int").alias("n")).distinct()
        return numbers.select(
            F.concat(F.lit("MC-"), number.cast("string")).alias("machine_id"),
            F.concat(F.lit("Unit "), number.cast("string")).alias("machine_name"),
            pick(number % 4, MACHINE_TYPES).alias("machine_type"),
            F.date_add(F.lit("2025-12-20").cast("date"), number * 9).alias("last_calibration_date"),
            F.lit(90).alias("calibration_interval_days"),
            F.date_add(F.lit("2026-02-20").cast("date"), number * 4).alias("last_maintenance_date"),
            F.lit(30).alias("maintenance_interval_days"),
        )

    def predictions(self) -> DataFrame:
        value, key = F.col("value"), F.col("event_id")
        week = F.weekofyear("ts")
        probability = F.least(value / 200, F.lit(1.0))
        order_qty = (key % 400).cast("int")
        return self.raw("events").select(
            key.alias("row_id"),
            week.alias("week_no"),
            material_id(F.col("user_id")).alias("material_no"),
            F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("actual_shortage_flag"),
            ((key % 101) / 100).alias("actual_shortage_prob"),
            order_qty.alias("actual_order_qty"),
            F.when(value > 50, 1).otherwise(0).alias("pred_shortage_flag"),
            probability.alias("pred_shortage_confidence"),
            F.least(value / 150, F.lit(1.0)).alias("pred_shortage_prob"),
            (order_qty + (F.col("user_id") % 37).cast("int") - 18).alias("pred_order_qty"),
            (key % 300).cast("int").alias("stock_level"),
            F.lit(200).alias("reorder_point"),
            (60 + key % 41).cast("double").alias("supplier_otif"),
            F.col("ts").alias("predicted_at"),
        )


def pick_status(status: Column) -> Column:
    return F.when(status == "P", "At Risk").when(status == "F", "Overdue").otherwise("On Track")


def inspections(events: DataFrame) -> DataFrame:
    """Inspection lots from event rows; works on a batch frame and on a stream."""
    key, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    week = F.weekofyear("ts")
    defect = (
        F.when(F.col("event_type") == "click", "Dimensional")
        .when(F.col("event_type") == "view", "Surface Finish")
        .when(F.col("event_type") == "error", "Material Fault")
        .when(F.col("event_type") == "purchase", "Operator Error")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        F.concat(F.lit("INS-"), F.lpad(key.cast("string"), 12, "0")).alias("inspection_lot"),
        (key + 4701).alias("production_order_no"),
        material_id(user).alias("material_no"),
        F.concat(F.lit("WC-"), (user % 7).cast("string")).alias("work_centre"),
        F.concat(F.lit("MC-"), (user % 11).cast("string")).alias("machine_id"),
        pick(key % 3, SHIFTS).alias("shift"),
        F.to_date("ts").alias("inspection_date"),
        defect.alias("defect_type"),
        F.floor(value).cast("double").alias("defect_rate_pct"),
        (30 + key % 170).cast("int").alias("inspected_qty"),
        (key % 33).cast("int").alias("scrap_qty"),
        (key % 21).cast("int").alias("rework_qty"),
        (F.floor(value) / 2).alias("scrap_rate_pct"),
        (F.floor(value) / 4).alias("rework_rate_pct"),
        F.least(value / 50, F.lit(1.0)).alias("scrap_risk_probability"),
        ((key % 33) * 10).cast("double").alias("scrap_cost_eur"),
        scenario_of(week).alias("scenario"),
        week.alias("week_no"),
    )
