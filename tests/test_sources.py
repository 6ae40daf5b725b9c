import json

import pytest
from pyspark.sql import functions as F

from plantcast.operators.encode import fit_encoder, named_encoders, pick_encoder
from plantcast.operators.keyed import latest_per_key, merge_latest
from plantcast.operators.metrics import stack_metrics
from plantcast.session import checkpoint_root, work_path
from plantcast.sources import records, tables
from plantcast.sources.schemas import DEMAND_DEFAULTS, DEMAND_RECORD, FORECAST_FEATURES, SCRAP_FEATURES, SHORTAGE_FEATURES, TABLES


def test_csv_with_fixed_schema(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "part.csv").write_text(
        "replenishment_id,week_no,week_start_date,material_no,supplier_id,stock_level,reorder_point,replenishment_order_qty,expected_delivery_date,"
        "supplier_lead_time_days,supplier_otif_pct,shortage_flag,shortage_probability,scenario\n"
        "R-A,3,2031-02-10,P-7,V-1,11,5,22,2031-02-20,9,50.5,0,0,CALM\nR-B,3,2031-02-10,P-8,V-2,3,5,30,2031-02-21,8,61.25,1,0.75,CALM\n")
    df = tables.read_csv(spark, str(folder), "material_replenishment")
    assert df.schema == TABLES["material_replenishment"]
    rows = df.orderBy("replenishment_id").collect()
    assert rows[0].week_start_date.isoformat() == "2031-02-10" and [r.shortage_probability for r in rows] == [0.0, 0.75]


def test_feature_list_sizes():
    assert (len(FORECAST_FEATURES), len(SHORTAGE_FEATURES), len(SCRAP_FEATURES), len(DEMAND_DEFAULTS)) == (50, 41, 22, 33)
    assert all(len(set(names)) == len(names) for names in (FORECAST_FEATURES, SHORTAGE_FEATURES, SCRAP_FEATURES))


def test_nested_documents(spark, tmp_path):
    folder = tmp_path / "doc"
    folder.mkdir()
    (folder / "metrics.json").write_text(json.dumps({"a": {"mae": 1.5, "r2": 0.25}, "b": {"roc_auc": 1.0}}, indent=2))
    got = {(r.model, r.metric): r.value for r in tables.read_nested_metrics(spark, str(folder)).collect()}
    assert got == {("a", "mae"): 1.5, ("a", "r2"): 0.25, ("b", "roc_auc"): 1.0}
    (folder / "metrics.json").write_text(json.dumps({"regression": ["x", "y"], "shortage": ["z"]}, indent=2))
    lists = tables.read_feature_lists(spark, str(folder))
    assert sorted(map(tuple, lists.collect())) == [("regression", 0, "x"), ("regression", 1, "y"), ("shortage", 0, "z")]


def test_feature_lists_are_written_in_order(spark):
    path = work_path(spark, "lists")
    tables.write_feature_lists(spark, {"scrap": SCRAP_FEATURES}, path)
    rows = tables.read_feature_lists(spark, path).orderBy("position").collect()
    assert tuple(r.feature for r in rows) == SCRAP_FEATURES


def test_predictions_csv_rerun_replaces_only_its_run(spark):
    path = work_path(spark, "csv")
    one = spark.createDataFrame([(1, "M-1")], "week_no int, material_no string")
    for run, rows in (("a", one), ("b", one.union(one)), ("a", one)):
        tables.write_predictions_csv(rows, path, run)
    counts = spark.read.option("header", True).csv(path).groupBy("run_ts").count()
    assert {r.run_ts: r["count"] for r in counts.collect()} == {"a": 1, "b": 2}


def test_metrics_are_appended(spark):
    path = work_path(spark, "metrics")
    wide = spark.createDataFrame([(0.123456, 2.0)], "mae double, r2 double")
    for hour in ("2026-01-01", "2026-02-01"):
        tables.append_metrics(stack_metrics({"m": wide}).withColumn("run_ts", F.lit(hour).cast("timestamp")), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 4 and rows.where("metric = 'mae'").first().value == 0.1235


def test_upsert_touches_only_its_weeks(spark):
    path = work_path(spark, "keyed")
    schema = "week_no int, material_no string, qty int, predicted_at int"
    keys, newest = ["week_no", "material_no"], ["predicted_at"]
    tables.upsert_predictions(spark.createDataFrame([(1, "A", 1, 1), (1, "B", 1, 1), (2, "A", 1, 1)], schema), path)
    before = {f for f in spark.read.parquet(path).where("week_no = 2").inputFiles() if "week_no=2" in f}
    stored = spark.read.parquet(path).where("week_no = 1").select("week_no", "material_no", "qty", "predicted_at")
    tables.upsert_predictions(merge_latest(stored, spark.createDataFrame([(1, "A", 9, 2), (1, "B", 0, 0)], schema), keys, newest), path)
    rows = spark.read.parquet(path)
    assert {(r.week_no, r.material_no): r.qty for r in rows.collect()} == {(1, "A"): 9, (1, "B"): 1, (2, "A"): 1}
    assert before == {f for f in rows.inputFiles() if "week_no=2" in f}
    assert latest_per_key(rows, keys, newest).count() == 3


def test_record_batches_and_defaults(spark):
    batch = spark.createDataFrame(
        [([("M-1", 1, "NORMAL", 200.0, 50.0, 50.0), ("M-2", 1, "NORMAL", 100.0, 5.0, 5.0)],)],
        "records array<struct<material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double>>",
    )
    ready = records.complete_demand(records.accepted(records.check_demand(records.explode_batch(batch))))
    assert ready.columns == DEMAND_RECORD.fieldNames()
    row = ready.where("material_no = 'M-2'").first().asDict()
    # A batch quantity of zero, also the default one, counts as one.
    assert {n: row[n] for n in DEMAND_DEFAULTS} == DEMAND_DEFAULTS | {"standard_batch_qty": 1}


def test_present_values_are_not_replaced_by_defaults(spark):
    row = spark.createDataFrame([("M-1", 1, "NORMAL", 1.0, 1.0, 1.0, 0.0, 0)], "material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double, otif_pct double, n_orders int")
    got = records.complete_demand(records.check_demand(row)).first()
    assert (got.otif_pct, got.n_orders) == (0.0, 0)


def test_encoders_survive_storage(spark):
    path = work_path(spark, "enc")
    df = spark.createDataFrame([("b", "x"), ("a", "y")], "p string, q string")
    named_encoders({"p": fit_encoder(df, "p"), "q": fit_encoder(df, "q")}).write.parquet(path)
    assert {r.value: r.code for r in pick_encoder(spark.read.parquet(path), "p").collect()} == {"a": 0, "b": 1}


def test_routes_are_partitions(spark):
    path = work_path(spark, "route")
    tables.route_by_alert(spark.createDataFrame([("1", "OK"), ("2", "WARN"), ("3", "ESCALATE")], "lot string, alert_level string"), path)
    plan = spark.read.parquet(path).where("alert_level = 'WARN'")
    assert all("alert_level=" in f for f in plan.inputFiles())
    assert plan.first().action == "Notify quality team"


def test_working_folder_is_the_configured_one(spark):
    assert work_path(spark, "x").startswith(checkpoint_root(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert checkpoint_root(spark) == configured


def test_audit(spark):
    got = {r.source: (r.n_rows, r.n_columns) for r in tables.audit({"a": spark.range(3), "b": spark.range(2).withColumn("x", F.lit(1))}).collect()}
    assert got == {"a": (3, 1), "b": (2, 2)}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_schemas_have_unique_names(name):
    names = TABLES[name].fieldNames()
    assert len(names) == len(set(names))
