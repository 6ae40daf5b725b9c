"""Training and scoring on small made-up frames: structure, ranges and agreement with plain computations."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plantcast.operators.encode import fit_encoder
from plantcast.plans import scoring, training
from plantcast.session import checkpoint_root, work_path
from plantcast.sources import records
from plantcast.sources.schemas import DEMAND_OUTPUT, INSPECTION_CONTEXT, INSPECTION_RECORD
from plantcast.streaming import jobs
from tests.test_rules import inspection, record_values


@pytest.fixture(scope="module")
def demand_rows(spark):
    """Complete demand records whose label follows the gap."""
    rng = random.Random(7)
    rows = [
        (f"M-{i % 12}", 1 + i // 12, ["NORMAL", "DEMAND_SPIKE"][i // 12 % 2], float(rng.randrange(100, 600)), float(rng.randrange(50, 500)), float(rng.randrange(100, 500)))
        for i in range(360)
    ]
    schema = "material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double"
    return spark.createDataFrame(rows, schema).coalesce(2)


@pytest.fixture(scope="module")
def models(spark, demand_rows):
    encoders = {"material": fit_encoder(demand_rows, "material_no"), "scenario": fit_encoder(demand_rows, "scenario")}
    ready = scoring.demand_inputs(demand_rows, encoders)
    labelled = ready.withColumn("shortage_flag", (F.col("demand_gap") > -150).cast("int")).checkpoint()
    forecast = training.train_forecast(labelled, maxIter=15)
    base, shortage, calibrated = training.train_shortage(labelled, numTrees=15, maxDepth=5)
    return scoring.DemandModels(forecast.model, shortage, encoders), forecast, base, calibrated


def test_training_quality(models):
    _, forecast, base, calibrated = models
    metrics = forecast.metrics.first()
    assert metrics.r2 > 0.9 and 0 < metrics.mae <= metrics.rmse
    for frame in (base.metrics, calibrated):
        row = frame.first()
        assert row.roc_auc > 0.95 and row.accuracy > 0.85
    importances = {r.feature: r.importance for r in base.importances.collect()}
    assert len(importances) == 41 and sum(importances.values()) == pytest.approx(1.0)
    assert max(importances, key=importances.get) in ("demand_gap", "available_supply", "stock_coverage_weeks")


def test_extremes(spark, models):
    schema = "material_no string, week_no int, scenario string, forecast_qty double, stock_level double, replenishment_order_qty double"
    rows = [(f"N-{i}", 1, "NORMAL", 200.0, 500.0, 300.0) for i in range(25)] + [(f"P-{i}", 1, "NORMAL", 600.0, 50.0, 50.0) for i in range(25)]
    scored = scoring.score_demand(spark.createDataFrame(rows, schema), models[0])
    assert scored.columns == list(DEMAND_OUTPUT)
    for r in scored.collect():
        if r.material_no.startswith("N"):
            assert r.ml_shortage_probability <= 0.3 and r.risk_level == "Low" and r.recommended_order_qty == 0
        else:
            assert r.ml_shortage_probability >= 0.7 and r.risk_level == "High" and r.ml_shortage_flag == 1 and r.recommended_order_qty == 500


def test_saved_models_score_alike_and_streams_match_batches(spark, demand_rows, models):
    path = work_path(spark, "m")
    models[0].save(spark, path)
    loaded = scoring.DemandModels.load(spark, path)
    batch = scoring.score_demand(demand_rows, models[0])
    again = scoring.score_demand(demand_rows, loaded)
    assert batch.exceptAll(again).isEmpty() and again.exceptAll(batch).isEmpty()
    source, out = work_path(spark, "in"), work_path(spark, "out")
    demand_rows.repartition(3).write.json(source)
    stream = jobs.read_record_stream(spark, source, demand_rows.schema, files_per_batch=1)
    jobs.score_stream(stream, lambda df: scoring.score_demand(df, loaded), out, work_path(spark, "marks")).awaitTermination()
    streamed = spark.read.parquet(out).select(*DEMAND_OUTPUT)
    assert batch.exceptAll(streamed).isEmpty() and streamed.exceptAll(batch).isEmpty()


def test_sigmoid_matches_newton(spark):
    """Slope and intercept against a plain Newton fit of the smoothed log loss."""
    rng = random.Random(2)
    data = [(x, int(rng.random() < 1 / (1 + math.exp(-(6 * x - 3))))) for x in (rng.random() for _ in range(300))]
    positives = sum(y for _, y in data)
    hi, lo = (positives + 1) / (positives + 2), 1 / (len(data) - positives + 2)
    a = b = 0.0
    for _ in range(50):
        g = [0.0, 0.0]
        h = [1e-12, 0.0, 1e-12]
        for x, y in data:
            p = 1 / (1 + math.exp(-(a * x + b)))
            d, w = p - (hi if y else lo), p * (1 - p)
            g[0] += d * x
            g[1] += d
            h[0] += w * x * x
            h[1] += w * x
            h[2] += w
        det = h[0] * h[2] - h[1] ** 2
        a -= (g[0] * h[2] - g[1] * h[1]) / det
        b -= (g[1] * h[0] - g[0] * h[1]) / det
    slope, intercept = training.fit_sigmoid(spark.createDataFrame([(x, float(y)) for x, y in data], "s double, label double"), "s")
    assert slope == pytest.approx(a, rel=1e-3) and intercept == pytest.approx(b, rel=1e-3)


def test_calibration_keeps_the_order_of_each_member(spark):
    steps = spark.createDataFrame([(i / 10,) for i in range(11)], "x double")
    values = [r[0] for r in steps.select(training.sigmoid(F.col("x"), 4.0, -2.0)).collect()]
    assert values == sorted(values) and all(0 <= v <= 1 for v in values)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] * 9, "label double")
    sums = {r.label: r.w for r in training.class_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0.0] == pytest.approx(6.0) and sums[1.0] == pytest.approx(6.0)


def test_fold_summary_uses_population_deviation(spark):
    row = training.summarise_folds(spark.createDataFrame([(0, 0.9), (1, 1.0)], "fold int, r2 double")).first()
    assert row.cv_r2_mean == pytest.approx(0.95) and row.cv_r2_std == pytest.approx(0.05)


@pytest.fixture(scope="module")
def scrap(spark):
    rng = random.Random(4)
    rows = [
        record_values(
            inspection_lot=f"IL-{i:04d}", inspection_date=f"2026-01-{1 + i % 28:02d}", scrap_rate_pct=float(rng.randrange(0, 200)) / 10,
            machine_type=rng.choice(["Lathe", "Press"]), material_group=rng.choice(["G1", "G2", "G3"]))
        for i in range(300)
    ]
    lots = spark.createDataFrame(rows, INSPECTION_RECORD).coalesce(2)
    encoders = {"machine_type": fit_encoder(lots, "machine_type"), "material_group": fit_encoder(lots, "material_group")}
    from plantcast.plans.scrap import encode_lots

    rows = encode_lots(lots, encoders).withColumn("target", (F.col("scrap_rate_pct") > 8).cast("int"))
    risk, pct = training.train_scrap_risk(rows, maxIter=10), training.train_scrap_pct(rows, maxIter=10)
    return lots, risk, pct, encoders


def test_scrap_models(spark, scrap):
    lots, risk, pct, encoders = scrap
    assert risk.metrics.first().roc_auc > 0.95 and pct.metrics.first().r2 > 0.8
    scored = scoring.score_lots(lots, scoring.ScrapModels(risk.model, pct.model, encoders))
    assert scored.columns[:7] == ["inspection_lot", "production_order_no", "scrap_risk_probability", "alert_level", "predicted_scrap_pct", "scrap_severity", "timestamp"]
    assert set(INSPECTION_CONTEXT) <= set(scored.columns) and scored.count() == 300
    without = scoring.score_lots(lots, scoring.ScrapModels(risk.model, None, encoders))
    assert without.where("predicted_scrap_pct IS NOT NULL OR scrap_severity IS NOT NULL").isEmpty()
    assert without.where("scrap_risk_probability NOT BETWEEN 0 AND 1").isEmpty()


def test_three_targets_and_selection(spark):
    checkpoint_root(spark)
    rng = random.Random(9)
    data = [(f"k{i}", [rng.random(), rng.random(), rng.random()]) for i in range(300)]
    df = spark.createDataFrame(data, "grain_key string, v array<double>").coalesce(2)
    rows = df.select(
        "grain_key", array_to_vector("v").alias("features"), (F.col("v")[0] > 0.5).cast("double").alias("flag"), F.col("v")[1].alias("prob"),
        (F.col("v")[2] * 100 - 20 + F.col("v")[1] * 30).alias("qty")).checkpoint()
    out = training.train_three_targets(rows, "flag", "prob", "qty", maxIter=8).transform(rows)
    assert out.where("pred_order_qty < 0 OR pred_shortage_prob NOT BETWEEN 0 AND 1").isEmpty()
    assert dict(out.dtypes)["pred_order_qty"] == "int"
    assert training.select_features(rows, "qty", 1).selectedFeatures == [2]
    search = training.search_parameters(rows, "qty", {"maxDepth": [1, 3]}, folds=2, maxIter=4)
    best = search.where("is_best").collect()
    assert len(best) == 1 and best[0].r2 == search.agg(F.max("r2")).first()[0]


def test_route_stream_replay_does_not_double(spark):
    source = work_path(spark, "src")
    inspection(spark).union(inspection(spark, inspection_lot="IL-2", inspected_qty=0)).write.json(source)
    good, bad = work_path(spark, "good"), work_path(spark, "bad")

    def decide(df):
        return scoring.decide_lots(df, F.lit(0.7), F.lit(6.0))

    for marks in ("first", "second"):  # a lost checkpoint makes the batch run again
        stream = jobs.read_record_stream(spark, source, INSPECTION_RECORD)
        jobs.route_stream(records.check_inspection(stream), decide, records.VIOLATIONS, good, bad, work_path(spark, marks)).awaitTermination()
    assert [(r.inspection_lot, r.alert_level) for r in spark.read.parquet(good).collect()] == [("IL-1", "ESCALATE")]
    assert [(r.inspection_lot, r.violations) for r in spark.read.parquet(bad).collect()] == [("IL-2", ["inspected_qty out of range"])]


def test_upsert_stream_keeps_newest(spark):
    source, out = work_path(spark, "up"), work_path(spark, "table")
    schema = "week_no int, material_no string, qty int, at int"
    for rows in ([(1, "A", 1, 1), (2, "B", 1, 5)], [(1, "A", 2, 3), (1, "C", 7, 1)], [(1, "A", 9, 2), (2, "B", 0, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.upsert_stream(stream, out, work_path(spark, "upm"), ["week_no", "material_no"], ["at"]).awaitTermination()
    assert {(r.week_no, r.material_no): r.qty for r in spark.read.parquet(out).collect()} == {(1, "A"): 2, (1, "C"): 7, (2, "B"): 1}
