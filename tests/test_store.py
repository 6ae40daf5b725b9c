"""Model store, versioned keyed table, patience of boosted models, and replay of routed streams."""

import random
import threading
from types import SimpleNamespace

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from plantcast.catalog import models as catalog
from plantcast.operators.boosting import best_round, fit_with_patience, in_few_partitions, in_parallel, keep_rounds
from plantcast.plans import scoring, training
from plantcast.plans.store import ModelStore, Versions, content_key, frames_content
from plantcast.session import work_path
from plantcast.sources import records
from plantcast.sources.keyed_table import KeyedTable
from plantcast.sources.schemas import INSPECTION_RECORD
from plantcast.streaming import jobs
from tests.test_rules import inspection


def test_a_plateau_shorter_than_the_patience_does_not_stop():
    plateau = [9, 8, 7, 7, 7, 7, 7, 7, 6, 5, 5.5]
    assert best_round(plateau, 20) == 10
    assert best_round(plateau, 6) == 10
    assert best_round(plateau, 5) == 3
    assert best_round([3, 2, 1] + [2] * 19 + [0.5], 20) == 23
    assert best_round([3, 2, 1] + [2] * 20 + [0.5], 20) == 3
    assert best_round([1.0], 20) == 1


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(3)
    data = [([x := rng.random(), rng.random()], x + rng.gauss(0, 0.4), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(data, "v array<double>, label double, held boolean").coalesce(1)
    return df.select(array_to_vector("v").alias("features"), "label", "held").cache()


def test_rounds_after_the_best_one_are_dropped(spark, noisy):
    learner = GBTRegressor(maxIter=25, stepSize=0.3, maxDepth=4, seed=1)
    train, held = noisy.where("NOT held"), noisy.where("held")
    model, kept = fit_with_patience(learner, train, held, patience=20)
    errors = learner.fit(train).evaluateEachIteration(held, "squared")
    assert kept == best_round(errors, 20) == model.getNumTrees < 25
    same = GBTRegressor(maxIter=kept, stepSize=0.3, maxDepth=4, seed=1).fit(train)
    both = model.transform(held).select("label", F.col("prediction").alias("a")).join(same.transform(held), "label")
    assert both.where(F.abs(F.col("a") - F.col("prediction")) > 1e-9).isEmpty()
    path = work_path(spark, "short")
    model.write().save(path)
    assert GBTRegressionModel.load(path).getNumTrees == kept
    assert keep_rounds(model, 1).featureImportances.size == 2


def test_scrap_model_reports_the_rounds_it_kept(spark, noisy):
    learner = GBTRegressor(maxIter=4, seed=1)
    model, kept = fit_with_patience(learner, noisy, noisy.where("label > 1e9"), patience=20)
    assert kept == model.getNumTrees == 4


def test_jobs_side_by_side_keep_their_order():
    assert in_parallel([lambda i=i: i * i for i in range(7)]) == [i * i for i in range(7)]
    with pytest.raises(ZeroDivisionError):
        in_parallel([lambda: 1, lambda: 1 // 0])


def test_models_are_fitted_once_per_content(spark):
    store, calls = ModelStore(spark, work_path(spark, "store")), []
    a, b = spark.range(5).toDF("x"), spark.range(6).toDF("x")

    def fit(path):
        calls.append(path)
        spark.range(1).write.parquet(path)

    key = content_key({"t": a}, {"rounds": 5})
    assert key == content_key({"t": a.repartition(3)}, {"rounds": 5})
    assert len({key, content_key({"t": b}, {"rounds": 5}), content_key({"t": a}, {"rounds": 6})}) == 3
    first = store.folder("m", key, fit)
    assert store.folder("m", key, fit) == first and calls == [first]

    def broken(path):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        store.folder("other", key, broken)
    assert store.folder("other", key, fit).endswith("version=2") and len(calls) == 2


def test_versions_are_claimed_once(spark):
    versions = Versions(spark, work_path(spark, "versions"))
    assert versions.latest() is None and [versions.claim(), versions.claim()] == [1, 2]
    versions.publish(2)
    assert versions.latest() == 2
    with pytest.raises(ValueError):
        versions.publish(2)


def rows_of(table):
    return {(r.week_no, r.material_no): r.qty for r in table.read().collect()}


def test_keyed_table_keeps_the_newest_and_survives_a_failed_upsert(spark):
    schema = "week_no int, material_no string, qty int, predicted_at timestamp"
    table = KeyedTable(spark, work_path(spark, "keyed"), ["week_no", "material_no"])
    assert table.read() is None
    at = [F.to_timestamp(F.lit(f"2026-01-0{i}")) for i in range(1, 5)]
    first = spark.createDataFrame([(1, "A", 1, None), (2, "B", 2, None), (None, "N", 3, None)], schema)
    assert table.upsert(first.withColumn("predicted_at", at[1])) == 1
    late = spark.createDataFrame([(1, "A", 7, None), (1, "C", 4, None)], schema)
    assert table.upsert(late.withColumn("predicted_at", at[0])) == 2
    assert rows_of(table) == {(1, "A"): 1, (2, "B"): 2, (None, "N"): 3, (1, "C"): 4}
    table.upsert(spark.createDataFrame([(1, "A", 9)], "week_no int, material_no string, qty int"))
    assert rows_of(table)[1, "A"] == 9
    assert table.read().where("predicted_at IS NULL").isEmpty()
    broken = spark.createDataFrame([(2, "B", 5)], "week_no int, material_no string, qty int")
    with pytest.raises(Exception):
        table.upsert(broken.withColumn("qty", F.raise_error(F.lit("lost")).cast("int")))
    assert rows_of(table)[2, "B"] == 2
    assert table.upsert(spark.createDataFrame([], schema)) is None
    again = rows_of(table)
    held = table.read()
    table.upsert(held)
    assert rows_of(table) == again


def test_upserting_again_gives_the_same_table(spark):
    schema = "week_no int, material_no string, qty int, predicted_at timestamp"
    source = work_path(spark, "in")
    for rows in ([(1, "A", 1)], [(1, "A", 2), (2, "B", 3)]):
        df = spark.createDataFrame(rows, "week_no int, material_no string, qty int")
        df.withColumn("predicted_at", F.to_timestamp(F.concat(F.lit("2026-01-0"), F.col("qty").cast("string")))).coalesce(1).write.mode("append").parquet(source)
    table = KeyedTable(spark, work_path(spark, "keyed"), ["week_no", "material_no"])
    for marks in ("a", "b"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.keyed_stream(stream, table, work_path(spark, marks)).awaitTermination()
        assert rows_of(table) == {(1, "A"): 2, (2, "B"): 3}


def decide(df):
    return scoring.decide_lots(df, F.lit(0.7), F.lit(6.0))


def routed(spark, source, good, bad, marks):
    stream = jobs.read_record_stream(spark, source, INSPECTION_RECORD)
    jobs.route_stream(records.check_inspection(stream), decide, records.VIOLATIONS, good, bad, marks).awaitTermination()


def test_a_new_checkpoint_with_changed_input_loses_nothing(spark):
    good, bad = work_path(spark, "good"), work_path(spark, "bad")
    first, second = work_path(spark, "one"), work_path(spark, "two")
    inspection(spark).union(inspection(spark, inspection_lot="IL-2", inspected_qty=0)).write.json(first)
    changed = inspection(spark, inspection_lot="IL-3").union(inspection(spark, inspection_lot="IL-4", inspected_qty=0)).union(inspection(spark))
    changed.write.json(second)
    routed(spark, first, good, bad, work_path(spark, "marks"))
    # The checkpoint is lost and the folder holds other lots: its first batch is batch 0 again.
    marks = work_path(spark, "marks")
    routed(spark, second, good, bad, marks)
    assert sorted(r.inspection_lot for r in spark.read.parquet(good).collect()) == ["IL-1", "IL-3"]
    assert sorted(r.inspection_lot for r in spark.read.parquet(bad).collect()) == ["IL-2", "IL-4"]
    # The same checkpoint goes on with its next batch.
    inspection(spark, inspection_lot="IL-5").write.mode("append").json(second)
    routed(spark, second, good, bad, marks)
    assert sorted(r.inspection_lot for r in spark.read.parquet(good).collect()) == ["IL-1", "IL-3", "IL-5"]
    assert spark.read.parquet(good).select("run_id").distinct().count() == 2


def test_quantity_model_sees_selected_features_only_and_search_is_refitted(spark):
    rng = random.Random(9)
    data = [(f"k{i}", [rng.random() for _ in range(12)]) for i in range(300)]
    df = spark.createDataFrame(data, "grain_key string, v array<double>").coalesce(2)
    rows = df.select(
        "grain_key", array_to_vector("v").alias("features"), (F.col("v")[0] > 0.5).cast("double").alias("flag"), F.col("v")[1].alias("prob"),
        (F.col("v")[2] * 100 + F.col("v")[1] * 30).alias("qty")).cache()
    model = training.train_three_targets(rows, "flag", "prob", "qty", maxIter=5)
    selector, regressor = model.quantity.stages
    assert len(selector.selectedFeatures) == regressor.numFeatures == training.SELECTED_FEATURES and {1, 2} <= set(selector.selectedFeatures)
    path = work_path(spark, "three")
    model.save(path)
    loaded = training.ThreeTargets.load(path).transform(rows)
    assert loaded.exceptAll(model.transform(rows)).isEmpty() and "selected" not in loaded.columns
    found = training.search_and_refit(rows, "qty", {"maxDepth": [1, 3]}, folds=3, maxIter=5)
    best = found.combinations.where("is_best").first()
    assert best.r2 == found.combinations.agg(F.max("r2")).first()[0] and best.params == f"maxDepth={int(found.best['maxDepth'])}"
    assert {r.settings for r in found.comparison.collect()} == {"best", "published"}
    path = work_path(spark, "search")
    found.save(path)
    assert training.Search.load(spark, path).best == found.best


def test_scrap_models_are_fitted_side_by_side_from_lots_that_are_made_once(spark, monkeypatch):
    both, made, used = threading.Barrier(2), [], []

    def fitted(t, name, settings, fit, content=None):
        assert content == ["content"]
        both.wait(30)
        fit(name)
        return name

    def fit(rows, **overrides):
        used.append(rows)
        return SimpleNamespace(save=lambda path: None)

    monkeypatch.setattr(catalog, "fitted", fitted)
    monkeypatch.setattr(catalog, "tables_content", lambda t: ["content"])
    monkeypatch.setattr(catalog, "scrap_rows", lambda t: made.append(t) or "lots")
    monkeypatch.setattr(catalog.scrap, "encoders_from", lambda t: {})
    monkeypatch.setattr(training, "fit_scrap_risk", fit)
    monkeypatch.setattr(training, "fit_scrap_pct", fit)
    monkeypatch.setattr(training.Trained, "load", lambda spark, path, kind: SimpleNamespace(model=path))
    models = catalog.scrap_models(SimpleNamespace(spark=spark))
    assert (models.risk, models.scrap_pct) == ("scrap-risk", "scrap-pct")
    assert len(made) == 1 and used == ["lots", "lots"]


def test_content_taken_once_gives_the_same_key(spark):
    frames = {"a": spark.range(5).toDF("x"), "b": spark.createDataFrame([(None,), ("y",)], "z string")}
    assert content_key(frames_content(frames), {"rounds": 5}) == content_key(frames, {"rounds": 5})


def test_all_forests_and_folds_run_side_by_side_on_few_rows(spark, monkeypatch):
    seen = []

    def kept(jobs, threads=4):
        seen.append((len(jobs), threads))
        return in_parallel(jobs, threads)

    monkeypatch.setattr(training, "in_parallel", kept)
    rows = [(f"M-{i}", 1, "NORMAL", i % 2, float(i % 7), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "material_no string, week_no int, scenario string, flag int, a double, b double").coalesce(1)
    training.train_shortage(df, ["a", "b"], "flag", numTrees=2, maxDepth=2)
    training.cross_validated_r2(df, ["a", "b"], "a", maxIter=1)
    assert seen == [(6, 8), (5, 8)]


def test_scrap_rows_hold_several_labels(spark):
    rows = [(f"L{i:02d}", f"2026-01-{1 + i % 28:02d}", i % 2, float(i)) for i in range(40)]
    lots = spark.createDataFrame(rows, "inspection_lot string, inspection_date string, target int, scrap_rate_pct double").coalesce(1)
    both = training.scrap_rows(lots, "target", "scrap_rate_pct")
    for label in ("target", "scrap_rate_pct"):
        one = training.scrap_rows(lots, label)
        assert both.select(one.columns).exceptAll(one).isEmpty() and one.count() == 40


def test_side_by_side_fits_share_the_cores_on_few_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 400, 1, 4 * cores)
    few = in_few_partitions(rows, 3)
    assert -(-cores // 3) <= few.rdd.getNumPartitions() <= cores and few.count() == 400
    assert few.agg(F.count_distinct("id")).first()[0] == 400
    # Large partitions stay apart, few ones stay as they are.
    assert in_few_partitions(rows, 3, most=100 // cores).rdd.getNumPartitions() == 4 * cores
    assert in_few_partitions(spark.range(0, 400, 1, 1), 3).rdd.getNumPartitions() == 1
    assert in_few_partitions(spark.range(0, 0, 1, 4 * cores), 3).isEmpty()


def test_a_stored_three_target_model_is_read_without_its_rows(spark, monkeypatch):
    data = [(float(i % 2), float(i), float(i % 5), [float(i * k % 11) for k in range(len(catalog.THREE_TARGET_FEATURES))]) for i in range(60)]
    rows = spark.createDataFrame(data, "flag double, prob double, qty double, v array<double>").select("*", array_to_vector("v").alias("features"))
    root, made = work_path(spark, "three"), []
    monkeypatch.setattr(catalog, "three_target_rows", lambda t: made.append(t) or (rows.coalesce(1), list(catalog.THREE_TARGET_FEATURES)))
    monkeypatch.setattr(catalog, "tables_content", lambda t: [[root]])
    t = SimpleNamespace(spark=spark)
    first = catalog.ml_feature_selection(t).collect()
    assert len(first) == training.SELECTED_FEATURES and len(made) == 1
    assert catalog.ml_feature_selection(t).collect() == first and len(made) == 1
