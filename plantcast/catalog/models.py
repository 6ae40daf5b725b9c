"""Queries: model training and scoring on the whole feature tables, with the published settings.

Models are fitted once per content of the input tables and settings, and taken from the model store by every query that
needs them. Where a result is fixed by the rules whatever the trees learn (row counts, ranges, the gap override), SQL
checks it.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.catalog.registry import query
from plantcast.catalog.views import with_views
from plantcast.functions.features import demand_features
from plantcast.operators.boosting import in_parallel
from plantcast.operators.cleaning import median_imputer
from plantcast.operators.encode import apply_encoder
from plantcast.operators.metrics import stack_metrics
from plantcast.plans import demand, reports, scoring, scrap, training
from plantcast.plans.store import ModelStore, content_key, frames_content
from plantcast.session import work_path
from plantcast.sources.keyed_table import KeyedTable
from plantcast.sources.schemas import KEYS

# Input tables that the planning tables are views of.
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# Settings that replace published ones, by kind of model ("boosted", "forest"); tests make models small here.
OVERRIDES: dict[str, dict] = {}
# Part of every model's key; raised when training changes without a change of settings.
TRAINING_VERSION = 1
SEARCH_GRID = {"maxDepth": [2, 3], "stepSize": [0.05, 0.1]}
SEARCH_FOLDS = 3


def tables_content(t) -> list[list]:
    """Content of the input tables; a query that needs several models takes it once."""
    return frames_content({n: t.raw(n) for n in SOURCES})


def made_once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``make`` as a function that runs when first called; callers side by side get the same frame."""
    lock, made = Lock(), []

    def get() -> DataFrame:
        with lock:
            if not made:
                made.append(make())
            return made[0]

    return get


def fitted(t, name: str, settings: dict, fit: Callable[[str], None], content: list[list] | None = None) -> str:
    """Folder of a model in the store, fitted if these tables and settings have none yet."""
    training.checkpoint_root(t.spark)
    key = content_key(content or tables_content(t), {**settings, "overrides": OVERRIDES, "version": TRAINING_VERSION})
    return ModelStore(t.spark).folder(name, key, fit)


def boosted() -> dict:
    return OVERRIDES.get("boosted", {})


# Scrap lots cover few weeks of the benchmark data; requiring them would leave almost no complete demand row.
def demand_training(t):
    """Encoded demand features with unmatched facts as zero, ready to train on."""
    joined = demand.star_from(t)
    coded = demand.encode_demand(demand_features(joined), demand.demand_encoders(t.demand_forecast()))
    facts = ["avg_defect_rate", "avg_scrap_rate", "avg_scrap_risk", "total_scrap_cost"]
    return coded.na.fill(0, subset=facts)


def scrap_training(t):
    return scrap.encode_lots(scrap.enriched_from(t), scrap.encoders_from(t), unknown=-1)


def forecast_model(t, content: list[list] | None = None, rows: Callable[[], DataFrame] | None = None) -> training.Trained:
    rows = rows or (lambda: demand_training(t))
    path = fitted(t, "forecast", training.FORECAST_MODEL, lambda path: training.train_forecast(rows(), **boosted()).save(path), content)
    return training.Trained.load(t.spark, path, GBTRegressionModel)


def shortage_models(
    t, content: list[list] | None = None, rows: Callable[[], DataFrame] | None = None
) -> tuple[training.Trained, training.CalibratedForest, DataFrame]:
    """Plain forest, calibrated forests, and the hold-out metrics of these."""
    rows = rows or (lambda: demand_training(t))

    def fit(path: str) -> None:
        base, ensemble, metrics = training.train_shortage(rows(), **OVERRIDES.get("forest", {}))
        base.save(f"{path}/base")
        ensemble.save(t.spark, f"{path}/ensemble")
        metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/calibrated")

    path = fitted(t, "shortage", training.SHORTAGE_MODEL, fit, content)
    base = training.Trained.load(t.spark, f"{path}/base", RandomForestClassificationModel)
    return base, training.CalibratedForest.load(t.spark, f"{path}/ensemble"), t.spark.read.parquet(f"{path}/calibrated")


def demand_models(t) -> scoring.DemandModels:
    """Both models; those that the store lacks are fitted side by side."""
    content, rows = tables_content(t), made_once(lambda: demand_training(t))
    forecast, shortage = in_parallel([lambda: forecast_model(t, content, rows), lambda: shortage_models(t, content, rows)])
    return scoring.DemandModels(forecast.model, shortage[1], demand.demand_encoders(t.demand_forecast()))


def scrap_rows(t) -> DataFrame:
    return training.scrap_rows(scrap_training(t), "target", "scrap_rate_pct")


def scrap_risk_model(t, content: list[list] | None = None, rows: Callable[[], DataFrame] | None = None) -> training.Trained:
    rows = rows or (lambda: scrap_rows(t))
    settings = {**training.SCRAP_RISK_MODEL, "patience": training.PATIENCE}
    path = fitted(t, "scrap-risk", settings, lambda path: training.fit_scrap_risk(rows(), **boosted()).save(path), content)
    return training.Trained.load(t.spark, path, GBTClassificationModel)


def scrap_pct_model(t, content: list[list] | None = None, rows: Callable[[], DataFrame] | None = None) -> training.Trained:
    rows = rows or (lambda: scrap_rows(t))
    settings = {**training.SCRAP_PCT_MODEL, "patience": training.PATIENCE}
    path = fitted(t, "scrap-pct", settings, lambda path: training.fit_scrap_pct(rows(), **boosted()).save(path), content)
    return training.Trained.load(t.spark, path, GBTRegressionModel)


def scrap_models(t) -> scoring.ScrapModels:
    """Both models; those that the store lacks are fitted side by side, from lots that are prepared once."""
    content, rows = tables_content(t), made_once(lambda: scrap_rows(t))
    risk, pct = in_parallel([lambda: scrap_risk_model(t, content, rows), lambda: scrap_pct_model(t, content, rows)])
    return scoring.ScrapModels(risk.model, pct.model, scrap.encoders_from(t))


@query("ml_train_forecast")
def ml_train_forecast(t):
    """Hold-out metrics of the quantity regressor."""
    return stack_metrics({"model_order_qty_forecast": forecast_model(t).metrics})


@query("ml_cross_validation")
def ml_cross_validation(t):
    """Mean and population deviation of R2 over five folds."""

    def fit(path: str) -> None:
        training.cross_validated_r2(demand_training(t), **boosted()).coalesce(1).write.mode("overwrite").parquet(path)

    path = fitted(t, "forecast-folds", {**training.FORECAST_MODEL, "folds": training.FOLDS}, fit)
    return training.summarise_folds(t.spark.read.parquet(path))


@query("ml_train_shortage")
def ml_train_shortage(t):
    """Hold-out metrics of the balanced forest before and after calibration."""
    base, _, calibrated = shortage_models(t)
    return stack_metrics({"forest": base.metrics, "model_shortage_unified": calibrated})


@query("ml_forecast_importance")
def ml_forecast_importance(t):
    """Ten most important features of the quantity regressor."""
    return forecast_model(t).importances.orderBy(F.desc("importance"), "feature").limit(10)


def _with_rounds(trained: training.Trained) -> DataFrame:
    return trained.metrics.withColumn("rounds_kept", F.lit(trained.rounds).cast("double"))


@query("ml_train_scrap_risk")
def ml_train_scrap_risk(t):
    """Hold-out metrics and the rounds that early stopping kept."""
    return stack_metrics({"scrap_risk": _with_rounds(scrap_risk_model(t))})


@query("ml_train_scrap_pct")
def ml_train_scrap_pct(t):
    return stack_metrics({"scrap_pct": _with_rounds(scrap_pct_model(t))})


def banded(value: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    """Name of the first band whose bound the value reaches."""
    out = F.lit(lowest)
    for bound, name in reversed(bands):
        out = F.when(value >= bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


@query("ml_score_demand", with_views("""
  SELECT week_no, material_no, scenario, demand_gap, CASE WHEN demand_gap > 0 THEN demand_gap ELSE 0e0 END AS recommended_order_qty,
    CASE WHEN demand_gap > 0 THEN 1 END AS forced_flag, true AS in_range, true AS risk_fits, true AS reason_fits
  FROM features WHERE stock_level IS NOT NULL""", "features"))
def ml_score_demand(t):
    """The stored models applied to all records: what the rules fix must hold for every row. Levels are worked out again from
    the unrounded probability; a missing value on either side is a difference."""
    models, records = demand_models(t), demand_training(t).drop("material_encoded", "scenario_encoded")
    inputs = models.transform(scoring.demand_inputs(records, models.encoders))
    raw = inputs.select(*KEYS, F.col("model_probability").alias("p"), F.col("demand_gap").alias("raw_gap"))
    scored = scoring.decide_demand(inputs, F.col("model_forecast"), F.col("model_probability")).join(raw, list(KEYS))
    p, gap = F.col("p"), F.col("raw_gap")
    reason = (
        F.when(gap > 0, F.lit("Demand exceeds")).when(p > 0.5, F.lit("ML predicted")).otherwise(F.lit("Sufficient supply"))
    )
    fits = F.coalesce(F.col("reason").startswith(reason), F.lit(False))
    level = banded(p, [(0.7, "High"), (0.4, "Medium")], "Low")
    in_range = F.coalesce((p >= 0) & (p <= 1) & (F.col("ml_forecast_qty") >= 0), F.lit(False))
    return scored.select(
        *KEYS, "demand_gap", "recommended_order_qty", F.when(gap > 0, F.col("ml_shortage_flag")).alias("forced_flag"),
        in_range.alias("in_range"), F.col("risk_level").eqNullSafe(level).alias("risk_fits"), fits.alias("reason_fits"))


def lots_to_score(t) -> DataFrame:
    return scrap.enriched_from(t).withColumn("inspection_date", F.col("inspection_date").cast("string"))


@query("ml_score_lots", with_views("""
  SELECT inspection_lot, machine_id, shift, true AS in_range, true AS alert_fits, true AS severity_fits FROM lot_features
  WHERE scrap_cost_eur IS NOT NULL AND supplier_name IS NOT NULL AND material_group IS NOT NULL AND defect_rate_pct <= 100""", "lot_features"))
def ml_score_lots(t):
    """Lots that pass the checks, scored by both stored scrap models; levels are worked out again from unrounded scores."""
    models = scrap_models(t)
    inputs = models.transform(scoring.lot_inputs(lots_to_score(t), models.encoders))
    raw = inputs.select("inspection_lot", F.col("model_risk").alias("p"), F.col("model_scrap_pct").alias("pct"))
    scored = scoring.decide_lots(inputs, F.col("model_risk"), F.col("model_scrap_pct")).join(raw, "inspection_lot")
    alert = banded(F.col("p"), [(0.6, "ESCALATE"), (0.4, "WARN")], "OK")
    severity = banded(F.col("pct"), [(10, "HIGH (Red)"), (5, "MEDIUM (Yellow)")], "LOW (Green)")
    in_range = F.coalesce(F.col("p").between(0, 1) & F.col("pct").isNotNull(), F.lit(False))
    return scored.select(
        "inspection_lot", "machine_id", "shift", in_range.alias("in_range"), F.col("alert_level").eqNullSafe(alert).alias("alert_fits"),
        F.col("scrap_severity").eqNullSafe(severity).alias("severity_fits"))


@query("ml_combined_inference")
def ml_combined_inference(t):
    """Both scrap models over all feature rows."""
    return scoring.combined_inference(scrap_training(t), scrap_models(t))


@query("src_keyed_predictions", with_views("""
  SELECT week_no, material_no, scenario, demand_gap, recommended_order_qty, CASE WHEN week_no % 2 = 0 THEN 2 ELSE 1 END AS run, true AS dated FROM (
    SELECT week_no, material_no, scenario, demand_gap, CASE WHEN demand_gap > 0 THEN demand_gap ELSE 0e0 END AS recommended_order_qty
    FROM features WHERE stock_level IS NOT NULL)""", "features"))
def src_keyed_predictions(t):
    """Scores of the stored models upserted twice: all weeks, then the even ones; the later run counts there."""
    records = demand_training(t).drop("material_encoded", "scenario_encoded")
    scored = scoring.score_demand(records, demand_models(t)).select(*KEYS, "demand_gap", "recommended_order_qty", "risk_level")
    table = KeyedTable(t.spark, work_path(t.spark, "keyed"), KEYS)
    for run, rows in ((1, scored), (2, scored.where("week_no % 2 = 0"))):
        table.upsert(rows.withColumn("run", F.lit(run)))
    return table.read().select(*KEYS, "demand_gap", "recommended_order_qty", "run", F.col("predicted_at").isNotNull().alias("dated"))


THREE_TARGET_FEATURES = (
    "scenario_encoded", "stock_level", "stock_roll3", "demand_roll3", "demand_vs_batch", "stock_buffer_ratio", "stock_vs_safety",
    "otif_gap", "lead_time_risk", "scrap_adj_demand", "stock_level_lag1", "stock_level_lag2", "shortage_prob_lag1",
    "is_peak_season", "quarter", "week_no",
)


def three_target_rows(t):
    """Feature rows of the three-target variant: planning features, medians for unknowns, known targets."""
    joined = demand.star_join(
        t.demand_forecast(), t.material_replenishment(), scrap=t.scrap_quality(), customers=t.customer_orders(),
        materials=t.material_master(), suppliers=t.supplier_master())
    df = demand.planning_features(joined)
    df = apply_encoder(df, demand.demand_encoders(t.demand_forecast())["scenario"], "scenario", "scenario_encoded")
    features = list(THREE_TARGET_FEATURES)
    uncertain = [c for c in features if c not in ("scenario_encoded", "is_peak_season", "quarter", "week_no")]
    known = df.where(F.col("shortage_flag").isNotNull())
    medians = {c: f"{c}_filled" for c in uncertain}
    doubles = known.withColumns({filled: F.col(c).cast("double") for c, filled in medians.items()})
    imputed = median_imputer(list(medians.values())).fit(doubles).transform(doubles)
    vector = [medians.get(c, c) for c in features]
    rows = imputed.select(
        training.grain_key().alias(training.ROW_KEY), "week_no", "material_no", F.col("shortage_flag").cast("double").alias("flag"),
        F.col("shortage_probability_replen").alias("prob"), F.col("replenishment_order_qty").cast("double").alias("qty"),
        "shortage_flag", F.col("shortage_probability_replen").alias("shortage_probability"), "replenishment_order_qty", "stock_level",
        "reorder_point", "supplier_otif_pct", training.feature_vector(vector).alias("features"))
    training.checkpoint_root(t.spark)
    return rows.checkpoint(), features


TARGETS = ("flag", "prob", "qty")


def three_target_model(t, content: list[list] | None = None, rows: Callable[[], DataFrame] | None = None) -> training.ThreeTargets:
    """The model; feature rows are made only if the store lacks it."""
    rows = rows or (lambda: three_target_rows(t)[0])
    settings = {**training.THREE_TARGET_MODEL, "selected": training.SELECTED_FEATURES}
    path = fitted(t, "three-targets", settings, lambda path: training.train_three_targets(rows(), *TARGETS, **boosted()).save(path), content)
    return training.ThreeTargets.load(path)


@query("ml_three_targets", with_views("""
  SELECT week_no, material_no, shortage_flag AS actual_shortage_flag, shortage_probability AS actual_shortage_prob,
    replenishment_order_qty AS actual_order_qty, true AS in_range FROM material_replenishment SEMI JOIN demand_forecast USING (week_no, material_no)""",
    "material_replenishment", "demand_forecast"))
def ml_three_targets(t):
    """Flag, probability and order quantity of every row with stock data, next to the actuals."""
    rows = made_once(lambda: three_target_rows(t)[0])
    content, _ = in_parallel([lambda: tables_content(t), rows])
    out = reports.prediction_frame(three_target_model(t, content, rows).transform(rows()))
    in_range = F.col("pred_shortage_prob").between(0, 1) & F.col("pred_shortage_confidence").between(0, 1) & (F.col("pred_order_qty") >= 0)
    return out.select(
        "week_no", "material_no", "actual_shortage_flag", "actual_shortage_prob", "actual_order_qty", F.coalesce(in_range, F.lit(False)).alias("in_range"))


@query("ml_feature_selection")
def ml_feature_selection(t):
    """The features that the selector in front of the stored quantity model keeps."""
    model = three_target_model(t)
    return t.spark.createDataFrame([(i, THREE_TARGET_FEATURES[i]) for i in model.quantity.stages[0].selectedFeatures], "position int, feature string")


def parameter_search(t) -> training.Search:
    settings = {**training.THREE_TARGET_MODEL, "grid": SEARCH_GRID, "folds": SEARCH_FOLDS}

    def fit(path: str) -> None:
        rows, _ = three_target_rows(t)
        training.search_and_refit(rows, "qty", SEARCH_GRID, SEARCH_FOLDS, **boosted()).save(path)

    return training.Search.load(t.spark, fitted(t, "search", settings, fit))


@query("ml_parameter_search")
def ml_parameter_search(t):
    """Cross-validated R2 per combination of depth and step size."""
    return parameter_search(t).combinations


@query("ml_best_parameters")
def ml_best_parameters(t):
    """Hold-out metrics of the model refitted with the best combination, beside the published settings."""
    return parameter_search(t).comparison
