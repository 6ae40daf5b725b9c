"""Training jobs that give MLlib models. Feature frames are checkpointed once, since every fit reads them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.functions.columns import clip
from plantcast.operators.boosting import fit_with_patience, fits_at_once, in_few_partitions, in_parallel
from plantcast.operators.cleaning import complete_cases
from plantcast.operators.metrics import classifier_metrics_frame, importance_frame, regression_metrics
from plantcast.operators.split import hash_folds, random_split, stratified_folds, stratified_split, time_split
from plantcast.operators.trees import BoostedClassifier, BoostedRegressor
from plantcast.session import checkpoint_root
from plantcast.sources.schemas import FORECAST_FEATURES, KEYS, SCRAP_FEATURES, SHORTAGE_FEATURES

# Settings of the published models.
FORECAST_MODEL = {"maxIter": 200, "stepSize": 0.08, "maxDepth": 4, "subsamplingRate": 0.85, "minInstancesPerNode": 3}
SHORTAGE_MODEL = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 2}
SCRAP_RISK_MODEL = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
SCRAP_PCT_MODEL = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
THREE_TARGET_MODEL = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 3, "subsamplingRate": 0.8}
POSITIVE_WEIGHT = 2.0
# Rounds without gain after which the scrap models stop.
PATIENCE = 20
# Features in front of the quantity model of the three-target variant.
SELECTED_FEATURES = 8
SEED = 42
MAX_BINS = 128
FOLDS = 5

ROW_KEY = "grain_key"


def feature_vector(features: Sequence[str], columns: Sequence[str] | None = None) -> Column:
    """Features in order as one vector; null counts as 0, and so does a feature missing from ``columns``."""
    values = [
        F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if columns is None or f in columns else F.lit(0.0)
        for f in features
    ]
    return array_to_vector(F.array(*values))


def grain_key() -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS])


def model_rows(df: DataFrame, features: Sequence[str], label: str, keep: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Complete rows as (kept columns, label, vector), cut from their lineage."""
    checkpoint_root(df.sparkSession)
    kept = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (keep or {}).items()]
    complete = complete_cases(df, [*features, label])
    rows = complete.select(*kept, F.col(label).cast("double").alias("label"), feature_vector(features).alias("features"))
    return rows.checkpoint()


def class_sizes(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """Rows of class 1 and of the others: one aggregate row."""
    positive, total = df.agg(F.count_if(F.col(label) == 1), F.count(F.lit(1))).first()
    return positive, total - positive


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 n_class), so both classes count the same."""
    positive, negative = class_sizes(df, label)
    total = positive + negative
    return df.withColumn(
        "weight",
        F.when(F.col(label) == 1, F.lit(total / (2 * max(positive, 1)))).otherwise(F.lit(total / (2 * max(negative, 1)))),
    )


@dataclass
class Trained:
    """A fitted model with its hold-out metrics (one row), feature importances and number of boosting rounds kept."""

    model: object
    metrics: DataFrame
    importances: DataFrame
    rounds: int | None = None

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.metrics.withColumn("rounds_kept", F.lit(self.rounds).cast("int")).coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
        self.importances.coalesce(1).write.mode("overwrite").parquet(f"{path}/importances")

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: type) -> "Trained":
        metrics = spark.read.parquet(f"{path}/metrics")
        return cls(kind.load(f"{path}/model"), metrics.drop("rounds_kept"), spark.read.parquet(f"{path}/importances"), metrics.first().rounds_kept)


def _importances(spark: SparkSession, features: Sequence[str], model) -> DataFrame:
    return importance_frame(spark, features, model.featureImportances.toArray())


def positive_probability() -> Column:
    return vector_to_array(F.col("probability"))[1]


def train_forecast(df: DataFrame, features: Sequence[str] = FORECAST_FEATURES, label: str = "forecast_qty", **overrides) -> Trained:
    """Quantity regressor on a random 80/20 split."""
    rows = random_split(model_rows(df, features, label, {ROW_KEY: grain_key()}), ROW_KEY, seed=SEED)
    learner = BoostedRegressor(seed=SEED, maxBins=MAX_BINS, **{**FORECAST_MODEL, **overrides})
    model = learner.fit(rows.where("is_train"))
    scored = model.transform(rows.where("NOT is_train"))
    return Trained(model, regression_metrics(scored, "label", "prediction"), _importances(df.sparkSession, features, model), model.getNumTrees)


def cross_validated_r2(df: DataFrame, features: Sequence[str] = FORECAST_FEATURES, label: str = "forecast_qty", folds: int = FOLDS, **overrides) -> DataFrame:
    """R2 of every fold; the folds are fitted side by side."""
    rows = hash_folds(model_rows(df, features, label, {ROW_KEY: grain_key()}), ROW_KEY, folds, SEED)

    def score(fold: int) -> tuple[int, float]:
        learner = BoostedRegressor(seed=SEED, maxBins=MAX_BINS, **{**FORECAST_MODEL, **overrides})
        model = learner.fit(rows.where(F.col("fold") != fold))
        scored = model.transform(rows.where(F.col("fold") == fold))
        return fold, regression_metrics(scored, "label", "prediction").first().r2

    # One number per fold.
    found = in_parallel([lambda fold=fold: score(fold) for fold in range(folds)], fits_at_once(rows))
    return df.sparkSession.createDataFrame(found, "fold int, r2 double")


def summarise_folds(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"))


def fit_sigmoid(scored: DataFrame, score: str, label: str = "label") -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (score, label) with smoothed targets.

    A smoothed target t is a positive copy of the row with weight t and a negative one with 1 - t.
    """
    positive, negative = class_sizes(scored, label)
    high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    copies = F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))
    )
    pairs = scored.select(array_to_vector(F.array(F.col(score))).alias("x"), F.explode(copies).alias("c"))
    learner = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, standardization=False, maxIter=200, tol=1e-9
    )
    fitted = learner.fit(pairs.select("x", "c.y", "c.w"))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def sigmoid(score: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * score + F.lit(intercept))))


@dataclass
class CalibratedForest:
    """Forests fitted on all folds but one, each with a sigmoid from the fold it did not see."""

    members: list[tuple[RandomForestClassificationModel, float, float]] = field(default_factory=list)

    def transform(self, df: DataFrame, out: str = "calibrated") -> DataFrame:
        """Mean of the calibrated probabilities; expects a ``features`` column."""
        total = F.lit(0.0)
        for i, (forest, slope, intercept) in enumerate(self.members):
            scored = forest.transform(df)
            df = scored.withColumn(f"_raw_{i}", positive_probability()).drop("rawPrediction", "probability", "prediction")
            total = total + sigmoid(F.col(f"_raw_{i}"), slope, intercept)
        mean = clip(total / len(self.members), 0.0, 1.0)
        return df.withColumn(out, mean).drop(*[f"_raw_{i}" for i in range(len(self.members))])

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (forest, _, _) in enumerate(self.members):
            forest.write().overwrite().save(f"{path}/forest_{i}")
        curves = [(i, slope, intercept) for i, (_, slope, intercept) in enumerate(self.members)]
        spark.createDataFrame(curves, "member int, slope double, intercept double").write.mode("overwrite").parquet(f"{path}/curves")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CalibratedForest":
        curves = spark.read.parquet(f"{path}/curves").orderBy("member").collect()
        return cls([
            (RandomForestClassificationModel.load(f"{path}/forest_{c.member}"), c.slope, c.intercept) for c in curves
        ])


def _forest_members(rows: DataFrame, folds: int, **overrides) -> list[Callable[[], tuple]]:
    """One job per fold: the forest of the other folds and the sigmoid of this one."""
    folded = stratified_folds(rows, ROW_KEY, "label", folds, SEED).checkpoint()

    def member(fold: int) -> tuple[RandomForestClassificationModel, float, float]:
        learner = RandomForestClassifier(seed=SEED, maxBins=MAX_BINS, weightCol="weight", **{**SHORTAGE_MODEL, **overrides})
        forest = learner.fit(class_weights(folded.where(F.col("fold") != fold)))
        held = forest.transform(folded.where(F.col("fold") == fold)).withColumn("_raw", positive_probability())
        return forest, *fit_sigmoid(held, "_raw")

    return [lambda fold=fold: member(fold) for fold in range(folds)]


def fit_calibrated_forest(rows: DataFrame, folds: int = FOLDS, **overrides) -> CalibratedForest:
    """``rows`` has a unique row key, a label and a feature vector."""
    return CalibratedForest(in_parallel(_forest_members(rows, folds, **overrides), fits_at_once(rows)))


def train_shortage(df: DataFrame, features: Sequence[str] = SHORTAGE_FEATURES, label: str = "shortage_flag", **overrides) -> tuple[Trained, CalibratedForest, DataFrame]:
    """Balanced forest and its calibrated ensemble on a stratified split, all forests fitted side by side.

    Returns the plain forest, the ensemble, and the ensemble's hold-out metrics.
    """
    complete = model_rows(df, features, label, {ROW_KEY: grain_key()})
    rows = stratified_split(complete, ROW_KEY, "label", seed=SEED)
    train, test = rows.where("is_train").drop("is_train"), rows.where("NOT is_train")
    learner = RandomForestClassifier(seed=SEED, maxBins=MAX_BINS, weightCol="weight", **{**SHORTAGE_MODEL, **overrides})
    jobs = [lambda: learner.fit(class_weights(train)), *_forest_members(train, FOLDS, **overrides)]
    plain, *members = in_parallel(jobs, fits_at_once(complete))
    plain_scored = plain.transform(test).withColumn("score", positive_probability())
    base = Trained(plain, classifier_metrics_frame(plain_scored, "label", "prediction", "score"), _importances(df.sparkSession, features, plain))
    ensemble = CalibratedForest(members)
    calibrated = ensemble.transform(test).withColumn("chosen", (F.col("calibrated") > 0.5).cast("double"))
    return base, ensemble, classifier_metrics_frame(calibrated, "label", "chosen", "calibrated")


def scrap_rows(df: DataFrame, *labels: str) -> DataFrame:
    """Lots as model rows with the time split and a validation mark, for one label or several. Validation rows are a tenth of
    the training part, so the hold-out stays unseen."""
    checkpoint_root(df.sparkSession)
    rows = df.select(
        "inspection_lot", "inspection_date", *[F.col(label).cast("double").alias(label) for label in labels],
        feature_vector(SCRAP_FEATURES, df.columns).alias("features"),
    ).checkpoint()
    split = time_split(rows, "inspection_date", "inspection_lot")
    tenth = hash_folds(split, "inspection_lot", 10, SEED, "_tenth")
    return tenth.withColumn("is_validation", F.col("_tenth") == 0).drop("_tenth")


def _one_label(rows: DataFrame, label: str) -> DataFrame:
    return rows.select("inspection_lot", F.col(label).alias("label"), "features", "is_train", "is_validation")


def _fit_scrap(learner, rows: DataFrame, patience: int):
    train = rows.where("is_train")
    return fit_with_patience(learner, train.where("NOT is_validation"), train.where("is_validation"), patience)


def train_scrap_risk(df: DataFrame, label: str = "target", patience: int = PATIENCE, **overrides) -> Trained:
    """Boosted risk classifier; positives weigh double. Rounds after the best one on the validation rows are dropped."""
    return fit_scrap_risk(scrap_rows(df, label), label, patience, **overrides)


def fit_scrap_risk(rows: DataFrame, label: str = "target", patience: int = PATIENCE, **overrides) -> Trained:
    """The same from rows of ``scrap_rows``."""
    rows = _one_label(rows, label).withColumn("weight", F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(1.0))
    learner = BoostedClassifier(seed=SEED, maxBins=MAX_BINS, weightCol="weight", **{**SCRAP_RISK_MODEL, **overrides})
    model, kept = _fit_scrap(learner, rows, patience)
    scored = model.transform(rows.where("NOT is_train")).withColumn("score", positive_probability())
    return Trained(model, classifier_metrics_frame(scored, "label", "prediction", "score"), _importances(rows.sparkSession, SCRAP_FEATURES, model), kept)


def train_scrap_pct(df: DataFrame, label: str = "scrap_rate_pct", patience: int = PATIENCE, **overrides) -> Trained:
    """Boosted scrap-percentage regressor on the same split, with the same rule."""
    return fit_scrap_pct(scrap_rows(df, label), label, patience, **overrides)


def fit_scrap_pct(rows: DataFrame, label: str = "scrap_rate_pct", patience: int = PATIENCE, **overrides) -> Trained:
    """The same from rows of ``scrap_rows``."""
    rows = _one_label(rows, label)
    learner = BoostedRegressor(seed=SEED, maxBins=MAX_BINS, **{**SCRAP_PCT_MODEL, **overrides})
    model, kept = _fit_scrap(learner, rows, patience)
    scored = model.transform(rows.where("NOT is_train"))
    return Trained(model, regression_metrics(scored, "label", "prediction"), _importances(rows.sparkSession, SCRAP_FEATURES, model), kept)


@dataclass
class ThreeTargets:
    """Flag classifier, probability regressor and order-quantity regressor over one feature vector. The quantity model is a
    pipeline: a selector keeps the strongest features of its target, the regressor sees only these."""

    flag: GBTClassificationModel
    probability: GBTRegressionModel
    quantity: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Prediction columns; expects ``features``."""
        spare = ("rawPrediction", "probability", "prediction")
        df = self.flag.transform(df).withColumns(
            {"pred_shortage_flag": F.col("prediction").cast("int"), "pred_shortage_confidence": positive_probability()}
        ).drop(*spare)
        df = self.probability.transform(df).withColumn("pred_shortage_prob", clip(F.col("prediction"), 0.0, 1.0)).drop(*spare)
        return self.quantity.transform(df).withColumn("pred_order_qty", clip(F.col("prediction"), 0.0).cast("int")).drop(*spare, "selected")

    def save(self, path: str) -> None:
        for name in ("flag", "probability", "quantity"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> "ThreeTargets":
        return cls(GBTClassificationModel.load(f"{path}/flag"), GBTRegressionModel.load(f"{path}/probability"), PipelineModel.load(f"{path}/quantity"))


def train_three_targets(rows: DataFrame, flag: str, probability: str, quantity: str, **overrides) -> ThreeTargets:
    """``rows`` has ``features`` and the three targets. The models are fitted side by side."""
    settings = {**THREE_TARGET_MODEL, **overrides}
    common = {"seed": SEED, "maxBins": MAX_BINS, **settings}
    selected = Pipeline(stages=[
        feature_selector(quantity, SELECTED_FEATURES), BoostedRegressor(labelCol=quantity, featuresCol="selected", **common),
    ])
    learners = [BoostedClassifier(labelCol=flag, **common), BoostedRegressor(labelCol=probability, **common), selected]
    rows = in_few_partitions(rows, len(learners))
    return ThreeTargets(*in_parallel([lambda learner=learner: learner.fit(rows) for learner in learners]))


def feature_selector(label: str, count: int) -> UnivariateFeatureSelector:
    """Univariate selector that keeps the ``count`` strongest features of a numeric target."""
    selector = UnivariateFeatureSelector(featuresCol="features", outputCol="selected", labelCol=label, selectionMode="numTopFeatures")
    return selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(count)


def select_features(rows: DataFrame, label: str, count: int):
    return feature_selector(label, count).fit(rows)


@dataclass
class Search:
    """Cross-validated R2 of every parameter combination, the best combination, and hold-out metrics of a model refitted
    with it beside those of a model with the settings that the search started from."""

    combinations: DataFrame
    best: dict[str, float]
    comparison: DataFrame
    model: GBTRegressionModel

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.combinations.coalesce(1).write.mode("overwrite").parquet(f"{path}/combinations")
        self.comparison.coalesce(1).write.mode("overwrite").parquet(f"{path}/comparison")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Search":
        combinations = spark.read.parquet(f"{path}/combinations")
        best = dict(p.split("=") for p in combinations.where("is_best").first().params.split(", "))
        return cls(combinations, {k: float(v) for k, v in best.items()}, spark.read.parquet(f"{path}/comparison"), GBTRegressionModel.load(f"{path}/model"))


def _cross_validate(rows: DataFrame, label: str, grid: Mapping[str, Sequence[float]], folds: int, settings: Mapping) -> tuple[DataFrame, dict[str, float], GBTRegressionModel]:
    """Table of the combinations, the best one, and the model that the search refits with it on all ``rows``."""
    learner = BoostedRegressor(labelCol=label, seed=SEED, maxBins=MAX_BINS, **settings)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(learner.getParam(name), list(values))
    combos = builder.build()
    folded = hash_folds(rows, ROW_KEY, folds, SEED)
    evaluator = RegressionEvaluator(labelCol=label, metricName="r2")

    def score(fold: int, combo: dict) -> float:
        model = learner.fit(folded.where(F.col("fold") != fold), combo)
        return evaluator.evaluate(model.transform(folded.where(F.col("fold") == fold)))

    # One number per fold and combination; all are independent.
    jobs = [lambda fold=fold, combo=combo: score(fold, combo) for fold in range(folds) for combo in combos]
    found = in_parallel(jobs, fits_at_once(rows))
    means = [sum(found[i :: len(combos)]) / folds for i in range(len(combos))]
    best = max(range(len(combos)), key=lambda i: means[i])
    table = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(c.items(), key=lambda kv: kv[0].name)), means[i], i == best)
        for i, c in enumerate(combos)
    ]
    frame = rows.sparkSession.createDataFrame(table, "combination int, params string, r2 double, is_best boolean")
    return frame, {p.name: float(v) for p, v in combos[best].items()}, learner.fit(rows, combos[best])


def search_parameters(rows: DataFrame, label: str, grid: Mapping[str, Sequence[float]], folds: int = 3, **fixed) -> DataFrame:
    """Cross-validated R2 of every parameter combination; the best one is marked."""
    return _cross_validate(rows, label, grid, folds, fixed)[0]


def search_and_refit(rows: DataFrame, label: str, grid: Mapping[str, Sequence[float]], folds: int = 3, **overrides) -> Search:
    """Searches on four fifths of the rows from the published settings on, refits there with the best combination and scores
    it on the rest, beside a model with the published settings."""
    settings = {**THREE_TARGET_MODEL, **overrides}
    split = random_split(rows, ROW_KEY, seed=SEED)
    train, test = split.where("is_train").drop("is_train").checkpoint(), split.where("NOT is_train")
    learner = BoostedRegressor(labelCol=label, seed=SEED, maxBins=MAX_BINS, **settings)
    (combinations, best, model), published = in_parallel([
        lambda: _cross_validate(train, label, grid, folds, settings), lambda: learner.fit(train),
    ])
    scores = [
        regression_metrics(m.transform(test), label, "prediction").select(F.lit(name).alias("settings"), "*")
        for name, m in (("best", model), ("published", published))
    ]
    return Search(combinations, best, scores[0].unionByName(scores[1]), model)
