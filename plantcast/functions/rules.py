"""Business rules on probabilities, gaps and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantcast.functions.columns import number_text, percent_text

# Thresholds, labels and texts of the published rules.
FLAG_THRESHOLD = 0.5
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4
ALERT_ESCALATE, ALERT_WARN = 0.60, 0.40
SEVERITY_HIGH, SEVERITY_MEDIUM = 10.0, 5.0
HIGH_CONFIDENCE = 0.7
ALERT_ACTIONS = {"OK": "Log result only", "WARN": "Notify quality team", "ESCALATE": "Block order + escalate"}
RETRAIN_WEEKS, RETRAIN_AUC = 4, 0.80


def model_flag(probability: Column) -> Column:
    """1 above one half, strictly."""
    return F.when(probability > FLAG_THRESHOLD, 1).otherwise(0)


def shortage_flag(probability: Column, gap: Column) -> Column:
    """A positive gap is always a shortage; otherwise the model decides."""
    return F.when(gap > 0, 1).otherwise(model_flag(probability))


def shortage_reason(probability: Column, gap: Column) -> Column:
    return (
        F.when(gap > 0, F.concat(F.lit("Demand exceeds supply by "), number_text(gap, 1), F.lit(" units")))
        .when(
            model_flag(probability) == 1,
            F.concat(F.lit("ML predicted shortage (probability: "), percent_text(probability, 2), F.lit(")")),
        )
        .otherwise(F.lit("Sufficient supply available"))
    )


def recommended_order(gap: Column) -> Column:
    """Positive part of the gap; an unknown gap orders nothing."""
    return F.greatest(F.lit(0.0), gap)


def risk_level(probability: Column) -> Column:
    return F.when(probability >= RISK_HIGH, "High").when(probability >= RISK_MEDIUM, "Medium").otherwise("Low")


def alert_level(probability: Column) -> Column:
    return (
        F.when(probability >= ALERT_ESCALATE, "ESCALATE").when(probability >= ALERT_WARN, "WARN").otherwise("OK")
    )


def scrap_severity(scrap_pct: Column) -> Column:
    """Colour class of a predicted scrap percentage; null when there is no prediction."""
    return F.when(
        scrap_pct.isNotNull(),
        F.when(scrap_pct >= SEVERITY_HIGH, "HIGH (Red)")
        .when(scrap_pct >= SEVERITY_MEDIUM, "MEDIUM (Yellow)")
        .otherwise("LOW (Green)"),
    )


def alert_action(level: Column) -> Column:
    pairs = [F.lit(text) for pair in ALERT_ACTIONS.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), level)


def model_status(metric: Column, value: Column, target: Column) -> Column:
    """Status text per target: AUC of the classifier, R2 of the probability and quantity models."""
    return (
        F.when((target == "classifier") & (metric == "roc_auc"),
               F.when(value > 0.95, "EXCELLENT").otherwise("NEEDS REVIEW"))
        .when((target == "probability") & (metric == "r2"),
              F.when(value > 0.6, "GOOD").otherwise("NEEDS TUNING"))
        .when((target == "order_qty") & (metric == "r2"),
              F.when(value > 0.5, "GOOD").when(value > 0, "ACCEPTABLE").otherwise("POOR"))
    )
