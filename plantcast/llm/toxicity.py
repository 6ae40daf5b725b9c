"""Severity of toxic language by cumulative-link ordinal regression.

A text's features are the words and word beginnings that it contains, out of a vocabulary that training selects. All
grades share one weight per feature: the chance of at least grade ``k`` is ``logistic(w . x - t_k)`` with rising
thresholds ``t_k``. The expected severity is the sum of these chances over ``k``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import stored, text_batches

FIT_ROWS = 12_000
FEATURES = 4096
LEAST_ROWS = 8
BEGINNINGS = (4, 5, 6)
# Words remembered by one Python worker, none longer than so many bytes.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
# Labelled rows in one partition of the sample.
ROWS_PER_PARTITION = 400
TOXIC_FROM = 0.5
_RUN = re.compile(r"[^\W\d_]+")


def word_features(word: bytes) -> set[str]:
    """Features of one blank-separated word: each run of letters, and its beginnings followed by ``*``."""
    found = set()
    for run in _RUN.findall(word.decode("utf-8", "replace").lower()):
        found.add(run)
        found.update(run[:n] + "*" for n in BEGINNINGS if len(run) >= n)
    return found


@dataclass
class SeverityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    _known: dict[bytes, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "weights": self.weights, "thresholds": self.thresholds, "_known": {}}

    def indices(self, raw: bytes | None) -> list[int]:
        """Distinct features of a text."""
        if not raw:
            return []
        known, out = self._known, set()
        for word in set(raw.split()):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)
                if len(word) <= LONGEST_REMEMBERED:
                    known[word] = ids
            if ids:
                out.update(ids)
        return sorted(out)

    def chances(self, rows: list[list[int]]) -> np.ndarray:
        """Per row, the chance of at least grade 1, 2 and so on."""
        total = np.array([self.weights[r].sum() for r in rows]).reshape(-1, 1)
        return _logistic(total - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, steps: int = 1500, rate: float = 0.05, shrink: float = 2e-6):
    """Weights and thresholds by maximum likelihood with a small ridge, from sparse 0/1 rows."""
    n, top = len(rows), int(grades.max(initial=0)) if len(rows) else 0
    levels = max(top, 1)
    sizes = np.array([len(r) for r in rows], np.int64)
    column = np.fromiter((i for r in rows for i in r), np.int64, sizes.sum())
    row = np.repeat(np.arange(n), sizes)
    weights, gaps = np.zeros(features), np.concatenate([[1.0], np.zeros(levels - 1)])
    moments = [np.zeros(features + levels), np.zeros(features + levels)]
    for step in range(1, steps + 1 if n else 1):
        # The first threshold is free, each further one lies a positive gap above.
        thresholds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        score = np.bincount(row, weights[column], n)
        at_least = np.column_stack([np.ones(n), _logistic(score[:, None] - thresholds), np.zeros(n)])
        slope = at_least * (1 - at_least)
        here = np.arange(n)
        chance = np.maximum(at_least[here, grades] - at_least[here, grades + 1], 1e-12)
        by_score = (slope[here, grades] - slope[here, grades + 1]) / chance
        by_threshold = np.zeros((n, levels + 2))
        by_threshold[here, grades] -= slope[here, grades] / chance
        by_threshold[here, grades + 1] += slope[here, grades + 1] / chance
        tail = by_threshold[:, 1 : levels + 1].mean(axis=0)[::-1].cumsum()[::-1]
        tail[1:] *= np.exp(gaps[1:])
        gradient = np.concatenate([np.bincount(column, by_score[row], features) / n - shrink * weights, tail])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights, gaps = weights + move[:features], gaps + move[features:]
    return weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for toxic, part in pdf.groupby("toxic"):
            counts = Counter()
            for raw in part["text"]:
                features = set()
                for word in set((raw or b"").split()):
                    features |= word_features(word)
                counts.update(features)
            yield pd.DataFrame({"feature": list(counts), "toxic": int(toxic), "n": list(counts.values())})


def fit_severity(labelled: DataFrame, features: int = FEATURES) -> SeverityModel:
    """Model of ``labelled`` (``text``, ``toxic`` 0 or 1), a bounded table.

    The vocabulary holds the features with the largest signed root of the likelihood ratio between toxic and other rows.
    Toxic rows are graded 2 if they hold more strongly toxic features than their median, else 1. Without rows
    of both kinds the model calls nothing toxic.
    """
    rows = stored(labelled.where(F.col("toxic").isin(0, 1)).select(F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return SeverityModel({}, np.zeros(0), np.array([20.0, 21.0]))
    counts = rows.mapInPandas(_class_counts, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    share = F.lit(n1 / (n1 + n0))
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * share
    ratio = 2 * (F.when(a > 0, a * F.log(a / expected)).otherwise(0) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0))
    chosen = counts.where(a + b >= LEAST_ROWS).withColumn("ratio", ratio).where(a > expected).orderBy(F.desc("ratio"), "feature").limit(features)
    table = chosen.toPandas()  # at most ``features`` rows
    table = table[table["ratio"] > 20]
    model = SeverityModel({f: i for i, f in enumerate(table["feature"])}, np.zeros(len(table)), np.array([20.0, 21.0]))
    strong = set(np.flatnonzero(np.log((table["a"] + 0.5) / (n1 + 1)) - np.log((table["b"] + 0.5) / (n0 + 1)) > 2))
    sample = _measure(rows, model)
    toxic = sample["toxic"].to_numpy() == 1
    found = [list(r) for r in sample["features"]]
    hits = np.array([sum(i in strong for i in r) for r in found])
    grades = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0).astype(np.int64)
    model.weights, model.thresholds = fit_ordinal(found, grades, len(table))
    return model


def _measure(rows: DataFrame, model: SeverityModel) -> pd.DataFrame:
    """Label and features of the labelled rows, which are bounded."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "features": [model.indices(raw) for raw in pdf["text"]]})

    return rows.mapInPandas(measure, "toxic int, features array<int>").toPandas()


def severity(text: Column, model: SeverityModel) -> Column:
    """Struct of ``toxic_chance`` (at least grade 1) and ``severity`` (expected grade)."""

    @F.pandas_udf("toxic_chance double, severity double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            chances = model.chances([model.indices(t) for t in texts])
            yield pd.DataFrame({"toxic_chance": chances[:, 0], "severity": chances.sum(axis=1)})

    return of_texts(text.cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``rows`` labelled documents, those whose key has the lowest hash. Repeated labels of
    a key count as toxic if one is; null keys and labels are left out. Of documents with the same key the text with the
    lowest hash counts (ties: the smaller text), so the sample depends on nothing but the rows."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("toxic"))
    picked = stored(known.orderBy(F.xxhash64("_key"), "_key").limit(rows), "label-sample")
    text = F.coalesce(F.col(text), F.lit(""))
    matched = docs.select(F.col(key).alias("_key"), text.alias("text")).join(picked, "_key")
    one = matched.groupBy("_key", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), "text")).alias("_first"))
    return one.select("_key", "toxic", "_first.text").repartition(-(-rows // ROWS_PER_PARTITION), "_key").select("text", "toxic")


def score_toxicity(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxic_chance``, ``severity`` and ``toxic``; existing columns of these names are replaced. Null and blank
    texts have no features; repeated rows get equal scores."""
    text_batches(docs.sparkSession)
    scored = docs.withColumn("_s", severity(F.col(text), model))
    return scored.withColumns(
        {"toxic_chance": F.col("_s.toxic_chance"), "severity": F.col("_s.severity"), "toxic": F.col("_s.toxic_chance") >= TOXIC_FROM}
    ).drop("_s")
