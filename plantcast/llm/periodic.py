"""Periodic runs of words: stretches that repeat one period at least three times.

A run is a stretch of at least ``max(LEAST, 3 * period)`` words in which words one (smallest) period apart are equal and
which no neighbouring word extends. A word occurs in it at least three times, so words that occur less often within a
segment belong to no run of that segment and split it; the parts are counted again until no word splits. The surviving
segments are scanned for lags. A window of ``w`` words that stands in a run of period ``q <= w`` stands ``q`` words
earlier too and nowhere between, else the period would not be the smallest. Stretches of one lag between equal windows
are therefore the runs with periods in ``(w/2, w]``, and windows of 8, 16, 32 ... words find all of them without trying
each lag on each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import text_batches

LEAST = 24
REPEATS = 3
# Splits nested deeper than this stop, so that no text is counted more often; the scan is exact on any segment.
DEPTH = 64
_FIRST_WINDOW = LEAST // REPEATS


def split_by_frequency(words: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Segments of at least ``LEAST`` word numbers in which every word occurs ``REPEATS`` times or more."""
    stable, todo = [], [(0, len(words), 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start < LEAST:
            continue
        _, place, counts = np.unique(words[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[place] < REPEATS)
        if not len(rare) or level == depth:
            stable.append((start, end))
            continue
        cuts = np.concatenate(([-1], rare, [end - start]))
        wide = np.flatnonzero(np.diff(cuts) > LEAST)
        todo += [(start + a + 1, start + b, level + 1) for a, b in zip(cuts[wide].tolist(), cuts[wide + 1].tolist())]
    return sorted(stable)


def _pair_classes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Class numbers of pairs of class numbers."""
    return np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)[1].astype(np.int64)


def scan_lags(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in one segment, by start, then period."""
    n, window, runs = len(words), 1, []
    classes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while window <= n // REPEATS or window <= _FIRST_WINDOW:
        if window >= _FIRST_WINDOW:
            found = _runs_of_window(classes, n, window)
            if found is None:
                break
            runs += found
        if len(classes) <= window:
            break
        classes = _pair_classes(classes[:-window], classes[window:])
        window *= 2
    # Window lengths overshoot by less than double: the last one covers every period up to a third of the segment.
    if window > n // REPEATS and len(classes) and window > _FIRST_WINDOW:
        runs += _runs_of_window(classes, n, window) or []
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _runs_of_window(classes: np.ndarray, n: int, window: int) -> list[tuple[int, int, int]] | None:
    """Runs with periods in ``(window / 2, window]`` (all up to ``window`` for the first window); None if no window of
    this length occurs twice, so that no longer one does."""
    order = np.argsort(classes, kind="stable")
    again = classes[order[1:]] == classes[order[:-1]]
    if not again.any():
        return None
    lag = np.zeros(len(classes) + 2, np.int64)
    lag[order[1:][again] + 1] = (order[1:] - order[:-1])[again]
    edges = np.flatnonzero(lag[1:] != lag[:-1])
    starts, ends, lags = edges[:-1], edges[1:], lag[edges[:-1] + 1]
    shortest = 1 if window == _FIRST_WINDOW else window // 2 + 1
    fits = (lags >= shortest) & (lags <= window)
    out = []
    for a, b, q in zip(starts[fits].tolist(), ends[fits].tolist(), lags[fits].tolist()):
        start, length = a - q, b - a + window - 1 + q
        if length >= max(LEAST, REPEATS * q):
            out.append((start, length, q))
    return out


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a list of words, by start, then period."""
    if len(words) < LEAST:
        return []
    numbers: dict = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) * REPEATS > len(words) and np.bincount(coded).max() < REPEATS:
        return []
    runs = []
    for start, end in split_by_frequency(coded):
        runs += [(start + s, length, q) for s, length, q in scan_lags(coded[start:end])]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside runs and the first period of each run; a word is dropped if any run repeats it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def _find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for raw in texts:
            words = (raw or b"").split()
            runs = periodic_runs(words)
            rows.append(([{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "replace")))
        yield pd.DataFrame(rows, columns=["runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed`` (the words
    that no run repeats, joined by one space).

    Words are parted by ASCII white space. Null and blank texts have no runs and an empty ``collapsed``. Existing columns of
    these names are replaced, repeated rows have equal results, an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    found = F.pandas_udf(_find, "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    out = docs.withColumn("_found", found(F.col(text).cast("binary")))
    return out.withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")
