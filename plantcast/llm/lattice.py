"""Near-duplicate vectors by lattice hashing.

In each table a random projection takes a unit vector to two points of eight dimensions, and each point is decoded to its
cell of the E8 lattice. A vector is entered under its own pair of cells and under those in which one of the two is replaced
by a neighbouring cell that lies next nearest. Vectors that share an entry are compared by cosine in double precision.
Pairs stay inside the task: it returns the number of links of each member and one link towards the least member it is
connected to. A pair that shares several entries counts at the least of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.components import smallest_keys
from plantcast.llm.shared import SALTS, group_count, salted_lookup, stored

TABLES = 5
PROBES = 2
# Edge of the lattice on the unit sphere: at 0.5, unit vectors of cosine 0.98 share a cell of their probes in about nine of
# ten tables.
CELL = 0.5
SEED = 20240611
# Members of a cell that one task compares; larger cells are cut, and each two parts meet in one task.
BLOCK = 1024
ROWS_PER_GROUP = 8192


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest whole-numbered points with an even sum."""
    point = np.rint(x)
    rest = x - point
    worst = np.abs(rest).argmax(axis=1)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    point[odd, worst[odd]] += np.where(rest[odd, worst[odd]] >= 0, 1.0, -1.0)
    return point


def nearest_cell(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: even whole-numbered points, or the same shifted by one half."""
    plain, shifted = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - plain) ** 2).sum(axis=1) <= ((x - shifted) ** 2).sum(axis=1)
    return np.where(closer[:, None], plain, shifted)


def probed_cells(x: np.ndarray, probes: int) -> list[np.ndarray]:
    """Own cell, then the neighbouring cells in order of nearness."""
    own, steps = nearest_cell(x), neighbours()
    order = np.argsort(-((x - own) @ steps.T), axis=1, kind="stable")[:, :probes]
    return [own] + [own + steps[order[:, p]] for p in range(probes)]


def _code(points: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return ((2 * points).astype(np.int64).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)


def entries(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, cell: float = CELL) -> np.ndarray:
    """Sorted entry numbers of each row, ``tables * (1 + 2 * probes)`` of them."""
    size = unit.shape[1]
    rng = np.random.default_rng([SEED, size])
    found = []
    for _ in range(tables):
        matrix = rng.normal(size=(size, 16))
        turned = np.linalg.qr(matrix)[0] * np.sqrt(size / 8) if size >= 16 else matrix / np.sqrt(8)
        factors = rng.integers(1, 1 << 63, size=(2, 8), dtype=np.uint64) | np.uint64(1)
        places = unit @ turned / cell
        left = [_code(c, factors[0]) for c in probed_cells(places[:, :8], probes)]
        right = [_code(c, factors[1]) for c in probed_cells(places[:, 8:], probes)]
        found += [left[0] + right[0]] + [c + right[0] for c in left[1:]] + [left[0] + c for c in right[1:]]
    return np.sort(np.column_stack(found).view(np.int64), axis=1)


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and holds neither nulls nor non-finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _with_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = np.empty(len(pdf), object)
        for _, at in pdf.groupby("dim").indices.items():
            keys[at] = list(entries(unit_rows(pdf["vector"].iloc[at])))
        yield pdf.assign(keys=keys)


def _first_shared(keys: np.ndarray, here: int) -> np.ndarray:
    """Matrix of pairs that share no entry below ``here``."""
    below = keys[keys < here]
    values, counts = np.unique(below, return_counts=True)
    values = values[counts > 1]
    if not len(values):
        return np.ones((len(keys), len(keys)), bool)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    rows, columns = np.nonzero((values[at] == keys) & (keys < here))
    holds = np.zeros((len(keys), len(values)), np.float32)
    holds[rows, at[rows, columns]] = 1
    return holds @ holds.T == 0


def _compare(least: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (key, p, q), at in _cells(pdf):
            part = pdf.iloc[at]
            unit = unit_rows(part["vector"])
            link = unit @ unit.T >= least
            np.fill_diagonal(link, False)
            if p != q:
                own = part["own"].to_numpy()
                link &= own[:, None] != own[None, :]
            if not link.any():
                continue
            link &= _first_shared(np.stack(part["keys"].to_numpy()), key)
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            low = nodes.copy()
            while True:
                better = np.minimum(low, np.where(link, low[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (better == low).all():
                    break
                low = better
            some = link.any(axis=1)
            out.append(pd.DataFrame({"node": nodes[some], "links": (link @ copies)[some], "low": low[some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "low": []}).astype("int64")

    return compare


def _cells(pdf: pd.DataFrame):
    """((key, p, q), row positions) of each part of a cell."""
    for (_, _, key, p, q), at in pdf.groupby(["label", "dim", "key", "p", "q"], sort=False).indices.items():
        yield (key, p, q), at


def vector_links(nodes: DataFrame, least: float) -> DataFrame:
    """``node``, ``links`` and ``low``, in parts to be summed and joined, of ``nodes`` (``node``, ``label`` as text, ``dim``,
    ``vector``, ``copies``, ``keys``; a written table)."""
    cell = ["label", "dim", "key"]
    slim = nodes.select("node", "label", "dim", F.explode("keys").alias("key"))
    sizes = slim.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = stored(sizes.select(*cell, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts")), "cells")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("p"), F.greatest(k, F.col("own")).alias("q")),
    )
    placed = slim.join(shared, cell).withColumn("own", own).select("node", "key", "own", F.explode(meets).alias("at"))
    placed = stored(placed.select(F.col("node").alias("_n"), "key", "own", "at.p", "at.q"), "members")
    groups = group_count(placed.count(), ROWS_PER_GROUP)
    members = placed.join(nodes, F.col("_n") == F.col("node")).drop("_n")
    group = F.pmod(F.xxhash64(*cell, "p", "q"), F.lit(groups)).alias("g")
    return members.groupBy(group).applyInPandas(_compare(least), "node long, links long, low long")


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row of ``rows``: ``key``, ``n_links`` (other rows of the same label with cosine of at least ``least`` that
    were found), ``component_id`` (smallest key reachable over links) and ``kept``.

    Equal vectors are one node, and rows with equal keys are separate rows. Vectors that are null, zero or hold null or
    non-finite numbers, and rows without a label, link with nothing. Vectors of different lengths are not compared.
    """
    vec, lab = F.col(vector), F.col(label).cast("string")
    sound = usable(vec) & lab.isNotNull()
    mark = F.when(sound, F.struct(F.xxhash64(lab, vec).alias("a"), F.xxhash64(vec, lab, F.lit(1)).alias("b")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    marked = rows.select(F.col(key).alias("_key"), lab.alias("label"), vec.alias("vector"), mark.alias("mark"), salt)
    marked = stored(marked, "vectors")
    distinct = marked.where(F.col("mark").isNotNull()).groupBy("mark", "label", "vector").agg(
        F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    distinct = distinct.select(F.monotonically_increasing_id().alias("node"), "mark", "label", F.size("vector").alias("dim"), "vector", "first", "copies")
    schema = distinct.withColumn("keys", F.lit(None).cast("array<long>")).schema
    nodes = stored(distinct.mapInPandas(_with_entries, schema), "vector-nodes")
    parts = stored(vector_links(nodes.drop("mark", "first"), least), "vector-links")
    counts = parts.groupBy(F.col("node").alias("_m")).agg(F.sum("links").alias("links"))
    lowest = smallest_keys(nodes, parts.select("node", "low")).withColumnRenamed("node", "_c")
    table = nodes.join(counts, F.col("node") == F.col("_m"), "left").join(lowest, F.col("node") == F.col("_c"))
    table = table.select("mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = salted_lookup(marked.drop("vector", "label"), table, "mark", F.col("salt"))
    component = F.when(F.col("n_links").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return found.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept")
    )
