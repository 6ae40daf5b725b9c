"""Operators on vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantcast.llm import lattice, neighbours

ROWS = "vec_id long, embedding array<float>, label int, node string, key string"


def vectors(spark, x, labels, extra=()):
    rows = [(i, [float(v) for v in r], int(c), "n", "k") for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows + list(extra), ROWS).repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[100:200] = x[rng.integers(0, 20, 100)] + 0.1 * rng.normal(size=(100, 24))
    x[200:230] = x[5]
    x[230:250] = 3 * x[6]
    return x, rng.integers(0, 2, 400)


ODD = [
    (1000, None, 1, "", ""), (1001, [0.0] * 24, 1, "", ""), (1002, [float("nan")] + [1.0] * 23, 1, "", ""), (1003, [float("inf")] + [1.0] * 23, 0, "", ""),
    (1004, [None] + [1.0] * 23, 0, "", ""), (1005, [1.0] * 24, None, "", ""), (1006, [1.0] * 24, None, "", ""), (1007, [], 1, "", ""), (None, [1.0] * 24, 1, "", ""),
    (1008, [1.0] * 24, 1, "", ""), (1008, [1.0] * 24, 1, "", ""),
]


def test_near_vectors(spark, data):
    x, labels = data
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(link, low[None, :], 10**6).min(axis=1))
    found = lattice.near_vectors(vectors(spark, x, labels, ODD)).collect()
    assert len(found) == len(x) + len(ODD)
    for r in found:
        i = r["vec_id"]
        if i is not None and i < 400:
            assert (r["n_links"], r["component_id"], r["kept"]) == (link[i].sum(), low[i], low[i] == i)
        elif i in (None, 1008):
            assert (r["n_links"], r["component_id"], r["kept"]) == (2, 1008, i == 1008)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert lattice.near_vectors(vectors(spark, x[:0], labels[:0]).where("vec_id is null")).count() == 0


def test_large_cells_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = (np.ones((150, 32)) + 0.1 * rng.normal(size=(150, 32))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    expected = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in lattice.near_vectors(vectors(spark, x, np.ones(150))).collect()}
    assert [found[i] for i in range(150)] == expected.tolist()


def test_nearest_cells_are_lattice_points_and_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    own = lattice.nearest_cell(x)
    doubled = np.rint(2 * own).astype(int)
    assert (np.abs(2 * own - doubled) < 1e-9).all() and ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all()
    assert (own.sum(axis=1) % 2 == 0).all()
    steps = lattice.neighbours()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    distance = ((x - own) ** 2).sum(axis=1)
    assert (((x[:, None, :] - own[:, None, :] - steps[None]) ** 2).sum(axis=2).min(axis=1) >= distance - 1e-9).all()


def test_pairs_at_the_threshold_are_found():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    a, b = lattice.entries(x), lattice.entries(0.98 * x + np.sqrt(1 - 0.98**2) * y)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.99


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1300] = x[7]
    found = neighbours.nearest(vectors(spark, x, np.zeros(3000), ODD), F.col("vec_id") % 50 == 0).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for i in range(0, 3000, 50):
        s = unit @ unit[i]
        s[i] = -2
        part = found[found["query_id"] == i].sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and i not in part["vec_id"].tolist()
        assert part["score"].is_monotonic_decreasing
        inside = part[part["vec_id"] < 3000]
        assert np.allclose(inside["score"], s[inside["vec_id"].to_numpy(int)], atol=1e-9)
        hits += (part["score"] >= np.sort(s)[-5] - 1e-9).sum()
        total += 5
    assert hits / total >= 0.9


def test_nearest_of_many_copies_are_those_of_smallest_key(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[rng.permutation(1200)[:500]] = x[3]
    ids = rng.permutation(1200)
    frame = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>").repartition(5)
    found = neighbours.nearest(frame, F.col("vec_id") % 40 == 0).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    copies = (x == x[3]).all(axis=1)
    whole = total = 0
    for at in np.flatnonzero(ids % 40 == 0):
        s = np.round(unit @ unit[at], 9)
        s[at] = -2
        expected = ids[np.lexsort((ids, -s))[:5]].tolist()
        got = found[found["query_id"] == ids[at]].sort_values("rank")["vec_id"].tolist()
        assert len(got) == 5 and not (copies[at] and got != expected)
        whole, total = whole + (got == expected), total + 1
    assert whole / total >= 0.9


def test_few_vectors(spark):
    rows = vectors(spark, np.eye(3, dtype=np.float32), [0, 0, 0])
    found = neighbours.nearest(rows, F.lit(True)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert neighbours.nearest(rows.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(rows.where("vec_id = 0"), F.lit(True)).count() == 0
