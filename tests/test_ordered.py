"""The chunked operations against brute force, with chunks small enough that every path runs."""

import datetime
import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plantcast.operators import ordered, split
from plantcast.operators.aggregates import describe
from plantcast.operators.encode import apply_encoder, fit_encoder
from plantcast.operators.keyed import latest_per_key
from plantcast.operators.metrics import roc_auc


def lots(seed, n, keys, days, hot=0.0, nulls=0.0):
    """Random lots; ``hot`` is the share of rows on the first key and day."""
    rng = random.Random(seed)
    start = datetime.date(2026, 1, 5)
    rows = []
    for i in range(n):
        on_hot = rng.random() < hot
        key = keys[0] if on_hot else rng.choice(keys)
        day = start + datetime.timedelta(0 if on_hot else rng.randrange(days))
        value = None if rng.random() < nulls else float(rng.randrange(1000)) / 4
        rows.append((f"INS-{i:06d}", key, day, value))
    rng.shuffle(rows)
    return rows


LOT = "lot string, k string, d date, v double"


def rolling_brute(rows, width):
    out, seen = {}, {}
    for lot, key, _, value in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        history = seen.setdefault(key, [])
        history.append(value)
        known = [x for x in history[-width:] if x is not None]
        out[lot] = sum(known) / len(known) if known else None
    return out


@pytest.mark.parametrize("chunk", [1, 3, 11])
@pytest.mark.parametrize("hot, nulls", [(0.0, 0.0), (0.6, 0.0), (0.4, 0.3)])
def test_rolling_mean(spark, chunk, hot, nulls):
    rows = lots(1, 120, ["A", "B", "C"], 9, hot, nulls)
    df = spark.createDataFrame(rows, LOT)
    got = {r.lot: r.m for r in ordered.rolling_means(df, "v", {"m": "k"}, ["d", "lot"], 4, chunk).collect()}
    want = rolling_brute(rows, 4)
    assert got.keys() == want.keys()
    for lot, mean in want.items():
        assert got[lot] == (None if mean is None else pytest.approx(mean))


@pytest.mark.parametrize("chunk", [1, 3, 11])
def test_running_before(spark, chunk):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i * 3 + rng.randrange(3), rng.randrange(10)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, o int, n int")
    got = {(r.g, r.o): r.before for r in ordered.running_before(df, ["o"], {"before": F.col("n")}, ["g"], chunk).collect()}
    assert got == {(g, o): sum(n2 for g2, o2, n2 in rows if g2 == g and o2 < o) for g, o, _ in rows}


@pytest.mark.parametrize("chunk", [1, 3, 11])
@pytest.mark.parametrize("values", [[5.0] * 30, [float(i % 7) for i in range(41)], [float(i * i) for i in range(40)]])
def test_quantiles(spark, chunk, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = ordered.quantiles(df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, chunks=chunk).first()
    assert [row.q1, row.q2, row.q3] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"))


def test_describe_has_sample_deviation(spark):
    values = [1.0, 2.0, 2.0, 9.0]
    row = describe(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], 2).first()
    assert row.n == 4 and row["std"] == pytest.approx(statistics.stdev(values)) and row.q50 == 2.0


@pytest.mark.parametrize("chunk", [1, 3, 11])
@pytest.mark.parametrize("n, hot", [(97, 0.0), (100, 0.7), (1, 0.0), (3, 0.0)])
def test_time_split(spark, chunk, n, hot):
    rows = lots(5, n, ["A"], 11, hot)
    df = spark.createDataFrame(rows, LOT)
    got = {r.lot for r in split.time_split(df, "d", "lot", chunks=chunk).where("is_train").collect()}
    by_time = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert got == set(by_time[: int(0.8 * n)])


def hashed(key, seed=42):
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("chunk", [1, 3, 11])
def test_random_split(spark, chunk):
    keys = [f"k{i}" for i in range(83)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key for r in split.random_split(df, "key", chunks=chunk).where("is_train").collect()}
    order = sorted(keys, key=lambda k: (hashed(k), k))
    assert got == set(order[: len(keys) - math.ceil(0.2 * len(keys))])


@pytest.mark.parametrize("chunk", [1, 3, 11])
def test_stratified_split_and_folds(spark, chunk):
    rows = [(f"k{i}", int(i % 7 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, label int")
    parts = split.stratified_split(df, "key", "label", chunks=chunk).collect()
    for label in (0, 1):
        keys = sorted((k for k, v in rows if v == label), key=lambda k: (hashed(k), k))
        train = {r.key for r in parts if r.label == label and r.is_train}
        assert train == set(keys[: len(keys) - math.ceil(0.2 * len(keys))])
    folds = {r.key: r.fold for r in split.stratified_folds(df, "key", "label", chunks=chunk).collect()}
    for label in (0, 1):
        keys = sorted((k for k, v in rows if v == label), key=lambda k: (hashed(k), k))
        assert [folds[k] for k in keys] == [i % 5 for i in range(len(keys))]


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    first = split.random_split(df.repartition(1), "key").where("is_train")
    second = split.random_split(df.repartition(7), "key", chunks=9).where("is_train")
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
    sample = [r.key for r in split.seeded_sample(df.repartition(3), "key", 5).collect()]
    assert sample == [r.key for r in split.seeded_sample(df.repartition(1), "key", 5).collect()]


@pytest.mark.parametrize("chunk", [1, 3, 11])
def test_roc_auc_with_ties(spark, chunk):
    rng = random.Random(11)
    rows = [(rng.randrange(2), rng.choice([0.1, 0.2, 0.25, 0.5, rng.random()])) for _ in range(200)]
    wins = [(p > n) + 0.5 * (p == n) for lp, p in rows if lp for ln, n in rows if not ln]
    df = spark.createDataFrame(rows, "y int, s double")
    assert roc_auc(df, "y", "s", chunk).first()[0] == pytest.approx(sum(wins) / len(wins))


def test_roc_auc_of_one_class_is_null(spark):
    assert roc_auc(spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double"), "y", "s").first()[0] is None


@pytest.mark.parametrize("chunk", [1, 3, 11])
def test_encoder(spark, chunk):
    values = ["M-10", "M-9", "M-1", "m", "", "Ä", "zz", "M-100", None, "M-9"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    encoder = fit_encoder(df, "v", chunk)
    want = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda s: s.encode()))}
    assert {r.value: r.code for r in encoder.collect()} == want
    seen = spark.createDataFrame([("M-9",), ("new",), (None,)], "v string")
    assert [r.c for r in apply_encoder(seen, encoder, "v", "c").collect()] == [want["M-9"], 0, 0]
    assert [r.c for r in apply_encoder(seen, encoder, "v", "c", -1).collect()] == [want["M-9"], -1, -1]


def test_latest_per_key(spark):
    rows = [("a", 1, 5, "x"), ("a", 2, 1, "y"), ("b", 1, 1, None), ("b", 1, 0, "z")]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string")
    assert sorted(map(tuple, latest_per_key(df, ["k"], ["t", "i"]).collect())) == [("a", 2, 1, "y"), ("b", 1, 1, None)]


def test_one_odd_id_and_a_hot_date_do_not_fill_one_chunk(spark):
    rows = [(1, f"INS-{i:012d}") for i in range(4000)] + [(2, "X-1")]
    df = spark.createDataFrame(rows, "d int, lot string")
    sizes = [r["count"] for r in ordered.with_chunk(df, ["d", "lot"], 8).groupBy(ordered.CHUNK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 4001 / 8


@pytest.mark.parametrize("chunk", [1, 5])
def test_null_keys_labels_scores_and_dates(spark, chunk):
    rng = random.Random(9)
    rows = [(f"k{i}", rng.choice(["a", None]), rng.choice([0, 1, None]), rng.choice([None, 0.25, rng.random()]), rng.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, g string, y int, s double, d int")
    pairs = [(y, s) for _, _, y, s, _ in rows if y is not None and s is not None]
    wins = [(p > n) + 0.5 * (p == n) for a, p in pairs if a for b, n in pairs if not b]
    assert roc_auc(df, "y", "s", chunk).first()[0] == pytest.approx(sum(wins) / len(wins))
    folds = {r.key: r.fold for r in split.stratified_folds(df, "key", "y", chunks=chunk).collect()}
    train = {r.key for r in split.stratified_split(df, "key", "y", chunks=chunk).where("is_train").collect()}
    for label in (0, 1, None):
        keys = sorted((r[0] for r in rows if r[2] == label), key=lambda k: (hashed(k), k))
        assert [folds[k] for k in keys] == [i % 5 for i in range(len(keys))]
        assert train & set(keys) == set(keys[: len(keys) - math.ceil(0.2 * len(keys))])
    by_time = sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0]))
    got = {r.key for r in split.time_split(df, "d", "key", chunks=chunk).where("is_train").collect()}
    assert got == {r[0] for r in by_time[:160]}
    means = {r.key: r.m for r in ordered.rolling_means(df, "s", {"m": "g"}, ["d", "key"], 4, chunk).collect()}
    history = []
    for key, g, _, s, _ in by_time:
        if g is None:
            assert means[key] is None
            continue
        history.append(s)
        known = [x for x in history[-4:] if x is not None]
        assert means[key] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_stratified_split_deals_a_class_over_many_tasks(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).alias("label"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        parts = split.stratified_split(df, "key", "label").select("label", "is_train", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sum(r.p == p for r in parts) for p in {r.p for r in parts}) < 1000
    assert all(sum(r.is_train for r in parts if r.label == label) == 1600 for label in (0, 1))


def test_scrap_features_read_the_lots_from_one_written_table(tables):
    from plantcast.plans import scrap

    plan = scrap.enriched_from(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "chunk" in plan.lower()


def test_calendar_lags_go_by_weeks_not_by_rows(spark):
    from plantcast.operators.ordered import calendar_lags, calendar_rolling

    rows = [(1, "A", "x", 1.0), (2, "A", "x", 2.0), (4, "A", "x", 4.0), (2, "A", "y", 9.0), (None, "A", "x", 7.0), (3, None, "x", 3.0)]
    df = spark.createDataFrame(rows, "week int, m string, s string, v double")
    out = calendar_rolling(calendar_lags(df, ["m", "s"], "week", {"lag1": ("v", 1), "lag2": ("v", 2)}), ["m", "s"], "week", 3, {"mean": "v"})
    got = {(r.week, r.m, r.s): (r.lag1, r.lag2, r["mean"]) for r in out.collect()}
    assert got == {
        (1, "A", "x"): (None, None, 1.0), (2, "A", "x"): (1.0, None, 1.5), (4, "A", "x"): (None, 2.0, 3.0), (2, "A", "y"): (None, None, 9.0),
        (None, "A", "x"): (None, None, None), (3, None, "x"): (None, None, 3.0),
    }


def test_merged_sketches_equal_the_whole(spark):
    from plantcast.operators.aggregates import distinct_sketches, merged_distinct

    df = spark.range(20_000).selectExpr("id % 30 as week", "id % 7000 as v", "cast(null as string) as none")
    weekly = merged_distinct(distinct_sketches(df, ["week"], ["v", "none"]), ["v", "none"]).first()
    whole = merged_distinct(distinct_sketches(df, [], ["v", "none"]), ["v", "none"]).first()
    assert abs(weekly.v - 7000) < 7000 * 0.033 and abs(weekly.v - whole.v) < 7000 * 0.01 and weekly.none == 0


def test_complete_cases_drop_null_and_nan_before_later_joins(spark):
    from plantcast.operators.cleaning import complete_cases

    left = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    right = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b"), (3, 3.0, None)], "k int, v double, s string")
    joined = complete_cases(left.join(right, "k", "left"), ["v", "s"])
    assert "LeftOuter" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in joined.collect()] == [(1, 1.0, "a")]
    assert complete_cases(left, []).count() == 4


def test_planning_keys_are_made_after_the_order_join(tables):
    for frame in (tables.customer_orders(), tables.production_orders()):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join "):].split("\n", 1)[1]
        assert "material_no" not in below and "scenario" not in below
