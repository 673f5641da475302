"""As-of and vintage operators against brute force, and their invariances."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import etl, pit

T0 = dt.datetime(2024, 1, 1)


def _world(seed):
    rng = random.Random(seed)
    right = [(f"k{rng.randrange(4)}", T0 + dt.timedelta(hours=rng.randrange(30)), i, rng.random()) for i in range(60)]
    left = [(f"k{rng.randrange(5)}", T0 + dt.timedelta(hours=rng.randrange(34)), i) for i in range(40)]
    return left, right


def _frames(spark, left, right):
    return spark.createDataFrame(left, "k string, t timestamp_ntz, row long"), spark.createDataFrame(right, "k string, kt timestamp_ntz, seq long, v double")


def test_asof_join_equals_brute_force(spark):
    for seed in range(3):
        left, right = _world(seed)
        l, r = _frames(spark, left, right)
        for lag in (0, 3):
            want = {}
            for k, t, i in left:
                seen = [(kt, s, v) for kk, kt, s, v in right if kk == k and kt <= t - dt.timedelta(hours=lag)]
                want[i] = max(seen)[1] if seen else None
            got = pit.asof_join(l, r, ["k"], "t", "kt", ["seq"], lag=dt.timedelta(hours=lag))
            assert {x.row: x.seq for x in got.collect()} == want and got.count() == len(left)
        ranged = pit.asof_join_ranged(l, r, ["k"], "row", "t", "kt", ["seq"])
        same = pit.asof_join(l, r, ["k"], "t", "kt", ["seq"])
        assert {x.row: x.right_seq for x in ranged.collect()} == {x.row: x.seq for x in same.collect()}


def test_latest_vintage_truncation_and_partitions(spark):
    left, right = _world(9)
    _, r = _frames(spark, left, right)
    as_of = F.lit("2024-01-01 18:00:00").cast("timestamp_ntz")
    whole = {x.k: (x.kt, x.seq) for x in pit.latest_vintage(r, ["k"], "kt", "seq", as_of).collect()}
    cut = pit.truncate_future(r, "kt", as_of)
    assert {x.k: (x.kt, x.seq) for x in pit.latest_vintage(cut, ["k"], "kt", "seq", as_of).collect()} == whole
    for n in (1, 3, 17):
        assert {x.k: (x.kt, x.seq) for x in pit.latest_vintage(r.repartition(n), ["k"], "kt", "seq", as_of).collect()} == whole
    want = {}
    for k, kt, s, _ in right:
        if kt <= dt.datetime(2024, 1, 1, 18):
            want[k] = max(want.get(k, (kt, s)), (kt, s))
    assert whole == want


def test_lag_and_keys():
    assert pit.effective_lag(dt.timedelta(days=2), dt.timedelta(days=1)) == dt.timedelta(days=2)
    try:
        pit.effective_lag(dt.timedelta(days=-1))
        raise AssertionError
    except pit.PitError:
        pass


def test_boundary_is_inclusive(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "kt timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert df.where(pit.knowable(F.col("kt"), at("2024-01-02 00:00:00"))).count() == 1
    assert df.where(pit.knowable(F.col("kt"), at("2024-01-03 00:00:00"), dt.timedelta(days=1))).count() == 1
    assert df.where(pit.knowable(F.col("kt"), at("2024-01-02 23:59:59"), dt.timedelta(days=1))).count() == 0


def test_intervals(spark):
    i = spark.createDataFrame([("a", dt.date(2020, 1, 1), dt.date(2020, 3, 31), "x"), ("a", dt.date(2020, 4, 1), None, "y"), ("b", dt.date(2020, 2, 1), dt.date(2020, 2, 1), "z")], "s string, f date, t date, c string")
    d = spark.createDataFrame([(dt.date(2020, 2, 1),), (dt.date(2020, 3, 31),), (dt.date(2021, 1, 1),)], "day date")
    got = {(r.day.isoformat(), r.s, r.c) for r in pit.interval_members(i, d, "day", ["s"], "f", "t").collect()}
    assert got == {("2020-02-01", "a", "x"), ("2020-02-01", "b", "z"), ("2020-03-31", "a", "x"), ("2021-01-01", "a", "y")}


def test_vintages_and_waves(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 6.0), ("a", 4, None), ("a", 5, None), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, kt long, v double")
    got = sorted((r.k, r.kt, r.vintage_seq) for r in etl.assemble_vintages(df, ["k"], "kt", ["v"], []).collect())
    assert got == [("a", 1, 0), ("a", 3, 1), ("a", 4, 2), ("b", 1, 0)]
    held = etl.assemble_vintages(df.where("kt <= 2"), ["k"], "kt", ["v"], [])
    more = etl.append_vintages(held, df.where("kt = 3"), ["k"], "kt", ["v"]).collect()
    assert [(r.k, r.vintage_seq) for r in more] == [("a", 1)]
    assert etl.append_vintages(held, df.where("kt = 2"), ["k"], "kt", ["v"]).count() == 0


def test_adjustment_factors_fold_in_order(spark):
    rows = [("s", dt.date(2020, 1, 1), 1, 2.0, 1.0, T0, "x"), ("s", dt.date(2020, 1, 1), 2, 1.0, 1.02, T0 + dt.timedelta(days=1), "y"), ("s", dt.date(2020, 6, 1), 3, 0.5, 1.0, T0, "z")]
    df = spark.createDataFrame(rows, "s string, d date, o long, split double, payout double, ann timestamp_ntz, id string")
    got = {r.d.isoformat(): r for r in etl.adjustment_factors(df, "s", "d", ["o"], "split", "payout", "ann", "id").collect()}
    assert got["2020-01-01"].split_factor_cum == 2.0 and got["2020-01-01"].total_return_factor_cum == 2.04
    assert got["2020-06-01"].split_factor_cum == 1.0 and list(got["2020-06-01"].derived_from_action_ids) == ["x", "y", "z"]
    assert got["2020-06-01"].knowledge_time == T0 + dt.timedelta(days=1)
