"""Hand-computed values of the cross-section, metric, label and return operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import xsec
from tidemark.operators import metrics, targets


def frame(spark, values, v="v"):
    return spark.createDataFrame([(0, f"s{i:02d}", float(x)) for i, x in enumerate(values)], f"d int, k string, {v} double")


def test_midranks(spark):
    for values, want in (([1.0, 2, 2, 4], [1, 2.5, 2.5, 4]), ([5.0, 5, 5], [2, 2, 2])):
        got = xsec.midrank(frame(spark, values), ["d"], "v", "r").orderBy("k").collect()
        assert [r.r for r in got] == want


def test_rank_normalize_covers_finite_values_only(spark):
    df = spark.createDataFrame([(0, "A", 10.0), (0, "B", None), (0, "C", 5.0), (0, "D", float("nan")), (0, "E", 1.0)], "d int, k string, v double")
    assert {r.k: r.rank for r in xsec.rank_normalize(df, ["d"], "v", "k").collect()} == {"A": 1 / 3, "C": 2 / 3, "E": 1.0}


def test_fractiles(spark):
    for n, k, want in ((10, 5, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]), (7, 5, [0, 0, 1, 2, 2, 3, 4][:7]), (8, 5, [0, 0, 1, 1, 2, 3, 3, 4])):
        got = [r.fractile for r in xsec.fractile(frame(spark, [float(i) for i in range(n)]), ["d"], "v", "k", k).orderBy("k").collect()]
        assert got == [i * k // n for i in range(n)] and (n != 10 or got == want)
    assert xsec.fractile(frame(spark, [1.0, 2.0]), ["d"], "v", "k", 5).count() == 0
    assert xsec.too_few(frame(spark, [1.0, 2.0]), ["d"], "v", 5).first().reason == "too_few_names"


def test_labels(spark):
    for n, want in ((7, (2, 3, 2)), (10, (3, 4, 3))):
        got = [r.label for r in xsec.quantile_labels(frame(spark, [float(i) for i in range(n)]), ["d"], "v", "k", 0.3, 0.3).collect()]
        assert (got.count(-1), got.count(None), got.count(1)) == want
    tie = frame(spark, [0.0, 1, 2, 3, 4, 5, 6, 7.5, 7.5, 9])
    got = {r.k: r.label for r in xsec.quantile_labels(tie, ["d"], "v", "k", 0.3, 0.2).collect()}
    assert got["s08"] == 1 and got["s07"] is None


def test_zscore_of_a_constant_is_zero(spark):
    assert {r.z for r in xsec.zscore(frame(spark, [0.1] * 3), ["d"], "v").collect()} == {0.0}


def test_correlations(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 1.0), (0, 3.0, 3.0), (1, 1.0, 5.0), (1, 1.0, 6.0), (2, 1.0, 1.0)], "d int, x double, y double")
    series, ledger = metrics.ic_series(df, ["d"], "x", "y", rank=False)
    assert [(r.d, round(r.ic, 12)) for r in series.collect()] == [(0, 0.5)]
    assert {(r.d, r.reason) for r in ledger.collect()} == {(1, "degenerate"), (2, "too_few_names")}
    ties = spark.createDataFrame([(0, 1.0, 10.0), (0, 2.0, 20.0), (0, 2.0, 30.0), (0, 4.0, 40.0)], "d int, x double, y double")
    assert math.isclose(metrics.ic_series(ties, ["d"], "x", "y")[0].first().ic, math.sqrt(0.9))


def test_newey_west(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "t int, v double")
    assert math.isclose(metrics.newey_west(df, "t", "v", 1).first().se, 0.625)
    assert math.isclose(metrics.newey_west(df, "t", "v", 0).first().se, math.sqrt(1.25 / 4))


def test_tails(spark):
    df = spark.createDataFrame([(0, x) for x in (0.04, -0.10, 0.02, -0.03)], "b int, v double")
    assert metrics.tail_value(df, ["b"], "v", 0.25).first().value_at_risk == -0.10
    r = metrics.tail_value(df, ["b"], "v", 0.5).first()
    assert r.value_at_risk == -0.03 and math.isclose(r.expected_shortfall, -0.065)


def test_turnover(spark):
    names = [("a", 0.25), ("b", 0.25), ("c", 0.25), ("e", 0.25)]
    rows = [(0, n, w) for n, w in names] + [(0, n + "x", -w) for n, w in names]
    rows += [(1, n, w) for n, w in [*names[:2], ("f", 0.25), ("g", 0.25)]] + [(1, n, -w) for n, w in [("ax", 0.25), ("bx", 0.25), ("fx", 0.25), ("gx", 0.25)]]
    got = {r.d: r.one_way for r in metrics.turnover(spark.createDataFrame(rows, "t int, n string, w double"), "t", "n", "w").collect()}
    assert got[1] == pytest.approx(1.0)


def _price(spark, rows):
    return spark.createDataFrame([("s", d, c) for d, c in rows], "security_id string, event_date date, close double")


def test_forward_returns(spark):
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    point = spark.createDataFrame([(1, "s", d[0], d[2])], "row_id long, security_id string, start_day date, end_day date")
    none_f = spark.createDataFrame([], "security_id string, event_date date, total_return_factor_cum double")
    none_t = spark.createDataFrame([], "security_id string, effective_date date, terminal_return double")
    run = lambda p, f=none_f, t=none_t: targets.forward_returns(point, p, f, t, "security_id").first()
    assert run(_price(spark, [(d[0], 100.0), (d[2], 105.0)])).ret == pytest.approx(0.05)
    fac = spark.createDataFrame([("s", d[1], 1.02)], "security_id string, event_date date, total_return_factor_cum double")
    assert run(_price(spark, [(d[0], 100.0), (d[2], 105.0)]), fac).ret == pytest.approx(0.071)
    split = spark.createDataFrame([("s", d[1], 2.0)], "security_id string, event_date date, total_return_factor_cum double")
    assert run(_price(spark, [(d[0], 100.0), (d[2], 50.0)]), split).ret == pytest.approx(0.0)
    gone = spark.createDataFrame([("s", d[2], -0.5)], "security_id string, effective_date date, terminal_return double")
    r = run(_price(spark, [(d[0], 100.0), (d[1], 80.0)]), t=gone)
    assert r.ret == pytest.approx(-0.60) and r.delisted
    assert run(_price(spark, [(d[0], 100.0)])).reason == "missing_end_price"
    assert run(_price(spark, [(d[2], 100.0)])).reason == "missing_start_price"


def test_forward_return_in_another_currency(spark):
    d = [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    point = spark.createDataFrame([(1, "s", "EUR", *d), (2, "s", "GBP", *d)], "row_id long, security_id string, currency string, start_day date, end_day date")
    fx = spark.createDataFrame([(d[0], "EUR", "USD", 1.10), (d[1], "EUR", "USD", 1.21)], "event_date date, base_ccy string, quote_ccy string, rate double")
    none_f = spark.createDataFrame([], "security_id string, event_date date, total_return_factor_cum double")
    none_t = spark.createDataFrame([], "security_id string, effective_date date, terminal_return double")
    r = {x.row_id: x for x in targets.forward_returns(point, _price(spark, [(d[0], 10.0), (d[1], 10.0)]), none_f, none_t, "security_id", fx=fx, base="USD").collect()}
    assert r[1].ret == pytest.approx(0.10) and r[2].reason == "fx_missing"


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "t int, v double")
    a, b = (sorted(map(tuple, metrics.block_bootstrap(df, "t", "v", 4, 20, 7).repartition(n).collect())) for n in (1, 5))
    assert a == b and len(a) == 20
