"""Hand-computed values of the model, portfolio, cost and ledger operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, etl, folds, ledger, model, portfolio, quality, targets
from tidemark.sources.store import materialised


def test_bin_values(spark):
    # fixed values: published bin masses with their values
    rows = [(0.3378, 0.2297, 1 / 18, 0.1607), (0.1622, 0.2703, 1 / 18, -0.2016), (0.0, 0.2, 0.1, -0.5 * math.log(3)), (0.0, 0.0, 0.1, 0.0)]
    got = spark.createDataFrame(rows, "p double, m double, e double, want double").select(model.bin_value(F.col("p"), F.col("m"), F.col("e")).alias("h"), "want").collect()
    assert all(abs(r.h - r.want) < 1e-4 for r in got)


def test_micro_example(spark):
    y = [1, 1, 1, -1, 1, -1, -1, -1, 1, -1]
    obs = spark.createDataFrame([(i, (i + 1) / 10, v) for i, v in enumerate(y)], "i int, f double, y int")
    fitted = model.boost(obs, ["f"], "y", 1, 2, save=materialised)
    assert fitted[0]["z"] == pytest.approx(0.4) and fitted[0]["values"][0] == pytest.approx(0.5 * math.log(2.5)) and fitted[0]["values"][1] == pytest.approx(-0.5 * math.log(2.5))
    assert model.load_model(model.dump_model(fitted)) == fitted
    for n in (1, 3, 7):
        assert model.boost(obs.repartition(n), ["f"], "y", 1, 2, save=materialised)[0]["factor"] == "f"


def test_sparse_factor_pays_for_what_it_does_not_cover(spark):
    y = [1, 1, -1, -1]
    obs = spark.createDataFrame([(0.1, None, 1), (0.2, None, 1), (0.8, 0.1, -1), (0.9, 0.9, -1)], "a double, b double, y int")
    assert model.boost(obs, ["b", "a"], "y", 1, 2, save=materialised)[0]["factor"] == "a"
    with pytest.raises(ValueError):
        model.boost(obs.withColumn("c", F.lit(None).cast("double")), ["c"], "y", 1, 2, save=materialised)
    assert len(y) == 4


def _market(rng, names):
    return {k: (rng.uniform(2e5, 4e6), rng.uniform(1, 30), rng.choice(("core", "island"))) for k in names}


def _charge(stack, size, adv, spread, region):
    """One trade's components, straight from their definitions, in basis points of a notional."""
    bp = size / 10_000
    over = max(0.0, size - stack.participation_cap * adv)
    parts = {
        "commission": stack.commission if size else 0.0,
        "half_spread": stack.crossing * spread * bp,
        "linear": stack.linear_by_region.get(region, stack.linear_bps) * bp,
        "impact": stack.impact_coeff * (size / adv) ** stack.impact_exp * bp,
        "participation": stack.participation_bps * over / 10_000,
    }
    return {k: v * stack.region_multiplier.get(region, 1.0) for k, v in parts.items()}


def test_trade_costs_and_ledger_hooks(spark):
    """Random trades against the definitions; the ledger's hooks charge the same sums."""
    rng = random.Random(17)
    names = [f"n{i:02d}" for i in range(24)]
    market = _market(rng, names)
    stack = costs.CostStack(commission=1.25, crossing=0.4, linear_bps=7, linear_by_region={"island": 33}, impact_coeff=12, impact_exp=0.6, participation_cap=0.05, participation_bps=80, region_multiplier={"island": 1.5})
    trades = {k: rng.choice((-1, 1)) * rng.uniform(0, 4e5) if i else 0.0 for i, k in enumerate(names)}
    rows = [("day", k, t, market[k][0], market[k][1], market[k][2]) for k, t in trades.items()]
    got = {r.security_id: r for r in costs.trade_costs(spark.createDataFrame(rows, "date string, security_id string, notional double, adv double, spread_bps double, region string"), stack).collect()}
    total = 0.0
    for k, t in trades.items():
        want = _charge(stack, abs(t), *market[k])
        total += sum(want.values())
        assert {c: got[k][c] for c in want} == pytest.approx(want) and got[k].total == pytest.approx(sum(want.values()))
        assert got[k].flagged == (abs(t) > 0.05 * market[k][0])
    cost, fee = costs.ledger_hooks(stack, market, 40, 21 / 365, {"island": 90})
    assert cost(trades) == pytest.approx(total)
    assert fee(trades) == pytest.approx(sum(-t * (90 if market[k][2] == "island" else 40) / 10_000 * 21 / 365 for k, t in trades.items() if t < 0))
    with pytest.raises(ValueError, match="nobody"):
        cost({"nobody": 1.0})
    for bad in ({"crossing": -0.1}, {"impact_exp": 0.0}, {"commission": float("inf")}, {"linear_by_region": {"x": -1}}):
        with pytest.raises(ValueError):
            costs.CostStack(**bad)


def _history(rng, periods, names):
    """Targets and marks of random periods; a name that ends is never traded again."""
    alive, out = list(names), []
    for p in range(periods):
        picked = rng.sample(alive, min(5, len(alive)))
        weights = {k: rng.uniform(-0.6, 0.6) for k in picked}
        steps = []
        held = set(picked)
        for s in range(rng.randint(1, 3)):
            gone = {k for k in sorted(held) if rng.random() < 0.04}
            steps.append(({k: rng.uniform(-0.2, 0.25) for k in held}, gone))
            held -= gone
            alive = [k for k in alive if k not in gone]
        out.append((weights, steps))
    return out


def _brute(history, nav, cost_rate, borrow_rate):
    """Share by share: money in each name and in cash, marked one step at a time."""
    cash, money, rows = nav, {}, []
    for weights, steps in history:
        start = cash + sum(money.values())
        traded = 0.0
        for k in set(money) | set(weights):
            want = weights.get(k, 0.0) * start
            traded += abs(want - money.get(k, 0.0))
            cash -= want - money.get(k, 0.0)
            money[k] = want
        cash -= cost_rate * traded
        before = cash + sum(money.values())
        for returns, gone in steps:
            for k, r in returns.items():
                money[k] *= 1 + r
            for k in gone:
                cash += money.pop(k, 0.0)
        gross = cash + sum(money.values()) - before
        short = borrow_rate * -sum(v for v in money.values() if v < 0)
        cash -= short
        money = {k: v for k, v in money.items() if v}
        rows.append((start, cost_rate * traded, gross, short, cash + sum(money.values())))
    return rows


def test_ledger_equals_money_counted_by_hand(spark):
    """Two books, by periods and as a frame dealt out and batched anyhow."""
    names = [f"s{i}" for i in range(14)]
    books = {b: _history(random.Random(seed), 9, names) for b, seed in (("one", 3), ("two", 8))}
    targets, marks, want = [], [], {}
    for b, history in books.items():
        for p, (weights, steps) in enumerate(history):
            targets += [(b, p, k, w) for k, w in weights.items()]
            marks += [(b, p, s, k, r, k in gone) for s, (returns, gone) in enumerate(steps) for k, r in returns.items()]
        want |= {(b, p): row for p, row in enumerate(_brute(history, 1000.0, 0.0015, 0.02 * 30 / 365))}
    t = spark.createDataFrame(targets, "book string, period int, name string, weight double").repartition(3)
    m = spark.createDataFrame(marks, "book string, period int, step int, name string, ret double, terminated boolean").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r.book, r.period): (r.nav_start, r.cost, r.gross_pnl, r.borrow, r.nav_end) for r in ledger.run_ledger(t, m, cost_bps=15, borrow_bps=200).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert ledger.run_ledger(t.where("false"), m.where("false")).count() == 0


def test_ledger_refuses(spark):
    none = lambda x: 0.0
    period = lambda nav, banned, weights, steps, cost=none: ledger.run_period(nav, {}, banned, weights, steps, cost, none)
    with pytest.raises(ledger.LedgerError, match="come back"):
        period(50.0, {"old"}, {"old": 0.2}, [({"old": 0.0}, set())])
    with pytest.raises(ledger.LedgerError, match="no usable return"):
        period(50.0, set(), {"new": 0.2}, [({"other": 0.1}, set())])
    with pytest.raises(ledger.LedgerError, match="not positive"):
        period(0.0, set(), {}, [])
    with pytest.raises(ledger.LedgerError, match="cost"):
        period(50.0, set(), {"new": 0.2}, [({"new": 0.1}, set())], lambda t: -1.0)
    row, _, held = period(50.0, set(), {"new": -0.5}, [({"new": 0.1}, {"new"})])
    assert held == {} and row["nav_end"] == pytest.approx(47.5) and row["one_way"] == pytest.approx(0.25)


def test_ledger_frame(spark):
    t = spark.createDataFrame([("b", 0, "A", 1.0), ("b", 0, "B", -1.0), ("b", 1, "A", 0.5)], "book string, period int, name string, weight double")
    m = spark.createDataFrame([("b", 0, 0, "A", 0.1, False), ("b", 0, 0, "B", 0.0, False), ("b", 1, 0, "A", 0.2, False)], "book string, period int, step int, name string, ret double, terminated boolean")
    got = ledger.run_ledger(t, m, cost_bps=10).orderBy("period").collect()
    assert got[0].nav_end == pytest.approx(1000 + 100 - 2) and got[1].nav_start == pytest.approx(got[0].nav_end) and max(r.residual for r in got) <= 1e-10


def test_signal_weighted_book(spark):
    df = spark.createDataFrame([(0, f"n{i}", float(10 - i)) for i in range(10)], "d int, k string, s double")
    got = sorted((round(r.weight, 6) for r in portfolio.level2(df, ["d"], "s", "k", 5).collect()), reverse=True)
    assert got == pytest.approx([9 / 16, 7 / 16, -7 / 16, -9 / 16])


def test_joint_beta_residual(spark):
    df = spark.createDataFrame([(0, "A", 4.0, 2.0), (0, "B", 3.0, 1.0), (0, "C", 1.0, 1.0), (0, "D", 0.0, 0.0)], "d int, k string, s double, b double")
    got = {r.k: round(r.weight, 9) for r in portfolio.level2(df, ["d"], "s", "k", 2, beta="b", joint=True).collect() if abs(r.weight) > 1e-9}
    assert got == {"B": 1.0, "C": -1.0}


def test_caps(spark):
    df = spark.createDataFrame([(0, "a", 0.6), (0, "b", 0.3), (0, "c", 0.1), (0, "x", -0.5), (0, "y", -0.5)], "d int, k string, w double")
    got = {r.k: r.capped for r in portfolio.capped(df, ["d"], "w", "k", 0.4).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.4, "c": 0.2, "x": -0.4, "y": -0.4})


def test_optimiser():
    import numpy as np

    w = portfolio.optimise([3.0, 1.0, -1.0, -3.0], np.eye(4) * 0.01, [-0.6] * 4, [0.6] * 4, [("net", np.ones(4))], [(0.0, 0.0)], 2.0, 1.0)
    assert abs(w.sum()) < 1e-5 and np.abs(w).sum() <= 2.0 + 1e-5 and np.allclose(w, [0.6, 0.4, -0.4, -0.6], atol=2e-3)
    with pytest.raises(portfolio.Infeasible, match="net"):
        portfolio.optimise([1.0, 1.0], np.eye(2), [0.1, 0.1], [0.2, 0.2], [("net", np.ones(2))], [(0.0, 0.0)], 2.0)


def test_optimiser_volatility_costs_and_borrow():
    import numpy as np

    free = ([], [], 10.0)
    w = portfolio.optimise([3.0, 4.0], np.array([[0.04, 0.01], [0.01, 0.09]]), [-5] * 2, [5] * 2, *free, volatility=0.2)
    c = np.array([[0.04, 0.01], [0.01, 0.09]])
    best = np.linalg.solve(c, [3.0, 4.0])
    assert np.allclose(w, best * 0.2 / np.sqrt(best @ c @ best), atol=1e-3)
    with pytest.raises(portfolio.Infeasible, match="volatility"):
        portfolio.optimise([1.0, 1.0], np.eye(2), [0.5] * 2, [1] * 2, *free, volatility=0.1)
    # alpha - w - cost, held where the gain is less than the cost, short only beyond cost and borrow
    w = portfolio.optimise([1.0, 0.55, -0.25, -1.0], np.eye(4), [-5] * 4, [5] * 4, *free, risk=1.0, held=[0.0, 0.5, 0.0, 0.0], cost=0.1, borrow=0.2)
    assert np.allclose(w, [0.9, 0.5, 0.0, -0.7], atol=1e-4)
    w = portfolio.optimise([-1.0, 0.25], np.eye(2), [-5] * 2, [5] * 2, *free, risk=1.0, held=[-0.75, -0.6], cost=0.1, borrow=0.2)
    assert np.allclose(w, [-0.75, 0.15], atol=1e-4)


def test_optimiser_turnover_and_conflicts():
    import itertools

    import numpy as np

    alpha, held = np.array([1.0, 0.4, -0.2, -1.0]), np.array([0.1, 0.3, -0.1, -0.3])
    w = portfolio.optimise(alpha, np.eye(4), [-1] * 4, [1] * 4, [("net", np.ones(4))], [(0.0, 0.0)], 4.0, risk=1.0, held=held, turnover=0.2)
    assert np.abs(w - held).sum() <= 0.4 + 1e-4 and abs(w.sum()) < 1e-4
    value = lambda x: alpha @ x - x @ x / 2
    steps = np.linspace(-0.2, 0.2, 21)
    best = max(value(held + d) for d in (np.array([a, b, c, -a - b - c]) for a, b, c in itertools.product(steps, repeat=3)) if np.abs(d).sum() <= 0.4 + 1e-9)
    assert value(w) >= best - 1e-3  # no book of the grid is better
    free = portfolio.optimise(alpha, np.eye(4), [-2] * 4, [2] * 4, [("net", np.ones(4))], [(0.0, 0.0)], 4.0, risk=1.0, held=held, turnover=9.0)
    assert np.allclose(free, alpha - alpha.mean(), atol=1e-3)
    one = lambda lower, upper, gross=9.0, **more: portfolio.optimise([1.0, 1.0], np.eye(2), lower, upper, [("net", np.ones(2))], [(0.0, 0.0)], gross, **more)
    for why, args, more in (("position_1 has no room", ([0, 1], [1, 0]), {}), ("net cannot", ([0.1, 0.1], [1, 1]), {}), ("gross", ([0.5, -1], [1, -0.5], 0.9), {}), ("turnover", ([0.5, -1], [1, -0.5]), {"held": [0.0, 0.0], "turnover": 0.4})):
        with pytest.raises(portfolio.Infeasible, match=why):
            one(*args, **more)


def test_optimised_book_bounds(spark):
    rows = [(0, f"n{i}", float(3 - i), 0.04, 50.0 if i == 0 else 1e6, i == 5) for i in range(7)] + [(1, "n0", 1.0, 0.04, None, False), (1, "n1", -1.0, 0.04, 1.0, False)]
    df = spark.createDataFrame(rows, "d int, k string, s double, var double, adv double, htb boolean")
    book = lambda **more: {(r.d, r.k): r for r in portfolio.level3(df, ["d"], "k", "s", 0.5, 2.0, variance="var", **more).collect()}
    plain = book()
    assert plain[0, "n0"].weight > 0.4 and plain[0, "n5"].weight < -0.4
    got = book(adv="adv", nav=100.0, most_participation=0.1, hard_to_borrow="htb", volatility=0.1)
    w = {k: r.weight for (d, k), r in got.items() if d == 0}
    assert got[0, "n0"].status == "ok" and w["n0"] <= 0.05 + 1e-4 and w["n5"] >= -1e-4 and abs(sum(w.values())) < 1e-3
    assert math.sqrt(0.04 * sum(x * x for x in w.values())) == pytest.approx(0.1, abs=1e-3)
    assert got[1, "n0"].weight is None or math.isnan(got[1, "n0"].weight)
    assert got[1, "n0"].status == "infeasible: adv unknown for 1 names"
    with pytest.raises(ValueError):
        portfolio.level3(df, ["d"], "k", "s", 0.5, 2.0, volatility=0.1)


def test_folds(spark):
    days = [dt.date(2020, m, 1) for m in range(1, 13)]
    rule = folds.FoldRule(train_steps=4, test_steps=3)
    f = folds.folds(days, rule)
    assert [x["test_from"].month for x in f] == [5, 8] and not folds.overlapping_tests(f)
    with pytest.raises(ValueError):
        folds.FoldRule(4, 3, purge=False).check(3)
    with pytest.raises(ValueError):
        folds.FoldRule(4, 3, embargo=0.5).check(3)


def test_quality(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 2, 5.0, -1.0), ("a", 3, 5.0, 0.0), ("a", 3, 6.0, None)], "k string, t int, p double, v double")
    assert quality.duplicates(df, ["k", "t"], ["p"]).count() == 1
    assert [(r.run_start, r.run_end, r.run_length) for r in quality.stale_runs(df, ["k"], ["t", "p"], "p", 3).collect()] == [(1, 3, 3)]
    assert quality.negative_volume(df, "v").count() == 1 and quality.missing_mandatory(df, ["v"]).count() == 1
    assert quality.schema_problems(df, {"k": "string", "t": "int", "p": "float", "q": "int"}, {"v"}) == ["undeclared column v", "missing column q", "column p is double, declared float"]


def test_store(spark, tmp_path):
    from tidemark.sources import store

    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    root = str(tmp_path / "root")
    one = store.write_dataset(df, root, "t")
    assert store.write_dataset(df.repartition(3).orderBy(F.desc("i")), root, "t") == one
    assert store.read_dataset(spark, root, "t").count() == 2
    store.write_dataset(df.where("i = 1"), root, "t")
    with pytest.raises(store.StoreError):
        store.read_dataset(spark, root, "t")
    df.limit(1).write.mode("append").parquet(f"{root}/t/{one}/data")
    with pytest.raises(store.StoreError):
        store.read_dataset(spark, root, "t", one)


def test_spells_and_successors(spark):
    rng = random.Random(2)
    path = [(k, t, rng.choice("abb")) for k in ("x", "y") for t in range(60) if rng.random() < 0.9]
    path[7] = (*path[7][:2], None)
    want, open_ = [], None
    for k, t, v in path:
        if open_ and open_[:2] == [k, v] and open_[3] == t - 1:
            open_[3] = t
            open_[4] += 1
        else:
            open_ = [k, v, t, t, 1]
            want.append(open_)
    got = quality.spells(spark.createDataFrame(path, "k string, t int, v string").repartition(3), ["k"], "t", "v").select("k", "v", "spell_start", "spell_end", "steps").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    ids = spark.createDataFrame([("id1", "AA", "N"), ("id2", "AA", "L")], "security_id string, ticker string, exchange string")
    recs = spark.createDataFrame([(1, "AA", "L"), (2, None, "L"), (3, "BB", "N"), (4, "AA", None)], "r int, next string, exchange string")
    found, lost = etl.successors(recs, ids, "ticker", "exchange", "next")
    assert {(r.r, r.successor_security_id) for r in found.collect()} == {(1, "id2"), (2, None)} and {r.r for r in lost.collect()} == {3, 4}


def test_target_families():
    good = targets.TargetFamily()
    assert good.problems() == []
    weekly = {"horizon": "4W", "grid": "weekly", "anchor": "WED"}
    assert targets.TargetFamily(**weekly, group="sector_region_residual", vol_window=52, vol_least=26, neutral_first=True).problems() == []
    for bad, count in (
        ({"horizon": "4W"}, 1), ({"horizon": "4W", "grid": "weekly"}, 1), ({"top": 0.5}, 1), ({"top": 0.0, "middle": 0.7}, 1), ({"group": "planet"}, 1),
        ({"vol_window": 52}, 2), ({**weekly, "vol_window": 52, "vol_least": 26, "group": "sector_region_residual"}, 1), ({"cell_rank": True}, 1), ({"group": "country_demeaned"}, 1),
        ({"mode": "t_plus_k"}, 1), ({"delay": 2}, 1), ({"mode": "next_open"}, 1), ({"basis": "open_to_close"}, 1), ({"embargo": -1.0, "lag_steps": -1}, 2),
    ):
        family = targets.TargetFamily(**bad)
        assert len(family.problems()) == count, bad
        with pytest.raises(targets.TargetError):
            family.check()
    assert targets.TargetFamily(mode="t_plus_k", delay=2).problems() == [] and targets.TargetFamily(mode="next_open", basis="open_to_open").problems() == []


def test_residual_labels(spark):
    """Residuals of cells, scaled by volatility in either order, ranked and cut, against plain Python."""
    rng = random.Random(6)
    rows = [("d", f"n{i:02d}", rng.choice("pq"), rng.uniform(-1, 1), rng.uniform(0.5, 2)) for i in range(31)]
    df = spark.createDataFrame(rows, "d string, k string, cell string, v double, vol double")
    for first in (True, False):
        f = targets.TargetFamily(horizon="1W", grid="weekly", anchor="FRI", group="sector_region_residual", vol_window=52, vol_least=2, neutral_first=first, top=0.25, middle=0.5, bottom=0.25)
        x = {k: (v, vol, cell) for _, k, cell, v, vol in rows}
        base = {k: v if first else v / vol for k, (v, vol, _) in x.items()}
        mean = {c: sum(base[k] for k in x if x[k][2] == c) / sum(x[k][2] == c for k in x) for c in "pq"}
        res = {k: (base[k] - mean[x[k][2]]) / (x[k][1] if first else 1) for k in x}
        rank = {k: i / 30 for i, k in enumerate(sorted(res, key=lambda k: (res[k], k)))}
        want = {k: 1 if r > 0.75 else -1 if r < 0.25 else None for k, r in rank.items()}
        assert {r.k: r.label for r in targets.labelled(df, f, ["d"], "v", "k").collect()} == want


def test_ensembles_and_traces(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.random(), rng.random(), rng.choice((-1, 1))) for p in range(6) for i in range(20)]
    frame = spark.createDataFrame(rows, "p int, i int, a double, b double, y int")
    chosen = lambda ps: spark.createDataFrame([(p,) for p in ps], "p int")
    models, dropped = model.train_ensemble(frame, {"late": chosen([4, 5]), "all": chosen(range(6)), "none": chosen([])}, "p", ["a", "b"], "y", 2, 3, save=materialised)
    assert dropped == [("none", "no period is selected")] and sorted(models) == ["all", "late"]
    alone = model.boost(frame.where("p >= 4"), ["a", "b"], "y", 2, 3, save=materialised)
    assert [(m["factor"], m["edges"]) for m in models["late"]] == [(m["factor"], m["edges"]) for m in alone]
    assert all(m["values"] == pytest.approx(n["values"]) for m, n in zip(models["late"], alone))
    long = model.expert_scores(frame, models, ["p", "i"])
    assert long.count() == 240 and {r[0] for r in long.select("component").distinct().collect()} == {"all", "late"}
    with pytest.raises(ValueError, match="9"):
        model.pooled(frame, chosen([5, 9]), "p")
    traces = []
    for df in (frame, frame.repartition(5), frame.where("i > 0")):
        trace: list[str] = []
        model.boost(df, ["a", "b"], "y", 1, 3, save=materialised, trace=trace)
        assert len(trace) == 1
        traces.append(trace[0].split(":")[0])
    assert traces == ["120", "120", "114"] and model.trace_hash(["x"]) == model.trace_hash(["x"]) != model.trace_hash(["y"])
    one = spark.createDataFrame([(0.25,), (0.5,), (0.25,)], "w double")
    assert model.weight_digest(one) == model.weight_digest(one.repartition(3).orderBy("w")) != model.weight_digest(one.where("w < 0.5"))


def test_variances_need_no_matrix_of_names_by_names():
    """A vector of variances gives the books of its diagonal matrix, in memory that follows the names."""
    import tracemalloc

    import numpy as np

    from tidemark.operators.portfolio import optimise

    rng = np.random.default_rng(3)

    def book(n, dense, **more):
        rng = np.random.default_rng(n)
        sector, alpha, var = rng.integers(0, 3, n), rng.normal(0, 0.1, n), rng.uniform(0.01, 0.09, n)
        rows = [("net", np.ones(n)), *((f"s{k}", (sector == k).astype(float)) for k in range(3))]
        return optimise(alpha, np.diag(var) if dense else var, np.full(n, -0.1), np.full(n, 0.1), rows, [(0.0, 0.0)] + [(-0.1, 0.1)] * 3, 2.0, 1.0, **more)

    for more in ({}, {"volatility": 0.05}, {"cost": 0.01, "borrow": 0.01, "held": rng.normal(0, 0.01, 60), "turnover": 0.5}):
        assert np.abs(book(60, True, **more) - book(60, False, **more)).max() < 1e-9
    tracemalloc.start()
    w = book(5_000, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(np.abs(w).sum() - 2) < 1e-3 and peak < 20e6


def test_covariances_pair_names_without_a_join(spark, monkeypatch):
    """Blocks of names against the join by date: names without common dates, nulls, repeated dates and names of several blocks."""
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import portfolio

    rng = random.Random(8)
    rows = [(d, n, rng.choice([None, rng.gauss(0, 1), rng.gauss(5, 1)])) for n in range(330) for d in range(12) if rng.random() < 0.3 for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(None, 1, 3.0), (1, None, 2.0), (2, None, 1.0), (3, None, 4.0)]
    df = spark.createDataFrame(rows, "d int, n long, r double")
    monkeypatch.setattr(portfolio, "CELLS", 5_000)
    out = portfolio.covariance(df, "d", "n", "r", 0.5)
    assert "MergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "HashJoin" not in plan
    got = {(x.a, x.b): x["cov"] for x in out.collect()}
    x, y = df.select("d", F.col("n").alias("a"), F.col("r").alias("x")), df.select("d", F.col("n").alias("b"), F.col("r").alias("y"))
    joined = x.join(y, "d").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    want = {(z.a, z.b): z.c if z.c is None or z.a is not None and z.a == z.b else z.c / 2 for z in joined.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    odd = spark.createDataFrame([(1, 1, 1.0), (2, 1, float("inf")), (3, 1, 2.0), (1, 2, 1.0), (3, 2, 5.0)], "d int, n long, r double")
    got = {(x.a, x.b): x["cov"] for x in portfolio.covariance(odd, "d", "n", "r").collect()}
    assert got[1, 1] != got[1, 1] and got[1, 2] == 2.0 and got[2, 2] == 8.0


def test_covariances_on_disk_follow_names_not_pairs(spark, monkeypatch):
    """Each name is written once, no copies are dealt out to pairs of blocks, and a pair's two rows come near each other."""
    import random

    import pyarrow as pa

    from pyspark.sql import functions as F

    from tidemark.operators import portfolio
    from tidemark.sources.store import materialised

    rng = random.Random(9)
    rows = [(d, f"n{n}", rng.gauss(0, 1)) for n in range(150) for d in range(n % 3, 9)] + [(5, None, 1.0), (6, None, 3.0)]
    df = spark.createDataFrame(rows, "d int, n string, r double")
    kept = []
    monkeypatch.setattr(portfolio, "materialised", lambda x: kept.append(materialised(x)) or kept[-1], raising=False)
    monkeypatch.setattr(portfolio, "NAMES", 7)
    monkeypatch.setattr(portfolio, "VALUES", 40, raising=False)
    out = portfolio.covariance(df, "d", "n", "r")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    blocks = [pa.ipc.open_stream(x.block).read_all() for x in kept[0].collect()]
    names = [x for b in blocks for x in b.column("name").to_pylist()]
    assert len(names) == len(set(names)) == 151 and max(b.num_rows for b in blocks) <= 7
    assert all(sum(map(len, b.column("rows").to_pylist())) <= 40 for b in blocks) and max(x.nbytes for x in blocks) < 3_000
    got = [(x.a, x.b, x["cov"]) for x in out.collect()]
    x, y = df.select("d", F.col("n").alias("a"), F.col("r").alias("x")), df.select("d", F.col("n").alias("b"), F.col("r").alias("y"))
    want = {(z.a, z.b): z.c for z in x.join(y, "d").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c")).collect()}
    assert len(got) == len(want) and all(abs(want[a, b] - c) < 1e-9 for a, b, c in got)
    at = {(a, b): k for k, (a, b, _) in enumerate(got)}
    assert max(abs(at[a, b] - at[b, a]) for a, b in at) < 7 * 7
    none = portfolio.covariance(df.where("d is null"), "d", "n", "r")
    assert none.collect() == [] and none.dtypes == out.dtypes


def test_rounding_of_doubles_is_sparks(spark):
    import random

    from pyspark.sql import functions as F

    from tidemark.functions.finite import rounded

    rng = random.Random(10)
    rows = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-12, 20) for _ in range(20_000)]
    rows += [s * (k + 0.5 + e) / 1e8 for k in range(2_000) for s in (1, -1) for e in (0.0, 1e-9, -1e-9, 2e-4, -2e-4)]
    rows += [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), -1e-10, 1.5e-8, 5e-324, 1.7e308]
    df = spark.createDataFrame([(x,) for x in rows], "x double").select("x", rounded(F.col("x"), 8).alias("a"), F.round("x", 8).alias("b"))
    assert [repr(x) for x in df.collect() if repr(x.a) != repr(x.b)] == []
