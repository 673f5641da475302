"""The accounting ledger: a recurrence over periods, one group a book.

Each period trades from drifted to target positions, pays costs, drifts through
its marks, pays out terminated names, pays borrow, and checks its return on a
second path. Books are independent and run in parallel; a task streams over a
book's rows in period order and holds one period and the positions, never the
history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

RESIDUAL = 1e-10
SCHEMA = "book string, period int, nav_start double, trade_gross double, one_way double, cost double, gross_pnl double, borrow double, nav_end double, ret double, residual double, cash double"


class LedgerError(ValueError):
    """A period that cannot be accounted for."""


def run_period(nav_cash: float, held: dict[str, float], banned: set[str], weights: dict[str, float], steps: list[tuple[dict[str, float], set[str]]], cost: Callable[[dict[str, float]], float], borrow: Callable[[dict[str, float]], float]):
    """(row, cash, positions) of one period. steps: (return by name, names terminated) for each mark."""
    nav0 = nav_cash + sum(held.values())
    if nav0 <= 0:
        raise LedgerError("net asset value is not positive")
    again = banned & {k for k, w in weights.items() if w}
    if again:
        raise LedgerError(f"terminated names come back: {sorted(again)}")
    target = {k: w * nav0 for k, w in weights.items() if w}
    trades = {k: target.get(k, 0.0) - held.get(k, 0.0) for k in sorted(target.keys() | held.keys())}
    trades = {k: t for k, t in trades.items() if t}
    charged = cost(trades)
    if not charged >= 0:
        raise LedgerError("a cost is negative or undefined")
    cash = nav_cash - sum(trades.values()) - charged
    position, factor, gross = dict(target), {k: 1.0 for k in target}, 0.0
    for returns, gone in steps:
        for k in sorted(position):
            r = returns.get(k)
            if r is None or r != r or r < -1:
                raise LedgerError(f"no usable return for held name {k}")
            gross += position[k] * r
            position[k] *= 1 + r
            factor[k] *= 1 + r
        for k in sorted(gone & position.keys()):
            cash += position.pop(k)
            banned.add(k)
    fee = borrow(position)
    if not fee >= 0:
        raise LedgerError("a borrow charge is negative or undefined")
    cash -= fee
    nav1 = cash + sum(position.values())
    ret = (gross - charged - fee) / nav0
    second = sum(w * (factor[k] - 1) for k, w in weights.items() if w) - (charged + fee) / nav0
    residual = max(abs(ret - second), abs(nav1 - nav0 - (gross - charged - fee)) / nav0)
    if residual > RESIDUAL:
        raise LedgerError(f"the two return paths differ by {residual:.3g}")
    row = {"nav_start": nav0, "trade_gross": sum(map(abs, trades.values())), "one_way": sum(abs(t) for t in trades.values()) / nav0 / 2, "cost": charged, "gross_pnl": gross, "borrow": fee, "nav_end": nav1, "ret": ret, "residual": residual, "cash": cash}
    return row, cash, position


def run_ledger(targets: DataFrame, marks: DataFrame, cost_bps: float = 0.0, borrow_bps: float = 0.0, nav: float = 1000.0, days_per_period: float = 30.0) -> DataFrame:
    """targets: book, period, name, weight. marks: book, period, step, name, ret, terminated.

    Linear costs on traded notional and borrow on short positions, in basis points.
    """
    t = targets.selectExpr("book", "period", "-1 as step", "name", "cast(weight as double) as x", "false as terminated")
    m = marks.selectExpr("book", "period", "step", "name", "cast(ret as double) as x", "terminated")

    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import pandas as pd

        book, cash, held, banned = None, nav, {}, set()

        def account(g):
            nonlocal book, cash, held, banned
            if g["book"].iloc[0] != book:
                book, cash, held, banned = g["book"].iloc[0], nav, {}, set()
            weights = dict(zip(g.loc[g.step == -1, "name"], g.loc[g.step == -1, "x"]))
            steps = [(dict(zip(s["name"], s["x"])), set(s.loc[s["terminated"], "name"])) for _, s in g[g.step >= 0].groupby("step", sort=True)]
            cost = lambda trades: cost_bps * 1e-4 * sum(map(abs, trades.values()))
            borrow = lambda p: borrow_bps * 1e-4 * -sum(v for v in p.values() if v < 0) * days_per_period / 365
            row, cash, held = run_period(cash, held, banned, weights, steps, cost, borrow)
            return {"book": book, "period": int(g["period"].iloc[0])} | row

        open_rows = None  # of the last book and period, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            both = batch if open_rows is None else pd.concat([open_rows, batch], ignore_index=True)
            new = (both["book"] != both["book"].shift()) | (both["period"] != both["period"].shift())
            starts = new.to_numpy().nonzero()[0].tolist()
            open_rows = both.iloc[starts[-1] :]
            if len(starts) > 1:
                yield pd.DataFrame([account(both.iloc[a:b]) for a, b in zip(starts, starts[1:])], columns=names)
        if open_rows is not None:
            yield pd.DataFrame([account(open_rows)], columns=names)

    return t.unionByName(m).repartition("book").sortWithinPartitions("book", "period", "step", "name").mapInPandas(run, SCHEMA)
