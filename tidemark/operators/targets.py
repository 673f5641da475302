"""Forward returns, labels and the ledger of what has none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xsec

from .pit import exchange_rate, step_lookup

#: How an execution mode shifts the day, and the price it starts at.
MODES = {"same_close": (0, "close"), "one_day_lag": (1, "close"), "next_open": (1, "open")}
HORIZONS = {"1M": ("month_end", 1), "3M": ("month_end", 3), "1W": ("weekly", 1), "4W": ("weekly", 4)}


#: The groups a return is compared in, the fields a basis is measured from and to, and weekdays.
GROUPS = ("universe", "neutralization_cell", "country_demeaned", "sector_region_residual")
BASES = {"close_to_close": ("close", "close"), "open_to_close": ("open", "close"), "open_to_open": ("open", "open")}
ANCHORS = ("MON", "TUE", "WED", "THU", "FRI")


class TargetError(ValueError):
    """A family of targets that contradicts itself."""


@dataclass(frozen=True)
class TargetFamily:
    """What a label is measured on, and how; `problems` names every contradiction, not only the first."""

    horizon: str = "1M"
    grid: str = "month_end"
    anchor: str | None = None
    group: str = "universe"
    demean: str | None = None  # equal or cap, for country_demeaned
    vol_window: int | None = None  # weeks; none: not scaled
    vol_least: int | None = None
    neutral_first: bool | None = None
    cell_rank: bool = False
    top: float = 0.3
    middle: float = 0.4
    bottom: float = 0.3
    mode: str = "same_close"
    delay: int | None = None  # days, for t_plus_k
    basis: str = "close_to_close"
    embargo: float = 1.0
    lag_steps: int | None = None

    def problems(self) -> list[str]:
        out = []
        if HORIZONS.get(self.horizon, ("",))[0] != self.grid:
            out.append(f"horizon {self.horizon} does not belong to grid {self.grid}")
        if self.grid == "weekly" and self.anchor not in ANCHORS:
            out.append("a weekly grid needs its weekday")
        if abs(self.top + self.middle + self.bottom - 1) > 1e-9:
            out.append("label shares do not add up to 1")
        if not (0 < self.top < 1 and 0 < self.bottom < 1):
            out.append("top and bottom shares lie between 0 and 1")
        if self.group not in GROUPS:
            out.append(f"unknown comparison group {self.group}")
        if self.vol_window is not None and self.grid != "weekly":
            out.append("only weekly targets are scaled by weekly volatility")
        if self.vol_window is not None and (self.vol_least is None or self.vol_least < 2):
            out.append("volatility needs a least history of two weeks or more")
        if self.vol_window is not None and self.group == "sector_region_residual" and self.neutral_first is None:
            out.append("scaling and neutralising need an order")
        if self.cell_rank and self.group != "neutralization_cell":
            out.append("ranks within cells need cells")
        if self.group == "country_demeaned" and self.demean not in ("equal", "cap"):
            out.append("country means are equal- or cap-weighted")
        if self.mode not in (*MODES, "t_plus_k"):
            out.append(f"unknown execution mode {self.mode}")
        if (self.mode == "t_plus_k") != (self.delay is not None and self.delay >= 1):
            out.append("a delay of a day or more belongs to t_plus_k, and to it alone")
        if self.basis not in BASES:
            out.append(f"unknown return basis {self.basis}")
        elif BASES[self.basis][0] != MODES.get(self.mode, (0, "close"))[1]:
            out.append("a return is measured from the price at which the mode executes")
        if self.embargo < 0:
            out.append("an embargo is not negative")
        if self.lag_steps is not None and self.lag_steps < 0:
            out.append("a training lag is not negative")
        return out

    def check(self) -> None:
        if found := self.problems():
            raise TargetError("; ".join(found))


def labelled(df: DataFrame, family: TargetFamily, by: list[str], v: str, key: str, cell: str = "cell", cap: str = "cap", vol: str = "vol", out: str = "label") -> DataFrame:
    """Labels of a cross-section by the family's comparison group; `transformed` is the value they were cut from.

    universe: shares of all names of a date. neutralization_cell: of each cell.
    country_demeaned: of returns less their cell's mean. sector_region_residual:
    strict thresholds on the percent rank of (volatility-scaled) residuals.
    """
    family.check()
    cut = lambda d, where, x: xsec.quantile_labels(d, where, x, key, family.bottom, family.top, out)
    if family.group == "universe":
        return cut(df.withColumn("transformed", F.col(v)), by, "transformed")
    if family.group == "neutralization_cell":
        df = df.where(F.col(cell).isNotNull())
        made = xsec.pctrank(df, [*by, cell], v, key, "transformed") if family.cell_rank else df.withColumn("transformed", F.col(v))
        return cut(made, [*by, cell], v)
    if family.group == "country_demeaned":
        return cut(xsec.demean(df, [*by, cell], v, cap if family.demean == "cap" else None, "transformed"), by, "transformed")
    if family.vol_window is not None:
        df = scaled_and_demeaned(df, [*by, cell], v, vol, bool(family.neutral_first), "_residual")
    else:
        df = xsec.demean(df, [*by, cell], v, None, "_residual")
    ranked = xsec.pctrank(df, by, "_residual", key, "transformed").drop("_residual")
    return xsec.threshold_labels(ranked, "transformed", family.bottom, 1 - family.top, out)


def point_timing(grid: DataFrame, days: DataFrame, day: str, horizon: int, shift: int) -> DataFrame:
    """idx, decision, start_day, end_day, holding_end of each grid point; `complete` is false past the calendar's end."""
    line = Window.orderBy(day)
    g = grid.select(F.col(day).alias("decision"), F.lead(day, horizon).over(line).alias("_end"), F.lead(day, 1).over(line).alias("_next"), (F.row_number().over(line) - 1).alias("idx"))
    ahead = days.select(F.col(day).alias("_d"), (F.lead(day, shift).over(line) if shift else F.col(day)).alias("_s"))
    for source, out in (("decision", "start_day"), ("_end", "end_day"), ("_next", "holding_end")):
        g = g.join(ahead.select(F.col("_d").alias(source), F.col("_s").alias(out)), source, "left")
    complete = F.col("start_day").isNotNull() & F.col("end_day").isNotNull() & F.col("holding_end").isNotNull()
    return g.select("idx", "decision", "start_day", "end_day", "holding_end", complete.alias("complete"))


def measured_price(df: DataFrame, prices: DataFrame, factors: DataFrame, by: str, day: str, field: str, factor: str) -> DataFrame:
    """Raw price on a day times the adjustment factor in force."""
    p = prices.select(by, F.col("event_date").alias(day), F.col(field).alias("_raw"))
    j = df.join(p, [by, day], "left")
    return step_lookup(j, factors, [by], day, "event_date", factor).withColumn("price", F.col("_raw") * F.col(factor)).drop("_raw", factor)


def forward_returns(points: DataFrame, prices: DataFrame, factors: DataFrame, terminals: DataFrame, by: str, field: str = "close", factor: str = "total_return_factor_cum", fx: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """points: row_id, by, start_day, end_day. Adds ret, delisted and reason.

    end / start - 1 on adjusted prices; with a terminal event in (start, end]:
    (last / start)(1 + terminal return) - 1, last being the last price up to it.
    """
    from .pit import first_event_in, last_day_in

    t = terminals.select(by, "effective_date", "terminal_return")
    j = first_event_in(points, t, [by], "row_id", "start_day", "end_day", "effective_date")
    j = j.withColumn("_through", F.coalesce(F.col("first_event.effective_date"), F.col("end_day")))
    j = last_day_in(j, prices.where(F.col(field).isNotNull()).select(by, "event_date"), [by], "row_id", "start_day", "_through", "event_date")
    delisted = F.col("first_event").isNotNull()
    j = j.withColumn("delisted", delisted).withColumn("_close_day", F.when(delisted, F.col("last_day")).otherwise(F.col("end_day")))
    # both days of a point on one time line, priced in one pass
    ends = F.array(F.struct(F.lit(0).alias("w"), F.col("start_day").alias("d")), F.struct(F.lit(1).alias("w"), F.col("_close_day").alias("d")))
    both = j.select("row_id", by, F.explode(ends).alias("x")).select("row_id", by, F.col("x.w").alias("_w"), F.col("x.d").alias("_d"))
    both = measured_price(both, prices, factors, by, "_d", field, factor)
    priced = both.groupBy("row_id").agg(*[F.max(F.when(F.col("_w") == k, F.col("price"))).alias(f"_p{k}") for k in (0, 1)])
    j = j.join(priced, "row_id", "left")
    if fx is not None:
        for day, p in (("start_day", "_p0"), ("_close_day", "_p1")):
            j = exchange_rate(j.withColumn("_to", F.lit(base)), fx, day, "currency", "_to").withColumn(p, F.col(p) * F.col("rate")).withColumn(f"{p}_fx", F.col("rate")).drop("rate", "_to")
    else:
        j = j.withColumn("_p0_fx", F.lit(1.0)).withColumn("_p1_fx", F.lit(1.0))
    plain = F.col("_p1") / F.col("_p0")
    gross = F.when(F.col("delisted"), plain * (1 + F.col("first_event.terminal_return"))).otherwise(plain)
    reason = F.when(F.col("_p0_fx").isNull() | F.col("_p1_fx").isNull(), "fx_missing").when(F.col("_p0").isNull() | (F.col("_p0") <= 0), "missing_start_price").when(F.col("_p1").isNull(), "missing_end_price")
    out = j.withColumn("reason", reason).withColumn("ret", F.when(F.col("reason").isNull(), gross - 1))
    return out.drop("_p0", "_p1", "_p0_fx", "_p1_fx", "_through", "_close_day", "last_day", "first_event")


def weekly_vol(weekly: DataFrame, by: str, idx: str, close: str, window: int, least: int) -> DataFrame:
    """Deviation of up to `window` weekly returns ending at idx; null under max(least, 2) returns."""
    w = Window.partitionBy(by).orderBy(idx)
    before, before_idx = F.lag(close).over(w), F.lag(idx).over(w)
    r = weekly.withColumn("_r", F.when((before_idx == F.col(idx) - 1) & (before > 0), F.col(close) / before - 1))
    span = Window.partitionBy(by).orderBy(idx).rangeBetween(-(window - 1), 0)
    n, sd = F.count("_r").over(span), F.stddev_samp("_r").over(span)
    reason = F.when(n < max(least, 2), "vol_min_history_insufficient").when(sd <= 0, "vol_degenerate")
    return r.withColumn("vol", sd).withColumn("reason", reason).withColumn("vol", F.when(F.col("reason").isNull(), F.col("vol"))).drop("_r")


def scaled_and_demeaned(df: DataFrame, by: list[str], v: str, vol: str, neutral_first: bool, out: str = "target") -> DataFrame:
    """Group demeaning and volatility scaling, in either order."""
    w = Window.partitionBy(*by)
    if neutral_first:
        return df.withColumn(out, (F.col(v) - F.avg(v).over(w)) / F.col(vol))
    s = F.col(v) / F.col(vol)
    return df.withColumn("_s", s).withColumn(out, F.col("_s") - F.avg("_s").over(w)).drop("_s")


def point_reason(points: DataFrame, build_as_of, build_index: int, lag: int, stride: int = 1) -> DataFrame:
    """Adds reason by precedence: calendar_exhausted, unrealized_window, training_lag_excluded, overlap_purged."""
    reason = (
        F.when(~F.col("complete"), "calendar_exhausted")
        .when(F.col("end_day") > build_as_of, "unrealized_window")
        .when(F.col("idx") + lag > build_index, "training_lag_excluded")
        .when(F.col("idx") % stride != 0, "overlap_purged")
    )
    return points.withColumn("reason", reason)


def split_ledger(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(kept, ledger of the rest): nothing is dropped silently."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
