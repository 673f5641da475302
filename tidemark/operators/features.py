"""The feature library: point-in-time features over daily bars and vintaged facts.

Every feature is computed for all (day, security) pairs of a grid in one job,
by as-of joins rather than by one query a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finite import covered, ratio
from .pit import asof_join, last_on_or_before

#: Fixed values of the library: windows and ages in days.
MONTH, YEAR, STALE, STALE_MONTHLY, QUARTER = 30, 365, 20, 40, 91
BOOK_AGE, BOOK_LAG = 540, 90
VOL_DAYS, VOL_LEAST, ADV_DAYS, ADV_LEAST = 60, 10, 20, 5


def close_asof(bars: DataFrame, grid: DataFrame, by: str, event: str, day: str, value: str, back: int, stale: int, out: str) -> DataFrame:
    """The last value at or before day - back, if not older than stale days then."""
    g = grid.withColumn("_day", F.date_sub(F.col(day), back))
    j = last_on_or_before(bars.select(by, event, value), g, [by], event, "_day", value, stale)
    return j.withColumnRenamed(value, out).drop("_day", "observed")


def price_change(bars: DataFrame, grid: DataFrame, by: str, event: str, day: str, value: str, near: int, far: int, stale: int, out: str) -> DataFrame:
    """value(day - near) / value(day - far) - 1 for a positive base."""
    g = close_asof(bars, grid, by, event, day, value, near, stale, "_near")
    g = close_asof(bars, g, by, event, day, value, far, stale, "_far")
    return g.withColumn(out, F.when(F.col("_far") > 0, F.col("_near") / F.col("_far") - 1)).drop("_near", "_far")


def momentum_12_1(bars, grid, by, event, day, value="close", stale=STALE):
    return price_change(bars, grid, by, event, day, value, MONTH, YEAR, stale, "momentum_12_1")


def reversal_1m(bars, grid, by, event, day, value="close", stale=STALE):
    return price_change(bars, grid, by, event, day, value, 0, MONTH, stale, "reversal_1m")


def size_neg_log_mcap(bars, grid, by, event, day, value="market_cap", stale=STALE):
    g = close_asof(bars, grid, by, event, day, value, 0, stale, "_cap")
    return g.withColumn("size_neg_log_mcap", F.when(F.col("_cap") > 0, -F.log("_cap"))).drop("_cap")


def fact_asof(facts: DataFrame, grid: DataFrame, by: str, day: str, metric: str, back: int, age: int, lag: int, out: str) -> DataFrame:
    """The latest known vintage of a metric's latest period not older than `age` days, `lag` days after publication."""
    import datetime as dt

    f = facts.where(F.col("metric") == metric).select(by, "knowledge_time", "period_end", "vintage_seq", F.col("value").alias(out))
    g = grid.withColumn("_at", F.date_sub(F.col(day), back).cast("timestamp_ntz"))
    # the running maximum over (period, vintage) among what is known: later knowledge of an older period must not win
    w = Window.partitionBy(by).orderBy("knowledge_time", "period_end", "vintage_seq").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("period_end", "knowledge_time", "vintage_seq", out)).over(w)
    f = f.select(by, "knowledge_time", F.col("period_end").alias("_pe"), F.col("vintage_seq").alias("_vs"), best.alias("_best"))
    j = asof_join(g, f, [by], "_at", "knowledge_time", ["_pe", "_vs"], lag=dt.timedelta(days=lag), known_as="_known")
    young = F.datediff(F.col("_at").cast("date"), F.col("_best.period_end")) <= age
    return j.withColumn(out, F.when(young, F.col(f"_best.{out}"))).drop("_at", "_known", "_pe", "_vs", "_best")


def book_to_price(bars, facts, grid, by, event, day):
    g = fact_asof(facts, grid, by, day, "BOOK_VALUE", 0, BOOK_AGE, BOOK_LAG, "_book")
    g = close_asof(bars, g, by, event, day, "market_cap", 0, STALE, "_cap")
    return g.withColumn("book_to_price", F.when(F.col("_cap") > 0, F.col("_book") / F.col("_cap"))).drop("_book", "_cap")


def earnings_yield(bars, facts, grid, by, event, day):
    g = fact_asof(facts, grid, by, day, "EPS_WAD", 0, BOOK_AGE, BOOK_LAG, "_eps")
    g = close_asof(bars, g, by, event, day, "close", 0, STALE, "_close")
    return g.withColumn("earnings_yield", F.when(F.col("_close") > 0, F.col("_eps") / F.col("_close"))).drop("_eps", "_close")


def eps_revision_3m(estimates, grid, by, day):
    """(now - as of a quarter ago) / |then|; missing where then is 0."""
    far = 100_000
    g = fact_asof(estimates, grid, by, day, "EPS", 0, far, 0, "_now")
    g = fact_asof(estimates, g, by, day, "EPS", QUARTER, far, 0, "_then")
    return g.withColumn("eps_revision_3m", F.when(F.col("_then") != 0, (F.col("_now") - F.col("_then")) / F.abs("_then"))).drop("_now", "_then")


def windowed(bars: DataFrame, grid: DataFrame, by: str, event: str, day: str, days: int) -> DataFrame:
    """Bars within [day - days, day] of each grid row. Joins by buckets of `days`, so a bar meets two buckets at most."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1))
    g = grid.select(by, day).distinct().withColumn("_b", F.explode(F.array(bucket(F.col(day)), bucket(F.col(day)) - 1)))
    b = bars.withColumn("_b", bucket(F.col(event)))
    return g.join(b, [by, "_b"]).where(F.col(event).between(F.date_sub(F.col(day), days), F.col(day))).drop("_b")


def volatility_60d(bars, grid, by, event, day, value="close"):
    """Sample deviation of the returns between bars inside the window, from ten returns on."""
    w = Window.partitionBy(by, day).orderBy(event)
    r = windowed(bars.select(by, event, value), grid, by, event, day, VOL_DAYS)
    before = F.lag(value).over(w)
    r = r.withColumn("_r", F.when(before > 0, F.col(value) / before - 1))
    out = r.groupBy(by, day).agg(F.count("_r").alias("_n"), F.stddev_samp("_r").alias("volatility_60d")).where(F.col("_n") >= VOL_LEAST)
    return grid.join(out.drop("_n"), [by, day], "left")


def adv_dollar_20d(bars, grid, by, event, day, value="close", volume="volume"):
    """Mean of value * volume inside the window, from five bars on."""
    r = windowed(bars.select(by, event, value, volume), grid, by, event, day, ADV_DAYS)
    out = r.groupBy(by, day).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(value) * F.col(volume)).alias("adv_dollar_20d")).where(F.col("_n") >= ADV_LEAST)
    return grid.join(out.drop("_n"), [by, day], "left")


def asset_growth_1y(facts: DataFrame, by: str) -> DataFrame:
    """Each period against the latest one 330 to 400 days before it."""
    f = facts.where(F.col("metric") == "TOTAL_ASSETS").select(by, "period_end", "value", "knowledge_time")
    day = F.datediff("period_end", F.lit("1970-01-01").cast("date"))
    year_ago = Window.partitionBy(by).orderBy("_day").rangeBetween(-400, -330)
    g = f.withColumn("_day", day).withColumns({"_seen": F.count(F.lit(1)).over(year_ago), "_v": F.max_by("value", "period_end").over(year_ago)})
    g = g.where("_seen > 0").select(by, "period_end", "value", "knowledge_time", "_v").distinct()
    return g.withColumn("asset_growth_1y", ratio(F.col("value"), F.col("_v")) - 1).drop("_v")


class Registry:
    """Named feature kernels: DataFrame in, one value column out."""

    def __init__(self) -> None:
        self._kernels: dict[str, Callable] = {}
        self._lists: dict[str, list[str]] = {}

    def register(self, name: str, kernel: Callable) -> None:
        if name in self._kernels:
            raise ValueError(f"feature {name} is registered already")
        self._kernels[name] = kernel

    def define_list(self, name: str, features: list[str]) -> None:
        unknown = [f for f in features if f not in self._kernels]
        if unknown:
            raise ValueError(f"unknown features {unknown}")
        self._lists[name] = list(features)

    def resolve(self, name: str) -> list[str]:
        return self._lists[name]

    def compute(self, name: str, *args, **kwargs) -> DataFrame:
        return self._kernels[name](*args, **kwargs)

    def registry_hash(self) -> str:
        import hashlib

        return hashlib.sha256("\n".join(sorted(self._kernels)).encode()).hexdigest()


REGISTRY = Registry()
for _f in (momentum_12_1, reversal_1m, size_neg_log_mcap, book_to_price, earnings_yield, eps_revision_3m, volatility_60d, adv_dollar_20d, asset_growth_1y):
    REGISTRY.register(_f.__name__, _f)


def coverage(panel: DataFrame, by: list[str], v: str, least: float) -> DataFrame:
    """covered / requested for each group, and whether that is enough."""
    n = F.sum(covered(F.col(v)).cast("int"))
    out = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("requested"), n.alias("covered"))
    return out.withColumn("coverage", ratio(F.col("covered"), F.col("requested"))).withColumn("eligible", F.coalesce(F.col("coverage") >= least, F.lit(False)))


def eligible_everywhere(cov: DataFrame, feature: str) -> DataFrame:
    """Features that are eligible on every date."""
    return cov.groupBy(feature).agg(F.bool_and("eligible").alias("eligible")).where("eligible").select(feature)


def long_panel(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value: one row for each feature."""
    return wide.unpivot(keys, features, "feature", "value")


def stamped_in_time(panel: DataFrame, stamp: str, as_of: Column) -> DataFrame:
    """Rows whose knowledge lies after as_of: must be none."""
    return panel.where(F.col(stamp) > as_of)
