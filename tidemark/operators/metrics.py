"""Statistics of signals and portfolios. Degenerate groups go to a ledger, never to NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xsec
from ..functions.finite import covered, ratio


def correlation(x: str, y: str) -> Column:
    """Pearson from moments; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic_series(df: DataFrame, by: list[str], score: str, outcome: str, rank: bool = True, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(by, names, ic of each date; ledger of dates without one)."""
    both = df.where(covered(F.col(score)) & covered(F.col(outcome)))
    x, y = score, outcome
    if rank:
        both = xsec.midrank(xsec.midrank(both, by, score, "_x"), by, outcome, "_y")
        x, y = "_x", "_y"
    g = both.groupBy(*by).agg(F.count(F.lit(1)).alias("names"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), correlation(x, y).alias("ic"))
    reason = F.when(F.col("names") < least, "too_few_names").when((F.col("_sx") == 0) | (F.col("_sy") == 0), "degenerate")
    g = g.withColumn("reason", reason).drop("_sx", "_sy")
    return g.where("reason is null").drop("reason"), g.where("reason is not null").drop("ic")


def newey_west(series: DataFrame, order: str, v: str, lags: int) -> DataFrame:
    """n, mean, se: Bartlett-weighted standard error of the mean of one series. One row a period, so one task."""
    w = Window.orderBy(order)
    every = Window.partitionBy()
    d = series.select(order, F.col(v).alias("_v"), (F.col(v) - F.avg(v).over(every)).alias("_d"), F.count(F.lit(1)).over(every).alias("n"))
    sums = [F.sum(F.col("_d") * F.col("_d"))]
    lagged = d
    for k in range(1, lags + 1):
        lagged = lagged.withColumn(f"_l{k}", F.lag("_d", k).over(w))
        used = F.least(F.lit(lags), F.col("n") - 1)
        lagged = lagged.withColumn(f"_w{k}", F.when(F.lit(k) <= used, 1 - F.lit(float(k)) / (used + 1)).otherwise(0.0))
        sums.append(2 * F.sum(F.coalesce(F.col("_d") * F.col(f"_l{k}"), F.lit(0.0)) * F.col(f"_w{k}")))
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    n = F.max("n")
    return lagged.agg(n.alias("n"), F.avg("_v").alias("mean"), F.sqrt(F.greatest(total / n, F.lit(0.0)) / n).alias("se"))


def ic_summary(series: DataFrame, order: str, v: str, lags: int) -> DataFrame:
    """n, mean, sd, ratio, hit_rate, se, t of an IC series."""
    base = series.agg(F.stddev_samp(v).alias("sd"), F.avg((F.col(v) > 0).cast("double")).alias("hit_rate"))
    return newey_west(series, order, v, lags).crossJoin(base).select("n", "mean", "sd", ratio(F.col("mean"), F.col("sd")).alias("risk_adjusted"), "hit_rate", "se", ratio(F.col("mean"), F.col("se")).alias("t"))


def quantile_spread(df: DataFrame, by: list[str], score: str, outcome: str, key: str, k: int) -> DataFrame:
    """fractile, mean outcome: averaged within dates, then over dates."""
    f = xsec.fractile(df.where(covered(F.col(outcome))), by, score, key, k)
    daily = f.groupBy(*by, "fractile").agg(F.avg(outcome).alias("_m"))
    return daily.groupBy("fractile").agg(F.avg("_m").alias("mean_outcome"), F.count(F.lit(1)).alias("dates"))


def lagged_pairs(df: DataFrame, date_idx: str, key: str, x: str, y: str, k: int) -> DataFrame:
    """x at a date against y k dates later, over names in both."""
    a = df.select(F.col(date_idx).alias("d"), key, F.col(x).alias("x"))
    b = df.select((F.col(date_idx) - k).alias("d"), key, F.col(y).alias("y"))
    return a.join(b, ["d", key])


def tail_value(df: DataFrame, by: list[str], v: str, alpha: float) -> DataFrame:
    """by, value_at_risk (the ceil(alpha n)-th smallest value), expected_shortfall (mean of values up to it)."""
    place = xsec.ordinal(df, by, v, v, "_k").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    var = place.where(F.col("_k") == F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(alpha)))).select(*by, F.col(v).alias("value_at_risk"))
    return df.join(var, by).where(F.col(v) <= F.col("value_at_risk")).groupBy(*by, "value_at_risk").agg(F.avg(v).alias("expected_shortfall"))


def growth(r: str) -> Column:
    return F.product(1 + F.col(r))


def summary(df: DataFrame, by: list[str], r: str, per_year: int, rf: float = 0.0) -> DataFrame:
    """total, annualised, vol, sharpe, sortino of a return series."""
    excess = F.col(r) - rf
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    g = df.groupBy(*by).agg(F.count(r).alias("n"), growth(r).alias("_g"), F.stddev_samp(r).alias("_sd"), F.avg(excess).alias("_m"), down.alias("_d"))
    year = F.sqrt(F.lit(float(per_year)))
    return g.select(
        *by,
        "n",
        (F.col("_g") - 1).alias("total"),
        (F.when(F.col("_g") > 0, F.pow("_g", per_year / F.col("n"))) - 1).alias("annualised"),
        (F.col("_sd") * year).alias("vol"),
        (ratio(F.col("_m"), F.col("_sd")) * year).alias("sharpe"),
        (ratio(F.col("_m"), F.col("_d")) * year).alias("sortino"),
    )


def drawdown(df: DataFrame, by: list[str], order: str, nav: str) -> DataFrame:
    """max_drawdown: the largest fall from the running peak."""
    peak = F.max(nav).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_dd", 1 - F.col(nav) / peak).groupBy(*by).agg(F.max("_dd").alias("max_drawdown"))


def beta(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.covar_pop(y, x), F.var_pop(x)).alias("beta"))


def by_bucket(df: DataFrame, bucket: str, r: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("vol"), (growth(r) - 1).alias("cumulative"))


def group_exposure(weights: DataFrame, groups: DataFrame, by: list[str], name: str, group: str, w: str) -> DataFrame:
    """Gross and net by group, names without one under UNMAPPED."""
    j = weights.join(groups, name, "left").withColumn(group, F.coalesce(group, F.lit("UNMAPPED")))
    return j.groupBy(*by, group).agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))


def turnover(weights: DataFrame, date_idx: str, name: str, w: str) -> DataFrame:
    """One-way turnover of each date against the one before: half the sum of |change| over the union of names."""
    now = weights.select(F.col(date_idx).alias("d"), name, F.col(w).alias("_w1"))
    then = weights.select((F.col(date_idx) + 1).alias("d"), name, F.col(w).alias("_w0"))
    dates = weights.select(F.col(date_idx).alias("d")).distinct()
    j = now.join(then, ["d", name], "full_outer").join(dates, "d", "left_semi")
    return j.groupBy("d").agg((F.sum(F.abs(F.coalesce("_w1", F.lit(0.0)) - F.coalesce("_w0", F.lit(0.0)))) / 2).alias("one_way"))


def exposure(weights: DataFrame, by: list[str], w: str) -> DataFrame:
    return weights.groupBy(*by).agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))


def stability(sets: DataFrame, date_idx: str, name: str) -> DataFrame:
    """Jaccard index of each date's names with those of the date before."""
    now = sets.select(F.col(date_idx).alias("d"), name).distinct()
    sizes = now.groupBy("d").agg(F.count(name).alias("_n"))
    dates = sizes.select("d", "_n", F.lag("d").over(Window.orderBy("d")).alias("_before"), F.lag("_n").over(Window.orderBy("d")).alias("_m")).where("_before is not null")
    # names that are in both dates: joined by date and name, never gathered
    then = now.select(F.col("d").alias("_before"), name)
    common = now.join(dates, "d").join(then, ["_before", name], "left_semi").groupBy("d").agg(F.count(F.lit(1)).alias("_c"))
    c = F.coalesce("_c", F.lit(0))
    return dates.join(common, "d", "left").select("d", ratio(c, F.col("_n") + F.col("_m") - c).alias("jaccard"))


def break_even_bps(df: DataFrame, gross: str, one_way: str) -> DataFrame:
    return df.agg((ratio(F.sum(gross), 2 * F.sum(one_way)) * 10_000).alias("break_even_bps"))


def multiplicity(p: float, n: int) -> dict[str, float]:
    """Bonferroni and Sidak adjusted p, and the expected best t of n tries."""
    import math

    return {"bonferroni": min(1.0, p * n), "sidak": 1 - (1 - p) ** n, "expected_max_t": math.sqrt(2 * math.log(n)) if n > 1 else 0.0}


def block_bootstrap(series: DataFrame, order: str, v: str, block: int, draws: int, seed: int) -> DataFrame:
    """draw, mean: circular block resamples of one ordered series; draws run in parallel, each from its own seeded stream."""
    spark = series.sparkSession
    values = series.orderBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, v))), lambda x: x[v]).alias("xs"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for d, xs in zip(b["draw"], b["xs"]):
                x, rng = np.asarray(xs, float), np.random.Generator(np.random.PCG64([seed, int(d)]))
                starts = rng.integers(0, len(x), -(-len(x) // block))
                at = (starts[:, None] + np.arange(block)).ravel()[: len(x)] % len(x)
                out.append(float(x[at].mean()))
            yield pd.DataFrame({"draw": b["draw"], "mean": out})

    return spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(values)).mapInPandas(run, "draw long, mean double")


def coverage_status(universe: DataFrame, predicted: DataFrame, unscored: DataFrame, skipped: DataFrame, keys: list[str]) -> DataFrame:
    """Each universe row as predicted, unscored, skipped or unaccounted."""
    out = universe
    for name, df in (("predicted", predicted), ("unscored", unscored), ("skipped", skipped)):
        out = out.join(df.select(*keys).distinct().withColumn(f"_{name}", F.lit(True)), keys, "left")
    status = F.when(F.col("_predicted"), "predicted").when(F.col("_unscored"), "unscored").when(F.col("_skipped"), "skipped").otherwise("unaccounted")
    return out.withColumn("status", status).drop("_predicted", "_unscored", "_skipped")


def leakage_audit(panel: DataFrame, by: list[str], feature: str, key: str, v: str, outcome: str, threshold: float, least: int = 3) -> DataFrame:
    """feature, mean_abs_ic, flagged: mean |ordinal rank correlation| over dates with enough pairs."""
    both = panel.where(covered(F.col(v)) & covered(F.col(outcome)))
    g = xsec.ordinal(xsec.ordinal(both, [*by, feature], v, key, "_x"), [*by, feature], outcome, key, "_y")
    daily = g.groupBy(*by, feature).agg(F.count(F.lit(1)).alias("_n"), correlation("_x", "_y").alias("_ic")).where(F.col("_n") >= least)
    return daily.groupBy(feature).agg(F.avg(F.abs("_ic")).alias("mean_abs_ic")).withColumn("flagged", F.col("mean_abs_ic") > threshold)


def latest_fit(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One prediction a name and target: that of the latest fit."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def scoring_panel(predictions: DataFrame, outcomes: DataFrame, keys: list[str], complete: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions of the latest fit with their outcomes; ledger of incomplete windows and missing outcomes)."""
    j = latest_fit(predictions, keys, order).join(outcomes, keys, "left")
    reason = F.when(~F.coalesce(F.col(complete), F.lit(False)), "incomplete_window").when(F.col("outcome").isNull(), "missing_outcome")
    j = j.withColumn("reason", reason)
    return j.where("reason is null").drop("reason"), j.where("reason is not null")


def contribution(weights: DataFrame, returns: DataFrame, groups: DataFrame, name: str, order: str, group: str, terminal: str) -> DataFrame:
    """Each group's sum of weight times compounded return; a name stops compounding after its terminal period."""
    ended = F.max(F.col(terminal).cast("int")).over(Window.partitionBy(name).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    live = returns.withColumn("_e", F.coalesce(ended, F.lit(0))).where("_e = 0")
    grown = live.groupBy(name).agg((F.product(1 + F.col("ret")) - 1).alias("_g"))
    j = weights.join(grown, name).join(groups, name, "left").withColumn(group, F.coalesce(group, F.lit("UNMAPPED")))
    return j.groupBy(group).agg(F.sum(F.col("weight") * F.col("_g")).alias("contribution"))


def capacity(df: DataFrame, by: list[str], adv: str, one_way: str, cap: float) -> DataFrame:
    """The least of cap * adv / one-way turnover over periods that trade."""
    return df.where(F.col(one_way) > 0).groupBy(*by).agg(F.min(cap * F.col(adv) / F.col(one_way)).alias("capacity"))


def configurations(trials: DataFrame, columns: list[str]) -> DataFrame:
    """Trials and distinct configurations tried."""
    return trials.agg(F.count(F.lit(1)).alias("trials"), F.count_distinct(F.struct(*columns)).alias("distinct_configurations"))


def sensitivity(results: DataFrame, setting: str, value: str, base: str) -> DataFrame:
    """Each setting's difference from the base one, and over all the worst and the spread."""
    b = results.where(F.col(setting) == base).agg(F.first(value).alias("_b"))
    every = Window.partitionBy()
    out = results.crossJoin(F.broadcast(b)).withColumn("delta", F.col(value) - F.col("_b")).drop("_b")
    return out.withColumn("worst", F.min("delta").over(every)).withColumn("spread", F.max(value).over(every) - F.min(value).over(every))


def chain_breaks(ledger: DataFrame, by: list[str], order: str, tolerance: float) -> DataFrame:
    """Periods that do not start at the value where the one before ended."""
    ahead = F.lead("nav_start").over(Window.partitionBy(*by).orderBy(order))
    return ledger.withColumn("_n", ahead).where(F.col("_n").isNotNull() & (F.abs(F.col("_n") - F.col("nav_end")) > tolerance)).drop("_n")


def effect_steps(stages: DataFrame, stage_order: str, value: str) -> DataFrame:
    """Telescoping effects: each stage's value less the one before; they add up to the last less the first."""
    return stages.withColumn("effect", F.col(value) - F.lag(value).over(Window.orderBy(stage_order)))
