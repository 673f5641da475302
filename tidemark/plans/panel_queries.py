"""Cross-sectional, feature, target and metric queries over the supplier panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import xsec
from ..functions.finite import r6
from ..operators import calendar, features, metrics, targets
from .base import DAILY, MONTHLY, RETURNS, SECTORS, Book, daily, month_returns, monthly, sectors, table
from .pit_queries import _GRID, last_seen_sql, month_grid

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.add(f"WITH {MONTHLY} SELECT m, security_id, round(row_number() OVER (PARTITION BY m ORDER BY close DESC, security_id) / count(*) OVER (PARTITION BY m), 6) AS rank FROM monthly")
def xsec_rank(spark, sf):
    return xsec.rank_normalize(monthly(spark, sf), ["m"], "close", "security_id").select("m", "security_id", r6(F.col("rank")).alias("rank"))


_COARSE = f"WITH {MONTHLY}, coarse AS (SELECT m, security_id, floor(close / 50) AS v FROM monthly)"


def _coarse(spark, sf):
    return monthly(spark, sf).select("m", "security_id", F.floor(F.col("close") / 50).cast("double").alias("v"))


@book.add(f"{_COARSE} SELECT m, security_id, round((rank() OVER (PARTITION BY m ORDER BY v DESC) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0) / count(*) OVER (PARTITION BY m), 6) AS rank FROM coarse")
def xsec_rank_avg(spark, sf):
    return xsec.rank_normalize(_coarse(spark, sf), ["m"], "v", "security_id", average=True).select("m", "security_id", r6(F.col("rank")).alias("rank"))


@book.add(f"{_COARSE} SELECT m, security_id, rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2.0 AS midrank FROM coarse")
def xsec_midranks(spark, sf):
    return xsec.midrank(_coarse(spark, sf), ["m"], "v", "midrank").select("m", "security_id", F.col("midrank").cast("double").alias("midrank"))


@book.add(f"WITH {MONTHLY}, {SECTORS} SELECT m, security_id, sector, round(row_number() OVER (PARTITION BY m, sector ORDER BY close DESC, security_id) / count(*) OVER (PARTITION BY m, sector), 6) AS rank FROM monthly JOIN sectors USING (security_id)")
def xsec_rank_by_cell(spark, sf):
    df = monthly(spark, sf).join(sectors(spark, sf), "security_id")
    return xsec.rank_normalize_by_cell(df, ["m"], "sector", "close", "security_id").select("m", "security_id", "sector", r6(F.col("rank")).alias("rank"))


@book.add(f"WITH {MONTHLY} SELECT m, security_id, round(CASE WHEN stddev_pop(close) OVER w <= max(abs(close)) OVER w * count(*) OVER w * 2.220446049250313e-16 THEN 0.0 ELSE (close - avg(close) OVER w) / stddev_pop(close) OVER w END, 6) + 0.0 AS z FROM monthly WINDOW w AS (PARTITION BY m)")
def xsec_zscore(spark, sf):
    return xsec.zscore(monthly(spark, sf), ["m"], "close").select("m", "security_id", r6(F.col("z")).alias("z"))


@book.add(f"""WITH {MONTHLY}, x AS (SELECT m, security_id, close, CASE WHEN security_id % 2 = 0 THEN close END AS own FROM monthly)
 SELECT m, security_id, round((close - avg(own) OVER w) / stddev_pop(own) OVER w, 6) + 0.0 AS z FROM x WINDOW w AS (PARTITION BY m)""")
def xsec_zscore_universe(spark, sf):
    df = monthly(spark, sf).withColumn("inside", F.col("security_id") % 2 == 0)
    return xsec.zscore_with_universe(df, ["m"], "close", "inside").select("m", "security_id", r6(F.col("z")).alias("z"))


@book.add(f"WITH {MONTHLY}, q AS (SELECT m, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM monthly GROUP BY m) SELECT m, security_id, round(greatest(least(close, hi), lo), 9) AS w FROM monthly JOIN q USING (m)")
def xsec_winsorize(spark, sf):
    return xsec.winsorize(monthly(spark, sf), ["m"], "close", 0.05, 0.95).select("m", "security_id", F.round("w", 9).alias("w"))


@book.add(f"WITH {MONTHLY} SELECT m, security_id, round(CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY m ORDER BY close, security_id) - 1) / (count(*) OVER w - 1) END, 6) AS pct FROM monthly WINDOW w AS (PARTITION BY m)")
def xsec_pctrank(spark, sf):
    return xsec.pctrank(monthly(spark, sf), ["m"], "close", "security_id").select("m", "security_id", r6(F.col("pct")).alias("pct"))


@book.add(f"""WITH {MONTHLY}, k AS (SELECT m, security_id, row_number() OVER (PARTITION BY m ORDER BY close, security_id) AS k, count(*) OVER (PARTITION BY m) AS n FROM monthly)
 SELECT m, security_id, CASE WHEN k <= floor(n * 0.3) THEN -1 WHEN k > n - least(floor(n * 0.3), n - floor(n * 0.3)) THEN 1 END AS label FROM k""")
def quantile_labels(spark, sf):
    return xsec.quantile_labels(monthly(spark, sf), ["m"], "close", "security_id", 0.3, 0.3).select("m", "security_id", "label")


@book.add(f"WITH {RETURNS} SELECT m, security_id, CASE WHEN fwd > 0.05 THEN 1 WHEN fwd < -0.05 THEN -1 END AS label FROM rets")
def threshold_labels(spark, sf):
    return xsec.threshold_labels(month_returns(spark, sf), "fwd", -0.05, 0.05).select("m", "security_id", "label")


_FRACTILE = "CAST(floor((row_number() OVER (PARTITION BY m ORDER BY close, security_id) - 1) * 5 / count(*) OVER (PARTITION BY m)) AS INTEGER)"


@book.add(f"WITH {MONTHLY}, f AS (SELECT m, security_id, {_FRACTILE} AS fractile, count(*) OVER (PARTITION BY m) AS n FROM monthly) SELECT m, security_id, fractile FROM f WHERE n >= 5")
def fractile_assign(spark, sf):
    return xsec.fractile(monthly(spark, sf), ["m"], "close", "security_id", 5).select("m", "security_id", "fractile")


@book.add(f"WITH {MONTHLY}, f AS (SELECT m, security_id, {_FRACTILE} AS fractile, count(*) OVER (PARTITION BY m) AS n FROM monthly) SELECT m, security_id, CASE fractile WHEN 0 THEN -1 ELSE 1 END AS leg FROM f WHERE n >= 5 AND fractile IN (0, 4)")
def top_bottom(spark, sf):
    return xsec.top_bottom(monthly(spark, sf), ["m"], "close", "security_id", 5).select("m", "security_id", "leg")


@book.add(f"WITH {RETURNS}, {SECTORS} SELECT m, security_id, round(fwd - avg(fwd) OVER (PARTITION BY m, sector), 6) + 0.0 AS demeaned FROM rets JOIN sectors USING (security_id) WHERE fwd IS NOT NULL")
def group_demean(spark, sf):
    df = month_returns(spark, sf).where("fwd is not null").join(sectors(spark, sf), "security_id")
    return xsec.demean(df, ["m", "sector"], "fwd").select("m", "security_id", r6(F.col("demeaned")).alias("demeaned"))


@book.add(f"WITH {RETURNS} SELECT m, security_id, round(fwd - sum(market_cap * fwd) OVER (PARTITION BY m) / sum(market_cap) OVER (PARTITION BY m), 6) + 0.0 AS demeaned FROM rets WHERE fwd IS NOT NULL")
def cap_weighted_demean(spark, sf):
    return xsec.demean(month_returns(spark, sf).where("fwd is not null"), ["m"], "fwd", "market_cap").select("m", "security_id", r6(F.col("demeaned")).alias("demeaned"))


@book.add(f"WITH {RETURNS}, s AS (SELECT m, security_id, fwd, past, regr_slope(fwd, past) OVER w AS b, avg(fwd) OVER w AS my, avg(past) OVER w AS mx, var_pop(past) OVER w AS v FROM rets WHERE fwd IS NOT NULL AND past IS NOT NULL WINDOW w AS (PARTITION BY m)) SELECT m, security_id, round(fwd - my - CASE WHEN v <= 0 THEN 0.0 ELSE b END * (past - mx), 6) + 0.0 AS residual FROM s")
def ols_residual(spark, sf):
    df = month_returns(spark, sf).where("fwd is not null and past is not null")
    return xsec.residual(df, ["m"], "fwd", "past").select("m", "security_id", r6(F.col("residual")).alias("residual"))


# -- features --------------------------------------------------------------------


def _change_sql(near: int, far: int, stale: int, out: str) -> str:
    return f"""WITH {DAILY}, {_GRID} SELECT g.security_id, g.day, round(CASE WHEN b.c > 0 THEN a.c / b.c - 1 END, 6) + 0.0 AS {out} FROM grid g
 LEFT JOIN {last_seen_sql('close', near, stale, 'c')} a USING (security_id, day) LEFT JOIN {last_seen_sql('close', far, stale, 'c')} b USING (security_id, day)"""


def _feature(f, spark, sf, *more, **kw):
    bars = daily(spark, sf)
    name = f.__name__
    return f(bars, month_grid(bars), "security_id", "event_date", "day", *more, **kw).select("security_id", "day", r6(F.col(name)).alias(name))


@book.add(_change_sql(30, 365, 20, "momentum_12_1"))
def feat_momentum(spark, sf):
    return _feature(features.momentum_12_1, spark, sf)


@book.add(_change_sql(0, 30, 20, "reversal_1m"))
def feat_reversal(spark, sf):
    return _feature(features.reversal_1m, spark, sf)


@book.add(_change_sql(0, 30, 40, "reversal_1m"))
def feat_reversal_monthly(spark, sf):
    return _feature(features.reversal_1m, spark, sf, stale=features.STALE_MONTHLY)


@book.add(f"WITH {DAILY}, {_GRID} SELECT g.security_id, g.day, round(CASE WHEN a.c > 0 THEN -ln(a.c) END, 6) + 0.0 AS size_neg_log_mcap FROM grid g LEFT JOIN {last_seen_sql('market_cap', 0, 20, 'c')} a USING (security_id, day)")
def feat_size(spark, sf):
    return _feature(features.size_neg_log_mcap, spark, sf)


@book.add(f"""WITH {DAILY}, {_GRID}, win AS (SELECT g.security_id, g.day, d.event_date, d.close, lag(d.close) OVER (PARTITION BY g.security_id, g.day ORDER BY d.event_date) AS before
 FROM grid g JOIN daily d ON g.security_id = d.security_id AND d.event_date BETWEEN g.day - INTERVAL 60 DAY AND g.day),
 v AS (SELECT security_id, day, count(close / before) AS n, stddev_samp(close / before - 1) AS sd FROM win WHERE before > 0 GROUP BY 1, 2)
 SELECT g.security_id, g.day, round(CASE WHEN n >= 10 THEN sd END, 6) + 0.0 AS volatility_60d FROM grid g LEFT JOIN v USING (security_id, day)""")
def feat_volatility_60d(spark, sf):
    return _feature(features.volatility_60d, spark, sf)


@book.add(f"""WITH {DAILY}, {_GRID}, v AS (SELECT g.security_id, g.day, count(*) AS n, avg(d.close * d.volume) AS a FROM grid g JOIN daily d ON g.security_id = d.security_id AND d.event_date BETWEEN g.day - INTERVAL 20 DAY AND g.day GROUP BY 1, 2)
 SELECT g.security_id, g.day, round(CASE WHEN n >= 5 THEN a END, 6) + 0.0 AS adv_dollar_20d FROM grid g LEFT JOIN v USING (security_id, day)""")
def feat_adv_20d(spark, sf):
    return _feature(features.adv_dollar_20d, spark, sf)


def _quarter_facts(spark, sf, metric: str):
    """Quarterly supplier facts: period end, known 30 days later."""
    q = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("period_end")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100).alias("value"))
    return q.select("security_id", "period_end", "value", F.date_add("period_end", 30).cast("timestamp_ntz").alias("knowledge_time"), F.lit(0).cast("long").alias("vintage_seq"), F.lit(metric).alias("metric"))


_FACT = "qf AS (SELECT l_suppkey AS security_id, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100 AS value FROM lineitem GROUP BY 1, 2)"


def _fact_sql(lag: int, age: int, back: int = 0) -> str:
    return f"""(SELECT security_id, day, CASE WHEN date_diff('day', pe, day - INTERVAL {back} DAY) <= {age} THEN v END AS f FROM (SELECT g.security_id, g.day, q.value AS v, q.period_end AS pe, row_number() OVER (PARTITION BY g.security_id, g.day ORDER BY q.period_end DESC) AS k
 FROM grid g JOIN qf q ON g.security_id = q.security_id AND q.period_end + INTERVAL {30 + lag} DAY <= g.day - INTERVAL {back} DAY) WHERE k = 1)"""


@book.add(f"WITH {DAILY}, {_GRID}, {_FACT} SELECT g.security_id, g.day, round(CASE WHEN c.c > 0 THEN b.f / c.c END, 6) + 0.0 AS book_to_price FROM grid g LEFT JOIN {_fact_sql(90, 540)} b USING (security_id, day) LEFT JOIN {last_seen_sql('market_cap', 0, 20, 'c')} c USING (security_id, day)")
def feat_book_to_price(spark, sf):
    bars = daily(spark, sf)
    g = features.book_to_price(bars, _quarter_facts(spark, sf, "BOOK_VALUE"), month_grid(bars), "security_id", "event_date", "day")
    return g.select("security_id", "day", r6(F.col("book_to_price")).alias("book_to_price"))


@book.add(f"WITH {DAILY}, {_GRID}, {_FACT} SELECT g.security_id, g.day, round(CASE WHEN c.c > 0 THEN b.f / c.c END, 6) + 0.0 AS earnings_yield FROM grid g LEFT JOIN {_fact_sql(90, 540)} b USING (security_id, day) LEFT JOIN {last_seen_sql('close', 0, 20, 'c')} c USING (security_id, day)")
def feat_earnings_yield(spark, sf):
    bars = daily(spark, sf)
    g = features.earnings_yield(bars, _quarter_facts(spark, sf, "EPS_WAD"), month_grid(bars), "security_id", "event_date", "day")
    return g.select("security_id", "day", r6(F.col("earnings_yield")).alias("earnings_yield"))


@book.add(f"WITH {DAILY}, {_GRID}, {_FACT} SELECT g.security_id, g.day, round(CASE WHEN b.f <> 0 THEN (a.f - b.f) / abs(b.f) END, 6) + 0.0 AS eps_revision_3m FROM grid g LEFT JOIN {_fact_sql(0, 100000)} a USING (security_id, day) LEFT JOIN {_fact_sql(0, 100000, 91)} b USING (security_id, day)")
def feat_eps_revision(spark, sf):
    bars = daily(spark, sf)
    g = features.eps_revision_3m(_quarter_facts(spark, sf, "EPS"), month_grid(bars), "security_id", "day")
    return g.select("security_id", "day", r6(F.col("eps_revision_3m")).alias("eps_revision_3m"))


@book.add(f"WITH {_FACT}, j AS (SELECT a.security_id, a.period_end, a.value, b.value AS old, row_number() OVER (PARTITION BY a.security_id, a.period_end ORDER BY b.period_end DESC) AS k FROM qf a JOIN qf b ON a.security_id = b.security_id AND date_diff('day', b.period_end, a.period_end) BETWEEN 330 AND 400) SELECT security_id, period_end, round(value / old - 1, 6) + 0.0 AS asset_growth_1y FROM j WHERE k = 1 AND old <> 0")
def feat_asset_growth(spark, sf):
    g = features.asset_growth_1y(_quarter_facts(spark, sf, "TOTAL_ASSETS"), "security_id")
    return g.where("asset_growth_1y is not null").select("security_id", "period_end", r6(F.col("asset_growth_1y")).alias("asset_growth_1y"))


def _wide(spark, sf):
    """m, security_id and three ranked features, null where missing."""
    ranked = xsec.rank_columns(month_returns(spark, sf), ["m"], {"reversal": "past", "size": "market_cap", "_volume": "volume"}, "security_id")
    return ranked.select("m", "security_id", "fwd", "reversal", "size", F.col("_volume").alias("volume"))


_RANKED = RETURNS + """, wide AS (SELECT m, security_id, fwd,
 CASE WHEN past IS NOT NULL THEN row_number() OVER (PARTITION BY m, past IS NULL ORDER BY past DESC, security_id) / count(*) OVER (PARTITION BY m, past IS NULL) END AS reversal,
 row_number() OVER (PARTITION BY m ORDER BY market_cap DESC, security_id) / count(*) OVER (PARTITION BY m) AS size,
 row_number() OVER (PARTITION BY m ORDER BY volume DESC, security_id) / count(*) OVER (PARTITION BY m) AS volume FROM rets)"""


@book.add(f"WITH {_RANKED}, l AS (SELECT m, security_id, 'reversal' AS feature, reversal AS value FROM wide UNION ALL SELECT m, security_id, 'size', size FROM wide UNION ALL SELECT m, security_id, 'volume', volume FROM wide), c AS (SELECT m, feature, count(value) / count(*) AS cov FROM l GROUP BY 1, 2), e AS (SELECT feature FROM c GROUP BY 1 HAVING bool_and(cov >= 0.5)) SELECT m, security_id, feature, round(value, 6) AS value FROM l WHERE feature IN (SELECT feature FROM e)")
def feature_panel(spark, sf):
    long = features.long_panel(_wide(spark, sf).drop("fwd"), ["m", "security_id"], ["reversal", "size", "volume"])
    ok = features.eligible_everywhere(features.coverage(long, ["m", "feature"], "value", 0.5), "feature")
    return long.join(F.broadcast(ok), "feature", "left_semi").select("m", "security_id", "feature", r6(F.col("value")).alias("value"))


# -- targets -----------------------------------------------------------------------


@book.add("""WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), n AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM days),
 g AS (SELECT max(day) AS d FROM days GROUP BY year(day), month(day)), p AS (SELECT d, lead(d, 3) OVER (ORDER BY d) AS e, lead(d) OVER (ORDER BY d) AS h, row_number() OVER (ORDER BY d) - 1 AS idx FROM g)
 SELECT CAST(idx AS INTEGER) AS idx, d AS decision, a.nxt AS start_day, b.nxt AS end_day, c.nxt AS holding_end, a.nxt IS NOT NULL AND b.nxt IS NOT NULL AND c.nxt IS NOT NULL AS complete
 FROM p LEFT JOIN n a ON a.day = d LEFT JOIN n b ON b.day = e LEFT JOIN n c ON c.day = h""")
def target_timing(spark, sf):
    days = calendar.trading_days(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")
    return targets.point_timing(calendar.month_ends(days, "day"), days, "day", 3, 1)


@book.add(f"WITH {RETURNS} SELECT security_id, m, round(fwd, 6) + 0.0 AS fwd_return, CASE WHEN fwd IS NULL THEN 'missing_end_price' END AS reason FROM rets")
def fwd_return(spark, sf):
    p = month_returns(spark, sf)
    return p.select("security_id", "m", r6(F.col("fwd")).alias("fwd_return"), F.when(F.col("fwd").isNull(), "missing_end_price").alias("reason"))


def _terminals(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 5 = 0")
    return s.select(F.col("s_suppkey").alias("security_id"), F.lit("2000-06-15").cast("date").alias("effective_date"), F.lit(-0.5).alias("terminal_return"))


@book.add(f"""WITH {DAILY}, pt AS (SELECT security_id, event_date AS start_day, lead(event_date, 5) OVER (PARTITION BY security_id ORDER BY event_date) AS end_day, close AS p0 FROM daily),
 t AS (SELECT *, security_id % 5 = 0 AND start_day < DATE '2000-06-15' AND end_day >= DATE '2000-06-15' AS delisted FROM pt WHERE end_day IS NOT NULL),
 e AS (SELECT t.security_id, t.start_day, t.delisted, t.p0, (SELECT max(d.event_date) FROM daily d WHERE d.security_id = t.security_id AND d.event_date BETWEEN t.start_day AND CASE WHEN t.delisted THEN DATE '2000-06-15' ELSE t.end_day END) AS last_day FROM t)
 SELECT e.security_id, e.start_day, e.delisted, round(CASE WHEN e.delisted THEN d.close / e.p0 * 0.5 ELSE d.close / e.p0 END - 1, 6) + 0.0 AS ret FROM e JOIN daily d ON d.security_id = e.security_id AND d.event_date = e.last_day""")
def fwd_return_delisting(spark, sf):
    from pyspark.sql import Window

    bars = daily(spark, sf).select("security_id", "event_date", "close")
    end = F.lead("event_date", 5).over(Window.partitionBy("security_id").orderBy("event_date"))
    points = bars.select("security_id", F.col("event_date").alias("start_day"), end.alias("end_day")).where("end_day is not null").withColumn("row_id", F.xxhash64("security_id", "start_day"))
    factors = bars.where("false").select("security_id", "event_date", F.lit(1.0).alias("total_return_factor_cum"))
    r = targets.forward_returns(points, bars, factors, _terminals(spark, sf), "security_id")
    return r.select("security_id", "start_day", "delisted", r6(F.col("ret")).alias("ret"))


@book.add(f"""WITH {RETURNS}, v AS (SELECT security_id, m, fwd, count(past) OVER w AS n, stddev_samp(past) OVER w AS sd FROM rets WINDOW w AS (PARTITION BY security_id ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
 SELECT security_id, m, round(CASE WHEN n >= 6 AND sd > 0 THEN sd END, 6) + 0.0 AS vol, CASE WHEN n < 6 THEN 'vol_min_history_insufficient' WHEN sd <= 0 THEN 'vol_degenerate' END AS reason FROM v""")
def rolling_vol(spark, sf):
    v = targets.weekly_vol(monthly(spark, sf), "security_id", "m", "close", 12, 6)
    return v.select("security_id", "m", r6(F.col("vol")).alias("vol"), "reason")


@book.add(f"""WITH {RETURNS}, {SECTORS}, v AS (SELECT security_id, m, fwd, count(past) OVER w AS n, stddev_samp(past) OVER w AS sd FROM rets WINDOW w AS (PARTITION BY security_id ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
 k AS (SELECT m, security_id, sector, fwd, sd FROM v JOIN sectors USING (security_id) WHERE n >= 6 AND sd > 0 AND fwd IS NOT NULL)
 SELECT m, security_id, round((fwd - avg(fwd) OVER w) / sd, 5) + 0.0 AS neutral_first, round(fwd / sd - avg(fwd / sd) OVER w, 5) + 0.0 AS scale_first FROM k WINDOW w AS (PARTITION BY m, sector)""")
def scaled_targets(spark, sf):
    v = targets.weekly_vol(month_returns(spark, sf), "security_id", "m", "close", 12, 6).where("vol is not null and fwd is not null")
    j = v.join(sectors(spark, sf), "security_id")
    j = targets.scaled_and_demeaned(j, ["m", "sector"], "fwd", "vol", True, "a")
    j = targets.scaled_and_demeaned(j, ["m", "sector"], "fwd", "vol", False, "b")
    return j.select("m", "security_id", F.round("a", 5).alias("neutral_first"), F.round("b", 5).alias("scale_first"))


# -- metrics -----------------------------------------------------------------------


def _scored(spark, sf):
    """m, security_id, score (reversal rank: losers high), fwd."""
    p = month_returns(spark, sf)
    return xsec.rank_normalize(p, ["m"], "past", "security_id", "score", highest_first=True)


_SCORED = RETURNS + ", scored AS (SELECT m, security_id, market_cap, close, fwd, row_number() OVER (PARTITION BY m ORDER BY past DESC, security_id) / count(*) OVER (PARTITION BY m) AS score FROM rets WHERE past IS NOT NULL)"
_PAIRS = _SCORED + ", pairs AS (SELECT m, security_id, score, fwd, rank() OVER (PARTITION BY m ORDER BY score) + (count(*) OVER (PARTITION BY m, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY m ORDER BY fwd) + (count(*) OVER (PARTITION BY m, fwd) - 1) / 2.0 AS y FROM scored WHERE fwd IS NOT NULL)"
_IC = _PAIRS + ", ic AS (SELECT m, count(*) AS names, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS ic FROM pairs GROUP BY m HAVING count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)"


@book.add(f"WITH {_IC} SELECT m, names, round(ic, 6) + 0.0 AS ic FROM ic")
def ic_spearman_reversal(spark, sf):
    series, _ = metrics.ic_series(_scored(spark, sf), ["m"], "score", "fwd")
    return series.select("m", "names", r6(F.col("ic")).alias("ic"))


@book.add(f"WITH {_SCORED} SELECT m, count(*) AS names, round(covar_pop(score, fwd) / (stddev_pop(score) * stddev_pop(fwd)), 6) + 0.0 AS ic FROM scored WHERE fwd IS NOT NULL GROUP BY m HAVING count(*) >= 2 AND stddev_pop(score) > 0 AND stddev_pop(fwd) > 0")
def ic_pearson(spark, sf):
    series, _ = metrics.ic_series(_scored(spark, sf), ["m"], "score", "fwd", rank=False)
    return series.select("m", "names", r6(F.col("ic")).alias("ic"))


@book.add(f"WITH {_PAIRS}, c AS (SELECT m, count(*) AS names FROM pairs GROUP BY m) SELECT m, names, 'too_few_names' AS reason FROM c WHERE names < 50")
def ic_ledger(spark, sf):
    _, ledger = metrics.ic_series(_scored(spark, sf), ["m"], "score", "fwd", least=50)
    return ledger.where("reason = 'too_few_names'").select("m", "names", "reason")


@book.add(f"""WITH {_IC}, d AS (SELECT m, ic, ic - avg(ic) OVER () AS d, count(*) OVER () AS n FROM ic),
 l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM d WINDOW w AS (ORDER BY m)),
 s AS (SELECT count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit, sqrt(greatest((sum(d*d) + 2*(0.75*sum(coalesce(d*d1,0)) + 0.5*sum(coalesce(d*d2,0)) + 0.25*sum(coalesce(d*d3,0)))) / count(*), 0) / count(*)) AS se FROM l)
 SELECT n, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(mean / sd, 6) + 0.0 AS risk_adjusted, round(hit, 6) AS hit_rate, round(se, 6) AS se, round(mean / se, 6) + 0.0 AS t FROM s""")
def ic_summary_nw(spark, sf):
    series, _ = metrics.ic_series(_scored(spark, sf), ["m"], "score", "fwd")
    s = metrics.ic_summary(series, "m", "ic", 3)
    return s.select("n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "risk_adjusted", "hit_rate", "se", "t")])


@book.add(f"""WITH {_SCORED}, f AS (SELECT m, fwd, CAST(floor((row_number() OVER (PARTITION BY m ORDER BY score, security_id) - 1) * 5 / count(*) OVER (PARTITION BY m)) AS INTEGER) AS fractile, count(*) OVER (PARTITION BY m) AS n FROM scored WHERE fwd IS NOT NULL),
 d AS (SELECT m, fractile, avg(fwd) AS a FROM f WHERE n >= 5 GROUP BY 1, 2) SELECT fractile, round(avg(a), 6) + 0.0 AS mean_outcome, count(*) AS dates FROM d GROUP BY 1""")
def quantile_spread(spark, sf):
    q = metrics.quantile_spread(_scored(spark, sf), ["m"], "score", "fwd", "security_id", 5)
    return q.select("fractile", r6(F.col("mean_outcome")).alias("mean_outcome"), "dates")


def _lag_sql(y: str, k: int) -> str:
    return f"""WITH {_SCORED}, p AS (SELECT a.m, a.security_id, a.score AS x, b.{y} AS y FROM scored a JOIN scored b ON a.security_id = b.security_id AND b.m = a.m + {k} WHERE b.{y} IS NOT NULL),
 r AS (SELECT m, rank() OVER (PARTITION BY m ORDER BY x) + (count(*) OVER (PARTITION BY m, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY m ORDER BY y) + (count(*) OVER (PARTITION BY m, y) - 1) / 2.0 AS y FROM p)
 SELECT m, count(*) AS names, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) + 0.0 AS ic FROM r GROUP BY m HAVING count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0"""


def _lagged(spark, sf, y: str, k: int):
    pairs = metrics.lagged_pairs(_scored(spark, sf), "m", "security_id", "score", y, k)
    series, _ = metrics.ic_series(pairs, ["d"], "x", "y")
    return series.select(F.col("d").alias("m"), "names", r6(F.col("ic")).alias("ic"))


@book.add(_lag_sql("score", 1))
def score_autocorr(spark, sf):
    return _lagged(spark, sf, "score", 1)


@book.add(_lag_sql("fwd", 3))
def ic_decay(spark, sf):
    return _lagged(spark, sf, "fwd", 3)


@book.add(f"""WITH {_SCORED}, {SECTORS}, c AS (SELECT m, security_id, fwd, avg(score) OVER (PARTITION BY m, sector) AS x FROM scored JOIN sectors USING (security_id))
 SELECT m, count(*) AS names, round(covar_pop(x, fwd) / (stddev_pop(x) * stddev_pop(fwd)), 5) + 0.0 AS ic FROM c WHERE fwd IS NOT NULL GROUP BY m HAVING count(*) >= 2 AND stddev_pop(x) > 1e-9 AND stddev_pop(fwd) > 0""")
def group_ic(spark, sf):
    from pyspark.sql import Window

    s = _scored(spark, sf).join(sectors(spark, sf), "security_id").withColumn("x", F.avg("score").over(Window.partitionBy("m", "sector")))
    flat = s.where("fwd is not null").groupBy("m").agg(F.stddev_pop("x").alias("sx")).where("sx > 1e-9")
    series, _ = metrics.ic_series(s.join(flat, "m", "left_semi"), ["m"], "x", "fwd", rank=False)
    return series.select("m", "names", F.round("ic", 5).alias("ic"))


_BOOK = RETURNS + """, mret AS (SELECT m, avg(fwd) AS r FROM rets WHERE fwd IS NOT NULL GROUP BY m)"""


def _market(spark, sf):
    return month_returns(spark, sf).where("fwd is not null").groupBy("m").agg(F.avg("fwd").alias("r"))


@book.add(f"WITH {_BOOK}, s AS (SELECT floor(m / 12) AS y, r FROM mret), g AS (SELECT CAST(y AS BIGINT) AS y, count(*) AS n, product(1 + r) AS g, stddev_samp(r) AS sd, avg(r) AS mu, sqrt(avg(pow(least(r, 0), 2))) AS dn FROM s GROUP BY 1) SELECT y, n, round(g - 1, 6) + 0.0 AS total, round(pow(g, 12.0 / n) - 1, 6) + 0.0 AS annualised, round(sd * sqrt(12), 6) AS vol, round(mu / sd * sqrt(12), 6) + 0.0 AS sharpe FROM g")
def portfolio_summary(spark, sf):
    s = metrics.summary(_market(spark, sf).withColumn("y", F.floor(F.col("m") / 12)), ["y"], "r", 12)
    return s.select(F.col("y").cast("long").alias("y"), "n", *[r6(F.col(c)).alias(c) for c in ("total", "annualised", "vol", "sharpe")])


@book.add(f"WITH {MONTHLY}, p AS (SELECT security_id, 1 - close / max(close) OVER (PARTITION BY security_id ORDER BY m) AS dd FROM monthly) SELECT security_id, round(max(dd), 6) AS max_drawdown FROM p GROUP BY 1")
def max_drawdown(spark, sf):
    return metrics.drawdown(monthly(spark, sf), ["security_id"], "m", "close").select("security_id", r6(F.col("max_drawdown")).alias("max_drawdown"))


@book.add(f"""WITH {RETURNS}, k AS (SELECT security_id, fwd, row_number() OVER (PARTITION BY security_id ORDER BY fwd) AS k, count(*) OVER (PARTITION BY security_id) AS n FROM rets WHERE fwd IS NOT NULL),
 v AS (SELECT security_id, fwd AS v FROM k WHERE k = greatest(1, ceil(n * 0.05))) SELECT security_id, round(v, 6) + 0.0 AS value_at_risk, round(avg(fwd), 6) + 0.0 AS expected_shortfall FROM k JOIN v USING (security_id) WHERE fwd <= v GROUP BY security_id, v""")
def tail_var_es(spark, sf):
    t = metrics.tail_value(month_returns(spark, sf).where("fwd is not null"), ["security_id"], "fwd", 0.05)
    return t.select("security_id", r6(F.col("value_at_risk")).alias("value_at_risk"), r6(F.col("expected_shortfall")).alias("expected_shortfall"))


@book.add(f"WITH {_BOOK} SELECT security_id, round(CASE WHEN var_pop(r) > 0 THEN covar_pop(fwd, r) / var_pop(r) END, 6) + 0.0 AS beta FROM rets JOIN mret USING (m) WHERE fwd IS NOT NULL GROUP BY security_id")
def beta(spark, sf):
    j = month_returns(spark, sf).where("fwd is not null").join(F.broadcast(_market(spark, sf)), "m")
    return metrics.beta(j, ["security_id"], "fwd", "r").select("security_id", r6(F.col("beta")).alias("beta"))


@book.add(f"WITH {_BOOK} SELECT CAST(m % 12 AS INTEGER) AS month_of_year, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) AS vol, round(product(1 + r) - 1, 6) + 0.0 AS cumulative FROM mret GROUP BY 1")
def bucketed_stats(spark, sf):
    b = metrics.by_bucket(_market(spark, sf).withColumn("month_of_year", (F.col("m") % 12).cast("int")), "month_of_year", "r")
    return b.select("month_of_year", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "vol", "cumulative")])


@book.add(f"WITH {_SCORED}, t AS (SELECT m, list(security_id) AS s FROM (SELECT m, security_id, row_number() OVER (PARTITION BY m ORDER BY score, security_id) AS k FROM scored) WHERE k <= 10 GROUP BY m), l AS (SELECT m, s, lag(s) OVER (ORDER BY m) AS b FROM t) SELECT m AS d, round(len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))), 6) AS jaccard FROM l WHERE b IS NOT NULL")
def set_stability(spark, sf):
    top = xsec.ordinal(_scored(spark, sf), ["m"], "score", "security_id", "k").where("k <= 10")
    return metrics.stability(top, "m", "security_id").select("d", r6(F.col("jaccard")).alias("jaccard"))


@book.add(f"""WITH {_RANKED}, l AS (SELECT m, security_id, fwd, 'reversal' AS feature, reversal AS value FROM wide UNION ALL SELECT m, security_id, fwd, 'size', size FROM wide UNION ALL SELECT m, security_id, fwd, 'volume', volume FROM wide),
 k AS (SELECT m, feature, row_number() OVER (PARTITION BY m, feature ORDER BY value, security_id) AS x, row_number() OVER (PARTITION BY m, feature ORDER BY fwd, security_id) AS y FROM l WHERE value IS NOT NULL AND fwd IS NOT NULL),
 d AS (SELECT m, feature, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 3) SELECT feature, round(avg(abs(ic)), 6) AS mean_abs_ic, avg(abs(ic)) > 0.3 AS flagged FROM d GROUP BY 1""")
def leakage_audit(spark, sf):
    wide = _wide(spark, sf)
    long = features.long_panel(wide, ["m", "security_id", "fwd"], ["reversal", "size", "volume"])
    a = metrics.leakage_audit(long, ["m"], "feature", "security_id", "value", "fwd", 0.3)
    return a.select("feature", r6(F.col("mean_abs_ic")).alias("mean_abs_ic"), "flagged")


@book.add(f"WITH {MONTHLY}, u AS (SELECT m, security_id FROM monthly), p AS (SELECT m, security_id, row_number() OVER (PARTITION BY m ORDER BY close, security_id) AS k FROM monthly) SELECT m, CASE WHEN k <= 50 THEN 'predicted' WHEN security_id % 3 = 0 THEN 'unscored' WHEN security_id % 3 = 1 THEN 'skipped' ELSE 'unaccounted' END AS status, count(*) AS n FROM p GROUP BY 1, 2")
def coverage_accounting(spark, sf):
    u = monthly(spark, sf)
    keys = ["m", "security_id"]
    predicted = xsec.ordinal(u, ["m"], "close", "security_id", "k").where("k <= 50")
    s = metrics.coverage_status(u.select(*keys), predicted, u.where("security_id % 3 = 0"), u.where("security_id % 3 = 1"), keys)
    return s.groupBy("m", "status").agg(F.count(F.lit(1)).alias("n"))


@book.add()
def bootstrap_ic(spark, sf):
    series, _ = metrics.ic_series(_scored(spark, sf), ["m"], "score", "fwd")
    return metrics.block_bootstrap(series, "m", "ic", 6, 200, 1729)
