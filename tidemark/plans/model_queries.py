"""Model, fold, portfolio, cost and ledger queries over the supplier panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xsec
from ..functions.finite import r6, rounded
from ..operators import costs, folds, ledger, metrics, model, portfolio
from .base import MONTHLY, RETURNS, SECTORS, Book, month_returns, monthly, sectors
from .panel_queries import _RANKED, _SCORED, _scored, _wide

book = Book()
QUERIES, SQL = book.queries, book.sql
FEATURES = ["reversal", "size", "volume"]


def _labelled(spark, sf) -> DataFrame:
    """m, security_id, ranks, label (+1/-1) of the names outside the middle 40 percent."""
    w = _wide(spark, sf)
    return xsec.quantile_labels(w.where("fwd is not null"), ["m"], "fwd", "security_id", 0.3, 0.3).where("label is not null")


_LABELLED = _RANKED + """, lk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY fwd, security_id) AS k, count(*) OVER (PARTITION BY m) AS n FROM wide WHERE fwd IS NOT NULL),
 labelled AS (SELECT m, security_id, reversal, size, volume, CASE WHEN k <= floor(n * 0.3) THEN -1 ELSE 1 END AS label FROM lk WHERE k <= floor(n * 0.3) OR k > n - least(floor(n * 0.3), n - floor(n * 0.3))),
 long AS (SELECT label, 'reversal' AS factor, reversal AS v, m, security_id FROM labelled UNION ALL SELECT label, 'size', size, m, security_id FROM labelled UNION ALL SELECT label, 'volume', volume, m, security_id FROM labelled)"""
_EDGES = _LABELLED + """, ek AS (SELECT factor, v, row_number() OVER (PARTITION BY factor ORDER BY v, m, security_id) AS k, count(*) OVER (PARTITION BY factor) AS n FROM long WHERE v IS NOT NULL),
 edges AS (SELECT factor, j, v AS edge FROM ek, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE k = ceil(j * n / 5.0))"""
_MASSES = _EDGES + """, binned AS (SELECT l.factor, l.label, CASE WHEN v IS NOT NULL THEN (SELECT count(*) FROM edges e WHERE e.factor = l.factor AND e.edge < l.v) END AS bin FROM long l),
 masses AS (SELECT factor, bin, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) / t.n AS w_plus, sum(CASE WHEN label = -1 THEN 1.0 ELSE 0 END) / t.n AS w_minus FROM binned, (SELECT count(*) AS n FROM labelled) t GROUP BY factor, bin, t.n)"""


def _long(spark, sf) -> DataFrame:
    l = _labelled(spark, sf)
    n = l.agg(F.count(F.lit(1)).alias("n"))
    long = l.drop("fwd").unpivot(["m", "security_id", "label"], FEATURES, "factor", "v")
    return long.crossJoin(F.broadcast(n)).withColumn("w", F.lit(1.0) / F.col("n"))


def _binned(spark, sf) -> DataFrame:
    long = _long(spark, sf)
    return model.binned(long, F.broadcast(model.equal_count_edges(long, "factor", "v", ["m", "security_id"], 5)), "factor", "v")


@book.add(f"WITH {_EDGES} SELECT factor, CAST(j AS INTEGER) AS j, round(edge, 6) AS edge FROM edges")
def bin_edges(spark, sf):
    e = model.equal_count_edges(_long(spark, sf), "factor", "v", ["m", "security_id"], 5)
    return e.select("factor", F.posexplode("edges").alias("p", "edge")).select("factor", (F.col("p") + 1).cast("int").alias("j"), r6(F.col("edge")).alias("edge"))


@book.add(f"WITH {_MASSES} SELECT factor, CAST(bin AS INTEGER) AS bin, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus FROM masses")
def bin_masses(spark, sf):
    m = model.bin_masses(_binned(spark, sf), "factor", "label", "w")
    return m.select("factor", F.col("bin").cast("int").alias("bin"), r6(F.col("w_plus")).alias("w_plus"), r6(F.col("w_minus")).alias("w_minus"))


@book.add(f"WITH {_MASSES} SELECT factor, CAST(bin AS INTEGER) AS bin, round(0.5 * ln((w_plus + 1.0 / n) / (w_minus + 1.0 / n)), 6) + 0.0 AS h FROM masses, (SELECT count(*) AS n FROM labelled) WHERE bin IS NOT NULL")
def bin_values(spark, sf):
    m = model.bin_masses(_binned(spark, sf), "factor", "label", "w").where("bin is not null")
    n = _labelled(spark, sf).agg((F.lit(1.0) / F.count(F.lit(1))).alias("eps"))
    return m.crossJoin(F.broadcast(n)).select("factor", F.col("bin").cast("int").alias("bin"), r6(model.bin_value(F.col("w_plus"), F.col("w_minus"), F.col("eps"))).alias("h"))


_Z = _MASSES + ", z AS (SELECT factor, sum(CASE WHEN bin IS NOT NULL THEN sqrt(w_plus * w_minus) ELSE 0 END) + sum(CASE WHEN bin IS NULL THEN w_plus + w_minus ELSE 0 END) / 2 AS z FROM masses GROUP BY 1)"


@book.add(f"WITH {_Z} SELECT factor, round(z, 6) AS z FROM z")
def z_scores(spark, sf):
    z = model.z_scores(model.bin_masses(_binned(spark, sf), "factor", "label", "w"), "factor")
    return z.select("factor", r6(F.col("z")).alias("z"))


@book.add(f"WITH {_Z} SELECT factor, round(z, 6) AS z FROM z ORDER BY z.z, factor LIMIT 1")
def z_select(spark, sf):
    z = model.z_scores(model.bin_masses(_binned(spark, sf), "factor", "label", "w"), "factor")
    best = model.least_z(z.withColumn("ord", F.col("factor")), "factor", "ord")
    return best.select("factor", r6(F.col("z")).alias("z"))


@book.add()
def boost_predict(spark, sf):
    """Trains on the labelled months before the last 12 and scores the rest."""
    from tidemark.sources.store import materialised

    l = _labelled(spark, sf)
    cut = l.agg(F.max("m")).first()[0] - 12
    fitted = model.boost(l.where(F.col("m") < cut), FEATURES, "label", 5, 5, save=materialised)
    return model.predict(_wide(spark, sf).where(F.col("m") >= cut), fitted).select("m", "security_id", r6(F.col("score")).alias("score"))


_PERIODS = MONTHLY + ", periods AS (SELECT DISTINCT m AS period_id, make_date(m // 12, m % 12 + 1, 1) AS label_date, last_day(make_date(m // 12, m % 12 + 1, 1)) AS target_end, (m * 7919) % 101 / 100.0 AS ic FROM monthly)"


def _periods(spark, sf):
    p = monthly(spark, sf).select(F.col("m").alias("period_id")).distinct()
    day = F.make_date(F.floor(F.col("period_id") / 12).cast("int"), F.col("period_id") % 12 + 1, F.lit(1))
    return p.withColumn("label_date", day).withColumn("target_end", F.last_day("label_date")).withColumn("ic", (F.col("period_id") * 7919) % 101 / 100.0)


FIT = "2000-05-15"


def _fit():
    return F.lit(FIT).cast("date")


@book.add(f"WITH {_PERIODS} SELECT period_id FROM periods WHERE target_end <= DATE '{FIT}' ORDER BY label_date DESC LIMIT 12")
def select_trailing(spark, sf):
    return model.select_trailing(_periods(spark, sf), _fit(), 12).select("period_id")


@book.add(f"WITH {_PERIODS}, s AS (SELECT period_id, dense_rank() OVER (ORDER BY year(label_date) DESC) AS k FROM periods WHERE target_end <= DATE '{FIT}' AND month(label_date) = 3) SELECT period_id FROM s WHERE k BETWEEN 2 AND 4")
def select_seasonal(spark, sf):
    return model.select_seasonal(_periods(spark, sf), _fit(), 3, 3, 1).select("period_id")


@book.add(f"WITH {_PERIODS}, r AS (SELECT * FROM periods WHERE target_end <= DATE '{FIT}' ORDER BY label_date DESC LIMIT 25), k AS (SELECT period_id, row_number() OVER (ORDER BY ic, period_id) AS k, count(*) OVER () AS n FROM r) SELECT period_id FROM k WHERE k <= n // 2")
def select_hedge(spark, sf):
    return model.select_hedge(_periods(spark, sf), _fit(), "ic", 25).select("period_id")


_HIST = _PERIODS + ", hist AS (SELECT c AS component, label_date, target_end, ic - c / 4.0 AS ic FROM periods, (SELECT unnest([0, 1, 2]) AS c))"


@book.add(f"WITH {_HIST}, a AS (SELECT component, greatest(avg(ic), 0) AS w FROM hist WHERE target_end < DATE '{FIT}' AND month(label_date) = 6 GROUP BY 1) SELECT component, round(w / sum(w) OVER (), 6) AS weight FROM a")
def seasonal_weights(spark, sf):
    c = spark.range(3).select(F.col("id").cast("int").alias("component"))
    h = _periods(spark, sf).crossJoin(F.broadcast(c)).withColumn("ic", F.col("ic") - F.col("component") / 4.0)
    w = model.seasonal_weights(c, h, "component", _fit(), 6, 0.0, 2)
    return w.select("component", r6(F.col("weight")).alias("weight"))


@book.add(f"""WITH {_RANKED}, l AS (SELECT m, security_id, 'reversal' AS c, reversal AS v, 0.5 AS w FROM wide UNION ALL SELECT m, security_id, 'size', size, 0.3 FROM wide UNION ALL SELECT m, security_id, 'volume', volume, 0.2 FROM wide),
 z AS (SELECT m, security_id, w * CASE WHEN stddev_pop(v) OVER p <= max(abs(v)) OVER p * count(*) OVER p * 2.220446049250313e-16 THEN 0 ELSE (v - avg(v) OVER p) / stddev_pop(v) OVER p END AS s FROM l WHERE v IS NOT NULL WINDOW p AS (PARTITION BY m, c))
 SELECT m, security_id, round(sum(s), 6) + 0.0 AS score FROM z GROUP BY 1, 2 HAVING count(*) = 3""")
def combine_scores(spark, sf):
    long = _wide(spark, sf).drop("fwd").unpivot(["m", "security_id"], FEATURES, "component", "v")
    w = spark.createDataFrame([("reversal", 0.5), ("size", 0.3), ("volume", 0.2)], "component string, weight double")
    return model.combine(long, w, ["m"], "component", "security_id", "v").select("m", "security_id", r6(F.col("score")).alias("score"))


# -- folds -----------------------------------------------------------------------

RULE = folds.FoldRule(train_steps=36, test_steps=12, expanding=True, purge=True, embargo=1.0)


@book.add(f"""WITH {_PERIODS}, d AS (SELECT label_date AS decision, row_number() OVER (ORDER BY label_date) - 1 AS i, count(*) OVER () AS n FROM periods),
 r AS (SELECT decision, i, decision AS target_start, CAST(decision + INTERVAL 92 DAY AS DATE) AS target_end FROM d),
 f AS (SELECT k AS fold_id, (SELECT min(decision) FROM d) AS a, (SELECT decision FROM d WHERE i = 35 + 12 * k) AS b, (SELECT decision FROM d WHERE i = 36 + 12 * k) AS t0, (SELECT decision FROM d WHERE i = 47 + 12 * k) AS t1 FROM range(0, 100) x(k) WHERE 48 + 12 * k <= (SELECT max(n) FROM d))
 SELECT CAST(fold_id AS INTEGER) AS fold_id, decision, CASE WHEN decision NOT BETWEEN a AND b THEN 'out_of_range' WHEN target_end > b THEN 'unrealized' WHEN target_end > t0 AND target_start < t1 THEN 'purged'
  WHEN target_end > t1 AND date_diff('day', t1, target_start) < date_diff('day', target_start, target_end) THEN 'embargoed' END AS reason FROM r, f""")
def fold_selection(spark, sf):
    p = _periods(spark, sf).select(F.col("label_date").alias("decision"))
    days = sorted(r[0] for r in p.collect())  # one row a month
    table = spark.createDataFrame(folds.folds(days, RULE), "fold_id int, train_from date, train_to date, test_from date, test_to date, fit_as_of date")
    records = p.withColumn("target_start", F.col("decision")).withColumn("target_end", F.date_add("decision", 92))
    return folds.select_training(table, records, RULE, 3).select("fold_id", "decision", "reason")


@book.add(f"WITH {_PERIODS}, i AS (SELECT label_date, row_number() OVER (ORDER BY label_date) - 1 AS k FROM periods) SELECT a.label_date, b.label_date AS fit_day FROM i a JOIN i b ON b.k = a.k // 3 * 3")
def refit_days(spark, sf):
    return folds.refit_days(_periods(spark, sf), "label_date", 3)


# -- portfolios --------------------------------------------------------------------

_LEGS = _SCORED + """, fr AS (SELECT m, security_id, score, market_cap, close, fwd, CAST(floor((row_number() OVER (PARTITION BY m ORDER BY score, security_id) - 1) * 5 / count(*) OVER (PARTITION BY m)) AS INTEGER) AS f, count(*) OVER (PARTITION BY m) AS n FROM scored),
 legs AS (SELECT m, security_id, score, market_cap, fwd, CASE f WHEN 0 THEN -1 ELSE 1 END AS leg FROM fr WHERE n >= 5 AND f IN (0, 4))"""
_L1 = _LEGS + ", l1 AS (SELECT m, security_id, fwd, leg * 1.0 / count(*) OVER (PARTITION BY m, leg) AS weight FROM legs)"


def _book1(spark, sf):
    return portfolio.level1(_scored(spark, sf), ["m"], "score", "security_id", 5)


@book.add(f"WITH {_L1} SELECT m, security_id, round(weight, 6) AS weight FROM l1")
def l1_portfolio(spark, sf):
    return _book1(spark, sf).select("m", "security_id", r6(F.col("weight")).alias("weight"))


_L2 = _LEGS + """, c AS (SELECT m, security_id, score - avg(score) OVER (PARTITION BY m) AS s FROM legs),
 l2 AS (SELECT m, security_id, s / sum(abs(s)) OVER (PARTITION BY m, sign(s)) AS weight FROM c WHERE abs(s) > 1e-12)"""


@book.add(f"WITH {_L2} SELECT m, security_id, round(weight, 6) + 0.0 AS weight FROM l2")
def l2_portfolio(spark, sf):
    return portfolio.level2(_scored(spark, sf), ["m"], "score", "security_id", 5).select("m", "security_id", r6(F.col("weight")).alias("weight"))


@book.add()
def l2_capped(spark, sf):
    b = portfolio.level2(_scored(spark, sf), ["m"], "score", "security_id", 5)
    return portfolio.capped(b, ["m"], "weight", "security_id", 0.12).select("m", "security_id", r6(F.col("capped")).alias("weight"))


@book.add()
def l3_portfolio(spark, sf):
    s = _scored(spark, sf).withColumn("var", F.lit(0.04)).join(sectors(spark, sf), "security_id")
    b = portfolio.level3(s, ["m"], "security_id", "score", 0.1, 2.0, groups=["sector"], group_net=0.1, variance="var")
    return b.select("m", "security_id", F.round("weight", 4).alias("weight"), "status")


@book.add(f"WITH {_L1}, a AS (SELECT m, security_id, weight FROM l1), u AS (SELECT m AS d, security_id, weight AS w1, 0.0 AS w0 FROM a UNION ALL SELECT m + 1, security_id, 0.0, weight FROM a), g AS (SELECT d, security_id, sum(w1) AS w1, sum(w0) AS w0 FROM u GROUP BY 1, 2) SELECT d, round(sum(abs(w1 - w0)) / 2, 6) AS one_way FROM g WHERE d IN (SELECT DISTINCT m FROM a) GROUP BY d")
def turnover_one_way(spark, sf):
    return metrics.turnover(_book1(spark, sf), "m", "security_id", "weight").select("d", r6(F.col("one_way")).alias("one_way"))


@book.add(f"WITH {_L1}, {SECTORS} SELECT m, coalesce(CAST(CASE WHEN sector < 4 THEN sector END AS VARCHAR), 'UNMAPPED') AS sector, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0.0 AS net FROM l1 LEFT JOIN sectors USING (security_id) GROUP BY 1, 2")
def group_exposure(spark, sf):
    g = sectors(spark, sf).where("sector < 4").select("security_id", F.col("sector").cast("string").alias("sector"))
    e = metrics.group_exposure(_book1(spark, sf), g, ["m"], "security_id", "sector", "weight")
    return e.select("m", "sector", r6(F.col("gross")).alias("gross"), r6(F.col("net")).alias("net"))


@book.add(f"WITH {_L1} SELECT m, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0.0 AS net FROM l1 GROUP BY 1")
def book_exposure(spark, sf):
    return metrics.exposure(_book1(spark, sf), ["m"], "weight").select("m", r6(F.col("gross")).alias("gross"), r6(F.col("net")).alias("net"))


@book.add(f"""WITH {RETURNS} SELECT a.security_id AS a, b.security_id AS b, round(CASE WHEN a.security_id = b.security_id THEN 1 ELSE 0.5 END * covar_samp(a.fwd, b.fwd), 8) + 0.0 AS cov FROM rets a JOIN rets b USING (m)
 WHERE a.fwd IS NOT NULL AND b.fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def covariance_all(spark, sf):
    r = month_returns(spark, sf).where("fwd is not null")
    c = portfolio.covariance(r, "m", "security_id", "fwd", 0.5)
    return c.where("cov is not null").select("a", "b", rounded(F.col("cov"), 8).alias("cov"))


# -- costs and ledger ----------------------------------------------------------------


def _trades(spark, sf) -> DataFrame:
    b = _book1(spark, sf).join(sectors(spark, sf), "security_id")
    return b.select(F.col("m").alias("date"), "security_id", (F.col("weight") * 1e6).alias("notional"), (F.col("market_cap") * 10).alias("adv"), F.lit(10.0).alias("spread_bps"), F.when(F.col("sector") == 1, "latam").otherwise("core").alias("region"))


STACK = costs.CostStack(commission=2, crossing=0.5, linear_bps=20, linear_by_region={"latam": 50}, impact_coeff=25, impact_exp=0.5, participation_cap=0.1, participation_bps=50)
_TRADES = _L1 + ", " + SECTORS + """, trades AS (SELECT l1.m AS date, l1.security_id, weight * 1e6 AS notional, legs.market_cap * 10 AS adv, CASE WHEN sector = 1 THEN 50 ELSE 20 END AS lin FROM l1 JOIN legs ON l1.m = legs.m AND l1.security_id = legs.security_id JOIN sectors ON l1.security_id = sectors.security_id)"""


@book.add(f"""WITH {_TRADES}, c AS (SELECT date, security_id, 2.0 AS commission, 0.5 * 10 * 1e-4 * abs(notional) AS half_spread, lin * 1e-4 * abs(notional) AS linear, 25 * 1e-4 * sqrt(abs(notional) / adv) * abs(notional) AS impact, 50 * 1e-4 * greatest(0, abs(notional) - 0.1 * adv) AS participation, abs(notional) > 0.1 * adv AS flagged FROM trades)
 SELECT date, security_id, round(commission, 6) AS commission, round(half_spread, 6) AS half_spread, round(linear, 6) AS linear, round(impact, 6) AS impact, round(participation, 6) AS participation, flagged, round(commission + half_spread + linear + impact + participation, 6) AS total FROM c""")
def trade_costs(spark, sf):
    c = costs.trade_costs(_trades(spark, sf), STACK)
    return c.select("date", "security_id", *[r6(F.col(x)).alias(x) for x in ("commission", "half_spread", "linear", "impact", "participation")], "flagged", r6(F.col("total")).alias("total"))


@book.add(f"WITH {_L1} SELECT m AS date, round(sum(abs(weight)) * 1e6 * 20 * 1e-4, 4) AS cost FROM l1 GROUP BY 1")
def linear_cost(spark, sf):
    c = costs.trade_costs(_trades(spark, sf), costs.linear_stack(20))
    return c.groupBy("date").agg(F.round(F.sum("total"), 4).alias("cost"))


@book.add(f"WITH {_L1}, {SECTORS} SELECT m AS date, l1.security_id, round(CASE WHEN l1.security_id % 7 = 0 THEN 300 WHEN sector = 1 THEN 100 ELSE 50 END * 1e-4 * -weight * 1e6 * 30 / 365, 4) AS borrow FROM l1 JOIN sectors USING (security_id) WHERE weight < 0")
def borrow_accrual(spark, sf):
    t = _trades(spark, sf).where("notional < 0").select("date", "security_id", (-F.col("notional")).alias("short_notional"), F.lit(30).alias("days"), "region", F.when(F.col("security_id") % 7 == 0, 300.0).alias("override_bps"))
    return costs.borrow(t, 50, {"latam": 100}).select("date", "security_id", F.round("borrow", 4).alias("borrow"))


@book.add(f"WITH {_L1}, g AS (SELECT m, sum(weight * fwd) AS gross, sum(abs(weight)) / 2 AS one_way FROM l1 WHERE fwd IS NOT NULL GROUP BY m) SELECT round(sum(gross) / (2 * sum(one_way)) * 10000, 4) + 0.0 AS break_even_bps FROM g")
def break_even(spark, sf):
    g = _book1(spark, sf).where("fwd is not null").groupBy("m").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"), (F.sum(F.abs("weight")) / 2).alias("one_way"))
    return metrics.break_even_bps(g, "gross", "one_way").select(F.round("break_even_bps", 4).alias("break_even_bps"))


@book.add(f"""WITH RECURSIVE {_L1}, b AS (SELECT m, security_id, weight AS w, fwd AS r FROM l1 WHERE fwd IS NOT NULL), p AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM (SELECT DISTINCT m FROM b)), x AS (SELECT p.i, b.* FROM b JOIN p USING (m)),
 u AS (SELECT coalesce(a.i, z.i + 1) AS i, coalesce(a.w, 0.0) AS w, coalesce(z.w * (1 + z.r), 0.0) AS d FROM x a FULL JOIN x z ON z.i + 1 = a.i AND z.security_id = a.security_id), l AS (SELECT i, list({{'w': w, 'd': d}}) AS ps FROM u GROUP BY i),
 s AS (SELECT i, m, g, f, ps FROM (SELECT i, m, sum(w * r) AS g, sum(CASE WHEN w < 0 THEN -w * (1 + r) ELSE 0.0 END) * 0.005 * 30 / 365 AS f FROM x GROUP BY i, m) JOIN l USING (i)),
 n(i, m, nav0, cost, gross, borrow, nav1) AS (SELECT i, m, CAST(1000 AS DOUBLE), c, g * 1000, f * 1000, 1000 * (1 + g - f) - c FROM (SELECT *, list_sum([0.002 * abs(q.w * 1000) for q in ps]) AS c FROM s WHERE i = 1)
  UNION ALL SELECT i, m, nav1, c, g * nav1, f * nav1, nav1 * (1 + g - f) - c FROM (SELECT s.i, s.m, s.g, s.f, n.nav1, list_sum([0.002 * abs(q.w * n.nav1 - q.d * n.nav0) for q in s.ps]) AS c FROM n JOIN s ON s.i = n.i + 1))
 SELECT book, m AS period, round(log10(nav0), 6) AS nav_log10, round(cost / nav0, 6) AS cost_rate, round(gross / nav0, 6) + 0.0 AS gross_rate, round(borrow / nav0, 6) AS borrow_rate, round(nav1 / nav0, 6) AS growth, round((gross - cost - borrow) / nav0, 6) + 0.0 AS ret FROM n, (SELECT unnest(['plain', 'copy']) AS book)""")
def accounting_ledger(spark, sf):
    """Two books through time, as shares of the value at each period's start: the values themselves grow past a double's digits."""
    b = _book1(spark, sf).where("fwd is not null").select(F.col("m").cast("int").alias("period"), F.col("security_id").cast("string").alias("name"), "weight", "fwd")
    names = spark.createDataFrame([("plain",), ("copy",)], "book string")
    marks = month_returns(spark, sf).where("fwd is not null").select(F.col("m").cast("int").alias("period"), F.col("security_id").cast("string").alias("name"), F.col("fwd").alias("ret"))
    t = b.crossJoin(F.broadcast(names)).select("book", "period", "name", "weight")
    m = marks.join(b.select("period", "name"), ["period", "name"], "left_semi").crossJoin(F.broadcast(names)).select("book", "period", F.lit(0).alias("step"), "name", "ret", F.lit(False).alias("terminated"))
    out = ledger.run_ledger(t, m, cost_bps=20, borrow_bps=50)
    share = {"cost_rate": "cost", "gross_rate": "gross_pnl", "borrow_rate": "borrow", "growth": "nav_end"}
    return out.select("book", "period", r6(F.log10("nav_start")).alias("nav_log10"), *[r6(F.col(c) / F.col("nav_start")).alias(k) for k, c in share.items()], r6(F.col("ret")).alias("ret"))


@book.add(f"WITH {_L1}, r AS (SELECT m, sum(weight * fwd) AS gross FROM l1 WHERE fwd IS NOT NULL GROUP BY m), c AS (SELECT m, sum(abs(weight)) * 0.002 AS cost FROM l1 GROUP BY m) SELECT r.m AS date, round(gross - cost, 6) + 0.0 AS net FROM r JOIN c USING (m)")
def net_returns(spark, sf):
    b = _book1(spark, sf)
    gross = b.where("fwd is not null").groupBy(F.col("m").alias("date")).agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"))
    charges = b.groupBy(F.col("m").alias("date")).agg((F.sum(F.abs("weight")) * 0.002).alias("cost"), F.lit(0.0).alias("borrow"))
    net, _ = costs.net_of(gross, charges)
    return net.select("date", r6(F.col("net")).alias("net"))
