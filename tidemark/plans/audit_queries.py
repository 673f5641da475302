"""Panel scoring, attribution, capacity, sensitivity and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.finite import r6
from ..operators import costs, metrics, portfolio
from ..sources import provider
from .base import FACTS, RETURNS, SECTORS, Book, facts, month_returns, sectors, table
from .model_queries import _L1, _L2, _LEGS, _book1
from .panel_queries import _scored

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.add(f"WITH {FACTS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM facts) SELECT user_id, event_type, event_id, value FROM l WHERE k = 1")
def latest_fit(spark, sf):
    return metrics.latest_fit(facts(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@book.add(f"WITH {RETURNS}, p AS (SELECT security_id, m, past AS score FROM rets WHERE past IS NOT NULL) SELECT p.security_id, p.m, CASE WHEN p.m % 12 = 11 THEN 'incomplete_window' ELSE 'missing_outcome' END AS reason FROM p JOIN rets USING (security_id, m) WHERE p.m % 12 = 11 OR fwd IS NULL")
def scoring_ledger(spark, sf):
    r = month_returns(spark, sf)
    p = r.where("past is not null").select("security_id", "m", F.col("past").alias("score"), (F.col("m") % 12 != 11).alias("complete"), F.lit(0).alias("fit"))
    _, ledger = metrics.scoring_panel(p, r.select("security_id", "m", F.col("fwd").alias("outcome")), ["security_id", "m"], "complete", ["fit"])
    return ledger.select("security_id", "m", "reason")


@book.add(f"""WITH {RETURNS}, {SECTORS}, live AS (SELECT security_id, fwd FROM rets WHERE fwd IS NOT NULL AND NOT (security_id % 5 = 0 AND m > (SELECT min(r2.m) FROM rets r2 WHERE r2.security_id = rets.security_id AND r2.fwd IS NOT NULL AND r2.m >= 23990))), g AS (SELECT security_id, product(1 + fwd) - 1 AS g FROM live GROUP BY 1)
 SELECT CAST(sector AS VARCHAR) AS sector, round(sum(0.01 * g), 6) + 0.0 AS contribution FROM g JOIN sectors USING (security_id) GROUP BY 1""")
def group_contribution(spark, sf):
    every_fifth = F.col("security_id") % 5 == 0
    r = month_returns(spark, sf).where("fwd is not null").select("security_id", "m", F.col("fwd").alias("ret"), (every_fifth & (F.col("m") >= 23990)).alias("ends"))
    w = r.select("security_id").distinct().withColumn("weight", F.lit(0.01))
    g = sectors(spark, sf).select("security_id", F.col("sector").cast("string").alias("sector"))
    return metrics.contribution(w, r, g, "security_id", "m", "sector", "ends").select("sector", r6(F.col("contribution")).alias("contribution"))


@book.add(f"WITH {_L1}, c AS (SELECT l1.m, sum(legs.market_cap) AS adv, sum(abs(weight)) / 2 AS t FROM l1 JOIN legs ON l1.m = legs.m AND l1.security_id = legs.security_id GROUP BY 1) SELECT CAST(floor(m / 12) AS BIGINT) AS y, round(min(0.1 * adv / t), 4) AS capacity FROM c WHERE t > 0 GROUP BY 1")
def capacity(spark, sf):
    b = _book1(spark, sf).groupBy("m").agg(F.sum("market_cap").alias("adv"), (F.sum(F.abs("weight")) / 2).alias("t")).withColumn("y", F.floor(F.col("m") / 12).cast("long"))
    return metrics.capacity(b, ["y"], "adv", "t", 0.1).select("y", F.round("capacity", 4).alias("capacity"))


@book.add("SELECT count(*) AS trials, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS distinct_configurations FROM lineitem")
def distinct_configurations(spark, sf):
    return metrics.configurations(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@book.add("""WITH r AS (SELECT l_returnflag AS setting, avg(l_discount) AS v FROM lineitem GROUP BY 1), b AS (SELECT v AS b FROM r WHERE setting = 'N')
 SELECT setting, round(v, 6) AS v, round(v - b, 6) + 0.0 AS delta, round(min(v - b) OVER (), 6) + 0.0 AS worst, round(max(v) OVER () - min(v) OVER (), 6) + 0.0 AS spread FROM r, b""")
def sensitivity(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("setting")).agg(F.avg("l_discount").alias("v"))
    s = metrics.sensitivity(r, "setting", "v", "N")
    return s.select("setting", *[r6(F.col(c)).alias(c) for c in ("v", "delta", "worst", "spread")])


@book.add("SELECT (SELECT count(*) FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 10 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_size < 20)) AS in_both, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size > 10 EXCEPT SELECT p_brand FROM part WHERE p_size < 20)) AS only_a, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size < 20 EXCEPT SELECT p_brand FROM part WHERE p_size > 10)) AS only_b")
def catalog_overlap(spark, sf):
    p = table(spark, sf, "part")
    return provider.catalog_overlap(p.where("p_size > 10"), p.where("p_size < 20"), "p_brand")


@book.add("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1")
def catalog_counts(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@book.add(f"WITH {_L1}, t AS (SELECT sum(abs(weight)) AS g FROM l1) SELECT bps, round(bps * 1e-4 * g, 6) AS cost FROM t, (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0, 30.0]) AS bps)")
def cost_grid(spark, sf):
    """Every stack of the flat grid over all trades, in one pass."""
    total = _book1(spark, sf).agg(F.sum(F.abs("weight")).alias("g"))
    grid = spark.createDataFrame([(float(s.linear_bps),) for s in costs.preset("flat_grid")], "bps double")
    return total.crossJoin(F.broadcast(grid)).select("bps", r6(F.col("bps") * 1e-4 * F.col("g")).alias("cost"))


@book.add(f"""WITH {_L1}, g AS (SELECT sum(weight * fwd) AS v FROM l1 WHERE fwd IS NOT NULL), t AS (SELECT sum(abs(weight)) * 0.002 AS c FROM l1),
 s AS (SELECT 0 AS stage, 0.0 AS v UNION ALL SELECT 1, v FROM g UNION ALL SELECT 2, v - c FROM g, t) SELECT stage, round(v, 6) + 0.0 AS v, round(v - lag(v) OVER (ORDER BY stage), 6) + 0.0 AS effect FROM s""")
def effect_decomposition(spark, sf):
    b = _book1(spark, sf)
    gross = b.where("fwd is not null").agg(F.sum(F.col("weight") * F.col("fwd")).alias("v"))
    cost = b.agg((F.sum(F.abs("weight")) * 0.002).alias("c"))
    one = gross.crossJoin(F.broadcast(cost))
    stages = one.select(F.explode(F.array(F.struct(F.lit(0).alias("stage"), F.lit(0.0).alias("v")), F.struct(F.lit(1).alias("stage"), F.col("v").alias("v")), F.struct(F.lit(2).alias("stage"), (F.col("v") - F.col("c")).alias("v")))).alias("s")).select("s.*")
    return metrics.effect_steps(stages, "stage", "v").select("stage", r6(F.col("v")).alias("v"), r6(F.col("effect")).alias("effect"))


@book.add(f"""WITH {_L1}{_L2.removeprefix(_LEGS)}, a AS (SELECT m, sum(abs(weight)) AS g FROM l1 GROUP BY 1), b AS (SELECT m, sum(abs(weight)) AS g FROM l2 GROUP BY 1)
 SELECT m, round(a.g, 6) AS level1, round(b.g, 6) AS level2 FROM a FULL JOIN b USING (m)""")
def book_levels(spark, sf):
    """Gross of the equal-leg and the signal-weighted book, month by month: both must be the asked one."""
    s = _scored(spark, sf)
    a = metrics.exposure(portfolio.level1(s, ["m"], "score", "security_id", 5), ["m"], "weight").select("m", F.col("gross").alias("level1"))
    b = metrics.exposure(portfolio.level2(s, ["m"], "score", "security_id", 5), ["m"], "weight").select("m", F.col("gross").alias("level2"))
    return a.join(b, "m", "full_outer").select("m", r6(F.col("level1")).alias("level1"), r6(F.col("level2")).alias("level2"))
