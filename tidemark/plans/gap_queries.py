"""Successors, spells, labels by comparison group, pooling, lineage and chain checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import xsec
from ..functions.finite import bins_below, r6
from ..operators import costs, etl, metrics, model, quality, targets
from ..streaming import streams
from .base import DAILY, FACTS, MONTHLY, RETURNS, SECTORS, SPELLS, Book, daily, facts, month_returns, monthly, sectors, spells, table
from .model_queries import _PERIODS, _fit, _periods
from .panel_queries import _RANKED, _wide

book = Book()
QUERIES, SQL = book.queries, book.sql


# -- identity and lineage ------------------------------------------------------------

_CHAIN = """ids AS (SELECT s_suppkey AS security_id, s_name AS ticker, s_nationkey % 2 AS exchange FROM supplier),
 recs AS (SELECT s_suppkey AS record_id, s_nationkey % 2 AS exchange, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'nobody' ELSE lead(s_name) OVER (ORDER BY s_suppkey) END AS successor_ticker FROM supplier),
 j AS (SELECT record_id, successor_ticker, security_id FROM recs LEFT JOIN ids ON ids.ticker = recs.successor_ticker AND ids.exchange = recs.exchange)"""


def _chain(spark, sf):
    s = table(spark, sf, "supplier").withColumn("exchange", F.col("s_nationkey") % 2)
    ids = s.select(F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("ticker"), "exchange")
    then = F.lead("s_name").over(Window.orderBy("s_suppkey"))
    name = F.when(F.col("s_suppkey") % 4 == 1, "nobody").when(F.col("s_suppkey") % 4 != 0, then)
    records = s.select(F.col("s_suppkey").alias("record_id"), "exchange", name.alias("successor_ticker"))
    return etl.successors(records, ids, "ticker", "exchange", "successor_ticker")


@book.add(f"WITH {_CHAIN} SELECT record_id, successor_ticker, security_id AS successor_security_id FROM j WHERE successor_ticker IS NULL OR security_id IS NOT NULL")
def successor_resolution(spark, sf):
    return _chain(spark, sf)[0].select("record_id", "successor_ticker", "successor_security_id")


@book.add(f"WITH {_CHAIN} SELECT record_id, successor_ticker FROM j WHERE successor_ticker IS NOT NULL AND security_id IS NULL")
def successor_unresolved(spark, sf):
    return _chain(spark, sf)[1].select("record_id", "successor_ticker")


@book.add(f"""WITH {SPELLS}, r AS (SELECT c_id, valid_from, NULL AS ended, valid_from AS known FROM spells UNION ALL SELECT c_id, valid_from, valid_to, CAST(valid_to + INTERVAL (c_id % 4) DAY AS DATE) FROM spells WHERE valid_to IS NOT NULL)
 SELECT c_id, valid_from, CAST(min(known) AS TIMESTAMP) AS known, max(ended) AS ended FROM r GROUP BY 1, 2""")
def interval_vintages(spark, sf):
    """An opening row and, later, a closing row of each interval become one."""
    return etl.merge_interval_vintages(_openings(spark, sf), ["c_id", "valid_from"], "ended", "known")[0].select("c_id", "valid_from", "known", "ended")


@book.add(f"WITH {SPELLS} SELECT c_id, valid_from, valid_to AS ended FROM spells WHERE valid_to IS NOT NULL AND c_id % 4 > 1")
def interval_late_closures(spark, sf):
    return etl.merge_interval_vintages(_openings(spark, sf), ["c_id", "valid_from"], "ended", "known")[1].select("c_id", "valid_from", "ended")


def _openings(spark, sf):
    s = spells(spark, sf)
    stamp = lambda c: c.cast("timestamp_ntz")
    opened = s.select("c_id", "valid_from", F.lit(None).cast("date").alias("ended"), stamp(F.col("valid_from")).alias("known"))
    closed = s.where("valid_to is not null").select("c_id", "valid_from", F.col("valid_to").alias("ended"), stamp(F.date_add("valid_to", (F.col("c_id") % 4).cast("int"))).alias("known"))
    return opened.unionByName(closed)


@book.add("SELECT l_orderkey, l_linenumber, o_orderkey * 10 + 9 AS action_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 11 = 0")
def dq_orphan_lineage(spark, sf):
    """Each line names two actions of its order; those ending in 9 exist for orders not divisible by 11 only."""
    o = table(spark, sf, "orders").select("o_orderkey")
    actions = o.select((F.col("o_orderkey") * 10).alias("action_id")).unionByName(o.where("o_orderkey % 11 <> 0").select((F.col("o_orderkey") * 10 + 9).alias("action_id")))
    lines = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    f = lines.select("l_orderkey", "l_linenumber", F.array(F.col("l_orderkey") * 10, F.col("l_orderkey") * 10 + 9).alias("derived_from_action_ids"))
    return quality.orphan_lineage(f, actions).select("l_orderkey", "l_linenumber", "action_id")


@book.add(f"""WITH {DAILY}, a AS (SELECT s_suppkey AS security_id, s_suppkey * 10 AS action_id, DATE '1999-03-01' AS effective_date, 1.0 + s_suppkey % 3 AS ratio FROM supplier),
 j AS (SELECT action_id, ratio, (SELECT arg_max(close, event_date) FROM daily d WHERE d.security_id = a.security_id AND event_date < effective_date) AS b, (SELECT arg_min(close, event_date) FROM daily d WHERE d.security_id = a.security_id AND event_date >= effective_date) AS c FROM a)
 SELECT action_id, round(b, 6) AS before, round(c, 6) AS after FROM j WHERE abs(ln(b / c) - ln(ratio)) > 0.2""")
def dq_split_jump(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"), (F.col("s_suppkey") * 10).alias("action_id"), F.lit("1999-03-01").cast("date").alias("effective_date"), (1.0 + F.col("s_suppkey") % 3).alias("ratio"))
    q = quality.split_against_jump(a, daily(spark, sf), "security_id", "event_date", "close", 0.2)
    return q.select("action_id", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


@book.add("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + INTERVAL 3 DAY")
def dq_known_before_event(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.known_before_event(j.withColumn("event", F.date_add(F.to_date("o_orderdate"), 3)), "l_shipdate", "event").select("l_orderkey", "l_linenumber")


@book.add("SELECT event_id FROM events WHERE ts > ts + INTERVAL 1 SECOND * (event_id % 5 - 2)")
def dq_retrieved_before_known(spark, sf):
    e = table(spark, sf, "events").withColumn("retrieved", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 5 - 2).cast("decimal(18,6)")))
    return quality.retrieved_before_known(e, "ts", "retrieved").select("event_id")


@book.add(f"WITH {FACTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts ELSE date_trunc('day', ts) + INTERVAL 45 DAY END AS knowledge_time, CASE WHEN event_id % 3 = 0 THEN 'provider' ELSE 'period_lag' END AS knowledge_basis FROM facts")
def observation_stamps(spark, sf):
    f = facts(spark, sf).select("event_id", F.to_date("ts").alias("period_end"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("provided"))
    return etl.stamp_observations(f, "provided", "period_end", 45).select("event_id", "knowledge_time", "knowledge_basis")


# -- paths and chains ----------------------------------------------------------------

_STATE = RETURNS + ", st AS (SELECT security_id, m, CASE WHEN past IS NULL THEN 'none' WHEN past < 0 THEN 'down' ELSE 'up' END AS state FROM rets)"


@book.add(f"""WITH {_STATE}, i AS (SELECT *, m - row_number() OVER (PARTITION BY security_id, state ORDER BY m) AS k FROM st)
 SELECT security_id, state, min(m) AS spell_start, max(m) AS spell_end, count(*) AS steps FROM i GROUP BY security_id, state, k""")
def regime_spells(spark, sf):
    p = month_returns(spark, sf)
    state = F.when(F.col("past").isNull(), "none").when(F.col("past") < 0, "down").otherwise("up")
    return quality.spells(p.select("security_id", "m", state.alias("state")), ["security_id"], "m", "state")


_NAV = "nav AS (SELECT o_custkey AS book, o_orderkey AS period, round(o_totalprice) AS nav_start, lead(round(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS nav_end FROM orders)"


@book.add(f"WITH {_NAV} SELECT book, period FROM nav WHERE nav_end IS NOT NULL AND period % 7 = 0")
def nav_chain_breaks(spark, sf):
    start = F.round("o_totalprice")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("period"), start.alias("nav_start"))
    end = F.lead("nav_start").over(Window.partitionBy("book").orderBy("period")) + F.when(F.col("period") % 7 == 0, 1).otherwise(0)
    return metrics.chain_breaks(o.withColumn("nav_end", end), ["book"], "period", 1e-6).select("book", "period")


@book.add(f"WITH {DAILY}, g AS (SELECT security_id, event_date, 7 AS days, date_diff('day', lag(event_date) OVER (PARTITION BY security_id ORDER BY event_date), event_date) AS gap FROM daily) SELECT security_id, event_date, CAST(gap AS INTEGER) AS gap FROM g WHERE gap IS NOT NULL AND gap <> days")
def accrual_gaps(spark, sf):
    marks = daily(spark, sf).select("security_id", F.col("event_date").alias("date"), F.lit(7).alias("days"))
    return costs.accrual_gaps(marks, ["security_id"]).select("security_id", F.col("date").alias("event_date"), "gap")


@book.add("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    """The session operator of the streams over the whole table."""
    s = streams.sessions(table(spark, sf, "events"), "6 hours", "1 hour")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# -- targets and models --------------------------------------------------------------

_LABELS = RETURNS + ", " + SECTORS + ", p AS (SELECT m, security_id, sector, market_cap, fwd FROM rets JOIN sectors USING (security_id) WHERE fwd IS NOT NULL)"


def _cut(v: str, part: str) -> str:
    k, n = f"row_number() OVER (PARTITION BY {part} ORDER BY {v}, security_id)", f"count(*) OVER (PARTITION BY {part})"
    return f"CASE WHEN {k} <= floor({n} * 0.3) THEN -1 WHEN {k} > {n} - least(floor({n} * 0.2), {n} - floor({n} * 0.3)) THEN 1 END"


def _returns(spark, sf):
    p = month_returns(spark, sf).where("fwd is not null").join(sectors(spark, sf), "security_id")
    return p.select("m", "security_id", F.col("sector").alias("cell"), F.col("market_cap").alias("cap"), "fwd")


_SHARES = {"top": 0.2, "middle": 0.5, "bottom": 0.3}


@book.add(f"WITH {_LABELS} SELECT m, security_id, CAST({_cut('fwd', 'm, sector')} AS INTEGER) AS label, round(CASE WHEN count(*) OVER (PARTITION BY m, sector) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY m, sector ORDER BY fwd, security_id) - 1) / (count(*) OVER (PARTITION BY m, sector) - 1) END, 6) AS transformed FROM p")
def cell_labels(spark, sf):
    f = targets.TargetFamily(group="neutralization_cell", cell_rank=True, **_SHARES)
    return targets.labelled(_returns(spark, sf), f, ["m"], "fwd", "security_id").select("m", "security_id", "label", r6(F.col("transformed")).alias("transformed"))


@book.add(f"WITH {_LABELS}, d AS (SELECT m, security_id, fwd - sum(market_cap * fwd) OVER w / sum(market_cap) OVER w AS x FROM p WINDOW w AS (PARTITION BY m, sector)) SELECT m, security_id, round(x, 6) + 0.0 AS transformed FROM d")
def demeaned_targets(spark, sf):
    f = targets.TargetFamily(group="country_demeaned", demean="cap", **_SHARES)
    return targets.labelled(_returns(spark, sf), f, ["m"], "fwd", "security_id").select("m", "security_id", r6(F.col("transformed")).alias("transformed"))


@book.add(f"WITH {_LABELS} SELECT m, security_id, CAST({_cut('fwd', 'm')} AS INTEGER) AS label FROM p")
def universe_labels(spark, sf):
    return targets.labelled(_returns(spark, sf), targets.TargetFamily(**_SHARES), ["m"], "fwd", "security_id").select("m", "security_id", "label")


@book.add(f"""WITH {_PERIODS}, g AS (SELECT period_id, label_date, target_end, row_number() OVER (ORDER BY label_date) - 1 AS idx, count(*) OVER () AS n FROM periods)
 SELECT period_id, CASE WHEN idx >= n - 2 THEN 'calendar_exhausted' WHEN target_end > DATE '2000-05-15' THEN 'unrealized_window' WHEN idx + 3 > 60 THEN 'training_lag_excluded' WHEN idx % 2 <> 0 THEN 'overlap_purged' END AS reason FROM g""")
def skip_reasons(spark, sf):
    line = Window.orderBy("label_date")
    p = _periods(spark, sf).withColumns({"idx": F.row_number().over(line) - 1, "complete": F.lead("label_date", 2).over(line).isNotNull()})
    return targets.point_reason(p.withColumnRenamed("target_end", "end_day"), _fit(), 60, 3, 2).select("period_id", "reason")


@book.add(f"WITH {_PERIODS}, {_RANKED.removeprefix(MONTHLY + ', ')}, s AS (SELECT period_id FROM periods WHERE target_end <= DATE '2000-05-15' ORDER BY label_date DESC LIMIT 12) SELECT m, security_id, round(size, 6) AS size FROM wide WHERE m IN (SELECT period_id FROM s)")
def pooled_periods(spark, sf):
    chosen = model.select_trailing(_periods(spark, sf), _fit(), 12).withColumnRenamed("period_id", "m")
    return model.pooled(_wide(spark, sf), chosen, "m").select("m", "security_id", r6(F.col("size")).alias("size"))


@book.add(f"WITH {_RANKED}, b AS (SELECT m, CASE WHEN size > 0.8 THEN 4 WHEN size > 0.6 THEN 3 WHEN size > 0.4 THEN 2 WHEN size > 0.2 THEN 1 ELSE 0 END AS bin FROM wide) SELECT m, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1, 2")
def width_bins(spark, sf):
    edges = F.array(*[F.lit(float(e)) for e in model.equal_width_edges(5)])
    return _wide(spark, sf).select("m", bins_below(edges, F.col("size")).alias("bin")).groupBy("m", "bin").agg(F.count(F.lit(1)).alias("n"))


@book.add("""WITH w AS (SELECT l_returnflag AS c, count(*) / sum(count(*)) OVER () AS weight FROM lineitem GROUP BY 1), b AS (SELECT c, weight FROM w UNION ALL SELECT 'hedge', avg(weight) FROM w) SELECT c, round(weight / sum(weight) OVER (), 6) AS weight FROM b""")
def hedge_weights(spark, sf):
    w = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    w = w.select("c", (F.col("k") / F.sum("k").over(Window.partitionBy())).alias("weight"))
    return model.hedge_weights(w, "c", "hedge").select("c", r6(F.col("weight")).alias("weight"))


@book.add(f"WITH {_RANKED} SELECT m, security_id, round(0.3 * reversal + 0.7 * size, 6) + 0.0 AS score FROM wide WHERE reversal IS NOT NULL")
def blended_scores(spark, sf):
    w = _wide(spark, sf)
    a = w.where("reversal is not null").select("m", "security_id", F.col("reversal").alias("score"))
    return model.blend(a, w.select("m", "security_id", F.col("size").alias("score")), ["m", "security_id"], 0.3).select("m", "security_id", r6(F.col("score")).alias("score"))


@book.add(f"WITH {_RANKED}, l AS (SELECT 'reversal' AS f, reversal AS v FROM wide UNION ALL SELECT 'size', size FROM wide UNION ALL SELECT 'volume', volume FROM wide), s AS (SELECT f, sum(abs(v)) AS s FROM l GROUP BY 1) SELECT f AS family, round(s / sum(s) OVER (), 6) AS share FROM s")
def family_shares(spark, sf):
    long = _wide(spark, sf).drop("fwd").unpivot(["m", "security_id"], ["reversal", "size", "volume"], "family", "v")
    return model.ic_shares(long, "family", "v").select("family", r6(F.col("share")).alias("share"))
