"""Point-in-time, interval, calendar and ETL queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.finite import r6
from ..operators import calendar, etl, pit, quality
from .base import DAILY, FACTS, SPELLS, Book, daily, facts, spells, table

book = Book()
QUERIES, SQL = book.queries, book.sql
AS_OF = "2024-01-16 12:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@book.add(f"""WITH {FACTS} SELECT user_id, event_type, ts, vintage_seq, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, vintage_seq DESC) AS k FROM facts WHERE ts <= TIMESTAMP '{AS_OF}') WHERE k = 1""")
def pit_latest_vintage(spark, sf):
    return pit.latest_vintage(facts(spark, sf).drop("event_id"), ["user_id", "event_type"], "ts", "vintage_seq", _at(AS_OF))


@book.add(f"""WITH {FACTS} SELECT user_id, event_type, ts, vintage_seq, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, vintage_seq DESC) AS k FROM facts
 WHERE event_type IN ('view', 'purchase') AND ts <= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS) WHERE k = 1""")
def pit_latest_vintage_lagged_keys(spark, sf):
    lag = pit.effective_lag(dt.timedelta(days=1), dt.timedelta(days=3))
    return pit.latest_vintage(facts(spark, sf).drop("event_id"), ["user_id", "event_type"], "ts", "vintage_seq", _at(AS_OF), lag, {"event_type": ["view", "purchase"]})


@book.add(f"SELECT event_id, user_id, ts FROM events WHERE ts <= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOURS")
def pit_knowable(spark, sf):
    e = table(spark, sf, "events")
    return e.where(pit.knowable(F.col("ts"), _at(AS_OF), dt.timedelta(hours=36))).select("event_id", "user_id", "ts")


def _asof_sides(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("paid"))
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("known"), F.col("event_id").alias("view_id"), F.col("value").alias("seen"))
    return left, right


def _asof_sql(lag: str) -> str:
    return f"""SELECT l.user_id, l.ts, l.event_id, l.value AS paid, r.known AS knowledge_time_known, r.view_id, r.seen FROM events l LEFT JOIN (
 SELECT l2.event_id AS e, r2.ts AS known, r2.event_id AS view_id, r2.value AS seen,
  row_number() OVER (PARTITION BY l2.event_id ORDER BY r2.ts DESC, r2.event_id DESC) AS k
 FROM events l2 JOIN events r2 ON l2.user_id = r2.user_id AND r2.event_type = 'view' AND r2.ts <= l2.ts - {lag} WHERE l2.event_type = 'purchase') r
 ON l.event_id = r.e AND r.k = 1 WHERE l.event_type = 'purchase'"""


@book.add(_asof_sql("INTERVAL 0 DAYS"))
def pit_asof_join(spark, sf):
    left, right = _asof_sides(spark, sf)
    return pit.asof_join(left, right, ["user_id"], "ts", "known", ["view_id"])


@book.add(_asof_sql("INTERVAL 2 DAYS"))
def pit_asof_join_lagged(spark, sf):
    left, right = _asof_sides(spark, sf)
    return pit.asof_join(left, right, ["user_id"], "ts", "known", ["view_id"], lag=dt.timedelta(days=2))


@book.add(_asof_sql("INTERVAL 0 DAYS").replace("r.known AS knowledge_time_known, r.view_id, r.seen", "r.known AS right_known, r.view_id AS right_view_id, r.seen AS right_seen"))
def pit_asof_join_ranged(spark, sf):
    left, right = _asof_sides(spark, sf)
    return pit.asof_join_ranged(left, right, ["user_id"], "event_id", "ts", "known", ["view_id"])


def _quarter_days(spark, sf):
    d = calendar.trading_days(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day")
    return calendar.month_ends(d, "day").where(F.month("day") % 3 == 0)


_QUARTERS = "quarters AS (SELECT day FROM (SELECT max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY year(o_orderdate), month(o_orderdate)) WHERE month(day) % 3 = 0)"


@book.add(f"WITH {SPELLS}, {_QUARTERS} SELECT day, c_id, valid_from FROM spells JOIN quarters ON day BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')")
def interval_membership(spark, sf):
    return pit.interval_members(spells(spark, sf), _quarter_days(spark, sf), "day", ["c_id"], "valid_from", "valid_to").select("day", "c_id", "valid_from")


@book.add(f"WITH {SPELLS}, {_QUARTERS} SELECT day, c_id, status FROM spells JOIN quarters ON day BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')")
def classification_asof(spark, sf):
    return pit.classification_asof(spells(spark, sf).withColumn("known", F.col("valid_from")), _quarter_days(spark, sf), "day", ["c_id"], "valid_from", "valid_to", "status", "known").select("day", "c_id", "status")


@book.add(f"WITH {SPELLS} SELECT c_id, count(*) AS n FROM spells WHERE greatest(valid_from, DATE '1997-01-01') <= least(coalesce(valid_to, DATE '9999-12-31'), DATE '1997-12-31') GROUP BY c_id")
def interval_overlap(spark, sf):
    year = (F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return spells(spark, sf).where(pit.overlaps(F.col("valid_from"), F.col("valid_to"), *year)).groupBy("c_id").agg(F.count(F.lit(1)).alias("n"))


_GRID = "grid AS (SELECT DISTINCT security_id, day FROM daily, (SELECT max(event_date) AS day FROM daily GROUP BY year(event_date), month(event_date)))"


def month_grid(bars):
    days = calendar.month_ends(calendar.trading_days(bars, "event_date"), "event_date").withColumnRenamed("event_date", "day")
    return bars.select("security_id").distinct().crossJoin(F.broadcast(days))


def last_seen_sql(value: str, back: int, stale: int, out: str) -> str:
    """A scalar as-of lookup by an ordered join, for the SQL side."""
    return f"""(SELECT security_id, day, CASE WHEN date_diff('day', e, day - INTERVAL {back} DAY) <= {stale} THEN v END AS {out}, e FROM (
 SELECT g.security_id, g.day, d.{value} AS v, d.event_date AS e, row_number() OVER (PARTITION BY g.security_id, g.day ORDER BY d.event_date DESC) AS k
 FROM grid g JOIN daily d ON g.security_id = d.security_id AND d.event_date <= g.day - INTERVAL {back} DAY AND d.event_date >= g.day - INTERVAL {back + stale} DAY) WHERE k = 1)"""


@book.add(f"WITH {DAILY}, {_GRID} SELECT g.security_id, g.day, x.c AS close, CASE WHEN x.c IS NOT NULL THEN x.e END AS observed FROM grid g LEFT JOIN {last_seen_sql('close', 0, 5, 'c')} x USING (security_id, day)")
def last_on_or_before(spark, sf):
    bars = daily(spark, sf)
    return pit.last_on_or_before(bars, month_grid(bars), ["security_id"], "event_date", "day", "close", 5).select("security_id", "day", "close", "observed")


@book.add(f"SELECT event_id, event_type, ts FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '{AS_OF}'")
def truncate_future(spark, sf):
    return pit.truncate_future(table(spark, sf, "events"), "ts", _at(AS_OF)).select("event_id", "event_type", "ts")


@book.add("""SELECT user_id, ts, event_id, first_event_id, first_ts FROM (SELECT l.user_id, l.ts, l.event_id, r.event_id AS first_event_id, r.ts AS first_ts,
 row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts, r.event_id) AS k FROM events l LEFT JOIN events r
 ON l.user_id = r.user_id AND r.event_type = 'purchase' AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 3 DAYS WHERE l.event_type = 'view') WHERE k = 1""")
def first_event_in_window(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'view'").select("user_id", "ts", "event_id", (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("through"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("pid"))
    j = pit.first_event_in(left, right, ["user_id"], "event_id", "ts", "through", "at")
    return j.select("user_id", "ts", "event_id", F.col("first_event.pid").alias("first_event_id"), F.col("first_event.at").alias("first_ts"))


@book.add(f"""WITH {DAILY} SELECT security_id, m, max(event_date) AS last_day FROM daily, (SELECT DISTINCT date_trunc('month', event_date)::DATE AS m FROM daily)
 WHERE event_date BETWEEN m AND m + INTERVAL 20 DAY GROUP BY 1, 2""")
def last_day_in_range(spark, sf):
    bars = daily(spark, sf).select("security_id", "event_date")
    all_months = bars.select(F.trunc("event_date", "month").alias("m")).distinct()
    months = bars.select("security_id").distinct().crossJoin(F.broadcast(all_months)).withColumn("through", F.date_add("m", 20)).withColumn("row_id", F.xxhash64("security_id", "m"))
    return pit.last_day_in(months, bars, ["security_id"], "row_id", "m", "through", "event_date").where("last_day is not null").select("security_id", "m", "last_day")


_DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)"


def _days(spark, sf):
    return calendar.trading_days(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")


@book.add(f"WITH {_DAYS} SELECT max(day) AS day FROM days GROUP BY year(day), month(day)")
def month_end_grid(spark, sf):
    return calendar.month_ends(_days(spark, sf), "day")


@book.add(f"WITH {_DAYS} SELECT max(day) AS day FROM days WHERE isodow(day) <= 5 GROUP BY isoyear(day), weekofyear(day)")
def weekly_grid(spark, sf):
    return calendar.week_ends(_days(spark, sf), "day", 4)


@book.add(f"WITH {_DAYS} SELECT day, lead(day, 5) OVER (ORDER BY day) AS shifted FROM days")
def trading_day_shift(spark, sf):
    return calendar.shifted(_days(spark, sf), "day", 5, "shifted")


@book.add(f"WITH {_DAYS}, g AS (SELECT max(day) AS day FROM days GROUP BY year(day), month(day)), i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS idx FROM g) SELECT day FROM i WHERE idx >= 2 AND (idx - 2) % 3 = 0")
def every_third_month(spark, sf):
    return calendar.every(calendar.month_ends(_days(spark, sf), "day"), "day", 3, 2)


@book.add(f"WITH {_DAYS}, g AS (SELECT max(day) AS day FROM days GROUP BY year(day), month(day)), i AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM g) SELECT a.day, CAST(count(*) - 1 AS BIGINT) AS overlaps FROM i a JOIN i b ON abs(a.k - b.k) < 3 GROUP BY a.day")
def overlap_counts(spark, sf):
    return calendar.overlap_counts(calendar.month_ends(_days(spark, sf), "day"), "day", 3).withColumn("overlaps", F.col("overlaps").cast("long"))


# -- canonicalisation ----------------------------------------------------------


@book.add("SELECT s_suppkey, 'SEC-' || substr(sha256(upper(trim(s_name)) || '|' || 'N' || s_nationkey || '|' || '1995-01-01'), 1, 12) AS security_id FROM supplier")
def mint_ids(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", etl.minted_id(F.col("s_name"), F.concat(F.lit("N"), F.col("s_nationkey")), F.lit("1995-01-01")).alias("security_id"))


@book.add("SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS first_seen FROM lineitem GROUP BY 1")
def first_seen(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("seen"), F.lit(None).cast("date").alias("listed"))
    return etl.first_seen(li, ["l_suppkey"], "listed", "seen", F.lit("2005-01-01").cast("date"))


_ROUND = "obs AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS level FROM events)"


def _levels(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 25).cast("long").alias("level"))


@book.add(f"""WITH {_ROUND}, c AS (SELECT *, lag(level) OVER w AS before, row_number() OVER w AS k FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
 SELECT user_id, event_type, ts, event_id, level, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS vintage_seq FROM c WHERE k = 1 OR level IS DISTINCT FROM before""")
def vintage_assembly(spark, sf):
    return etl.assemble_vintages(_levels(spark, sf), ["user_id", "event_type"], "ts", ["level"], ["event_id"])


@book.add("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS wave FROM events")
def wave_split(spark, sf):
    return etl.waves(table(spark, sf, "events"), ["user_id", "event_type"], "ts", ["event_id"]).select("event_id", "user_id", "event_type", "wave")


def _actions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("security_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 2.0).otherwise(1.0).alias("split"), F.lit(1.25).alias("payout"), F.col("o_orderdate").alias("announced"), F.concat(F.lit("act-"), F.col("o_orderkey")).alias("action_id"))


@book.add("""WITH a AS (SELECT o_custkey AS security_id, CAST(o_orderdate AS DATE) AS day, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS s, o_orderdate FROM orders),
 r AS (SELECT security_id, day, sum(s) OVER w AS twos, count(*) OVER w AS n, max(o_orderdate) OVER w AS known, row_number() OVER (PARTITION BY security_id, day ORDER BY o_orderkey DESC) AS k FROM a WINDOW w AS (PARTITION BY security_id ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING))
 SELECT security_id, day, pow(2.0, twos) AS split_factor_cum, round(ln(pow(2.0, twos) * pow(1.25, n)), 6) AS log_total, known AS knowledge_time, CAST(n AS INTEGER) AS n_actions FROM r WHERE k = 1""")
def cum_factor(spark, sf):
    f = etl.adjustment_factors(_actions(spark, sf), "security_id", "day", ["o_orderkey"], "split", "payout", "announced", "action_id")
    return f.select("security_id", "day", "split_factor_cum", r6(F.log("total_return_factor_cum")).alias("log_total"), "knowledge_time", F.size("derived_from_action_ids").alias("n_actions"))


@book.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FY' || year(o_orderdate) WHEN o_orderkey % 3 = 1 THEN 'FY+2' ELSE 'LTM' END AS label FROM orders""")
def fiscal_labels(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "FY-3").when(F.col("o_orderkey") % 3 == 1, "FY2").otherwise("LTM")
    return table(spark, sf, "orders").select("o_orderkey", etl.fiscal_label(raw, F.col("o_orderdate")).alias("label"))


@book.add("SELECT s_suppkey, 'name' AS id_scheme, s_name AS id_value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier")
def identifier_map(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return etl.identifier_map(s, "s_suppkey", ["name", "nation"], [])


@book.add("SELECT l_suppkey, CAST(l_shipdate AS DATE) AS event_date, CAST(l_shipdate AS DATE) + INTERVAL 21 HOURS AS knowledge_time, count(*) AS n FROM lineitem GROUP BY ALL")
def bar_stamps(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("event_date"), F.lit(None).cast("timestamp_ntz").alias("provided"))
    s = etl.stamp_bars(li, "provided", "event_date", F.lit("2005-01-01").cast("timestamp_ntz"))
    return s.groupBy("l_suppkey", "event_date", "knowledge_time").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT count(*) AS row_count, max(ts) AS max_knowledge_time FROM events")
def lineage(spark, sf):
    return etl.lineage(table(spark, sf, "events"), "ts").select("row_count", "max_knowledge_time")


@book.add("SELECT event_type, 'kind_' || event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def metric_rename(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.col("event_type"))
    kept, _ = etl.renamed(e, "kind", {"view": "kind_view", "click": "kind_click"})
    return kept.groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


# -- data quality ---------------------------------------------------------------


@book.add("SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, sf):
    li = table(spark, sf, "lineitem")
    d = quality.duplicates(li, ["l_orderkey", "l_linenumber"], sorted(li.columns))
    return d.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("extra"))


_STEPS = f"WITH {DAILY}, q AS (SELECT security_id, event_date, CAST(floor(close / 100) AS BIGINT) AS lvl FROM daily)"


@book.add(f"""{_STEPS}, c AS (SELECT *, CASE WHEN lvl IS DISTINCT FROM lag(lvl) OVER w THEN 1 ELSE 0 END AS ch FROM q WINDOW w AS (PARTITION BY security_id ORDER BY event_date)),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY security_id ORDER BY event_date) AS isl FROM c)
 SELECT security_id, min(event_date) AS run_start, max(event_date) AS run_end, count(*) AS run_length, min(lvl) AS run_value FROM i GROUP BY security_id, isl HAVING count(*) >= 5""")
def dq_stale_runs(spark, sf):
    q = daily(spark, sf).select("security_id", "event_date", F.floor(F.col("close") / 100).cast("long").alias("lvl"))
    return quality.stale_runs(q, ["security_id"], ["event_date"], "lvl", 5)


@book.add("SELECT 'doc_id' AS column_name, count(doc_id) / count(*) AS coverage FROM documents UNION ALL SELECT 'text', count(text) / count(*) FROM documents UNION ALL SELECT 'quality', (SELECT count(quality) FROM labels) / count(*) FROM documents")
def dq_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return quality.column_coverage(d)


@book.add("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem WHERE l_extendedprice <= 2000 AND (l_extendedprice - 1500 <= 0)")
def dq_bad_prices(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") - 1500)
    return quality.bad_prices(li, ["p"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


@book.add(f"""WITH {FACTS}, v AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY vintage_seq) AS before FROM facts) SELECT event_id, user_id, event_type FROM v WHERE before >= ts""")
def dq_vintage_order(spark, sf):
    return quality.vintage_order(facts(spark, sf), ["user_id", "event_type"], "ts", "vintage_seq").select("event_id", "user_id", "event_type")


@book.add("""SELECT l.l_suppkey AS security_id, CAST(l.l_shipdate AS DATE) AS event_date, count(*) AS n FROM lineitem l WHERE l.l_suppkey % 5 = 0 AND CAST(l.l_shipdate AS DATE) > DATE '2000-06-30' GROUP BY 1, 2""")
def dq_after_delisting(spark, sf):
    bars = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("event_date"))
    listings = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("2000-06-30")).cast("date").alias("delisting_date"))
    return quality.after_delisting(bars, listings, "security_id", "event_date").groupBy("security_id", "event_date").agg(F.count(F.lit(1)).alias("n"))


@book.add("""SELECT 'negative_volume' AS check_name, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS failures FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0)
 UNION ALL SELECT 'missing_mandatory', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NULL OR l_shipdate IS NULL)
 UNION ALL SELECT 'fx', 'SKIP', 0""")
def dq_battery(spark, sf):
    li = table(spark, sf, "lineitem")
    return quality.run_battery({"negative_volume": lambda: quality.negative_volume(li, "l_quantity"), "missing_mandatory": lambda: quality.missing_mandatory(li, ["l_orderkey", "l_shipdate"]), "fx": lambda: None}, spark)
