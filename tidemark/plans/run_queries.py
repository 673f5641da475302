"""Queries over generated worlds, whole runs, providers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.finite import r6
from ..operators import etl, pit, quality, synth
from ..streaming import streams
from .base import MONTHLY, Book, monthly, table
from .experiment import Experiment, feature_frame, report, walk_forward
from ..operators.folds import FoldRule

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.add()
def walk_forward_ic(spark, sf):
    """Fits two folds on the supplier panel and returns the out-of-sample rank IC by month."""
    e = Experiment(rounds=3, rule=FoldRule(train_steps=36, test_steps=20))
    panel = monthly(spark, sf).select(F.col("security_id").cast("string").alias("security_id"), "m", "close", "market_cap")
    scores, _ = walk_forward(feature_frame(panel, e), e)
    return report(scores, e)["ic"].select("m", "names", r6(F.col("ic")).alias("ic"))


@book.add()
def synthetic_world(spark, sf):
    w = synth.SCENARIOS["baseline"]
    return synth.generate(spark, w).select("security_id", "m", r6(F.col("close")).alias("close"), r6(F.col("exposure")).alias("exposure"), "delisted")


@book.add()
def seeded_errors_found(spark, sf):
    """Every seeded error class against the checks that must find it."""
    bars, truth = synth.seed_errors(synth.bars(synth.generate(spark, synth.SCENARIOS["baseline"])))
    runs = quality.stale_runs(bars, ["security_id"], ["event_date"], "close", synth.FROZEN + 1)
    found = {
        "duplicate_bar": quality.duplicates(bars, ["security_id", "event_date"], ["close"]),
        "negative_price": quality.bad_prices(bars, ["close"]),
        "stale_price": bars.join(runs, "security_id").where("event_date > run_start and event_date <= run_end"),
        "impossible_volume": quality.negative_volume(bars, "volume"),
        "missing_mandatory": quality.missing_mandatory(bars, ["close"]),
        "inverted_timestamp": quality.known_before_event(bars, "knowledge_time", "event_date"),
    }
    rows = None
    for name, df in found.items():
        d = df.select(F.lit(name).alias("error"), "security_id", "event_date").distinct()
        rows = d if rows is None else rows.unionByName(d)
    j = truth.withColumn("seeded", F.lit(1)).join(rows.withColumn("hit", F.lit(1)), ["error", "security_id", "event_date"], "full_outer")
    return j.groupBy("error").agg(F.count("seeded").alias("seeded"), F.count("hit").alias("found"), F.sum((F.col("seeded").isNotNull() & F.col("hit").isNotNull()).cast("long")).alias("both"))


@book.add(f"WITH {MONTHLY}, f AS (SELECT * FROM (VALUES ('USD', 'USD', 1.0), ('EUR', 'USD', 1.1)) t(b, q, r)), p AS (SELECT security_id, m, close, CASE security_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS ccy FROM monthly) SELECT security_id, m, ccy, round(close * r, 9) AS usd FROM p LEFT JOIN f ON b = ccy")
def fx_conversion(spark, sf):
    p = monthly(spark, sf).withColumn("ccy", F.when(F.col("security_id") % 3 == 0, "USD").when(F.col("security_id") % 3 == 1, "EUR").otherwise("GBP")).withColumn("event_date", F.col("m")).withColumn("to", F.lit("USD"))
    fx = p.select("event_date").distinct().select("event_date", F.lit("EUR").alias("base_ccy"), F.lit("USD").alias("quote_ccy"), F.lit(1.1).alias("rate"))
    out = pit.exchange_rate(p, fx, "event_date", "ccy", "to")
    return out.select("security_id", "m", "ccy", F.round(F.col("close") * F.col("rate"), 9).alias("usd"))


@book.add("""WITH a AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS level FROM events WHERE ts < TIMESTAMP '2024-01-16'),
 b AS (SELECT user_id, event_type, max(ts) AS top FROM a GROUP BY 1, 2) SELECT e.user_id, e.event_type, count(*) AS n FROM events e JOIN b USING (user_id, event_type) WHERE e.ts >= TIMESTAMP '2024-01-16' AND e.ts <= b.top + INTERVAL 30 DAYS GROUP BY 1, 2""")
def late_arrivals(spark, sf):
    e = table(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    top = e.where(F.col("ts") < cut).groupBy("user_id", "event_type").agg(F.max("ts").alias("top"))
    return e.where(F.col("ts") >= cut).join(top, ["user_id", "event_type"]).where(F.col("ts") <= F.col("top") + F.expr("INTERVAL 30 DAYS")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT l_suppkey, CAST(n AS BIGINT) AS n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-01' AND l_suppkey % 2 = 0 GROUP BY 1)")
def append_problems(spark, sf):
    """A successor dataset that lost rows: each loss is reported."""
    li = table(spark, sf, "lineitem")
    lost = li.where("l_shipdate > timestamp_ntz'2000-06-01' and l_suppkey % 2 = 0")
    kept = li.where("not (l_shipdate > timestamp_ntz'2000-06-01' and l_suppkey % 2 = 0)")
    p = etl.append_problems(lost.unionByName(kept), kept, ["l_suppkey"], "l_shipdate")
    return p.where("problem = 'missing_predecessor'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT l_suppkey, DATE '1995-01-01' AS listing_date, -0.5 AS delisting_return FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 5 = 0 UNION ALL SELECT l_suppkey, DATE '1995-01-01', NULL FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 5 <> 0")
def delisting_view(spark, sf):
    ids = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    listings = ids.select("l_suppkey", F.lit("1995-01-01").cast("date").alias("listing_date"), F.when(F.col("l_suppkey") % 5 == 0, F.lit("2000-06-15")).cast("date").alias("delisting_date"))
    terminals = ids.where("l_suppkey % 5 = 0").select("l_suppkey", F.lit("2000-06-15").cast("date").alias("effective_date"), F.lit(-0.5).alias("terminal_return"))
    good, _ = etl.delisting_view(listings, terminals, "l_suppkey")
    return good.select("l_suppkey", "listing_date", "delisting_return")


@book.add("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    out = streams.run_to_table(streams.tumbling(streams.read_events(spark, sf), "6 hours", "10 days"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r6(F.col("total")).alias("total"))


@book.add("""WITH obs AS (SELECT user_id, event_type, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS level FROM events),
 c AS (SELECT *, lag(level) OVER w AS before, row_number() OVER w AS k FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
 SELECT user_id, event_type, ts, event_id, level, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS vintage_seq FROM c WHERE k = 1 OR level IS DISTINCT FROM before""")
def stream_vintages(spark, sf):
    levels = streams.read_events(spark, sf).select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") / 25).cast("long").alias("level"))
    return streams.run_to_table(streams.vintages(levels))
