"""Projections of the driver's tables onto panels, in Spark and in SQL, and the query decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Book:
    """The queries of one module, with their SQL where it can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents() -> F.Column:
    return F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))


def _bar(g) -> DataFrame:
    qty = F.sum(F.col("l_quantity").cast("long")).cast("double")
    money = _cents().cast("double")
    return g.agg((money / qty / 100).alias("close"), qty.alias("volume"), (money / 100).alias("market_cap"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """security_id (supplier), event_date, close, volume, market_cap. Sums are of integers, so exact in any order."""
    return _bar(table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("event_date")))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, m (months since year 0), close, volume, market_cap."""
    m = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    return _bar(table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), m.alias("m")))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, country, sector (region)."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("security_id"), F.col("n_nationkey").cast("int").alias("country"), F.col("n_regionkey").cast("int").alias("sector"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, event_type, ts, event_id, value, vintage_seq: each (user, type) is one restated fact."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("vintage_seq"))


def spells(spark: SparkSession, sf: str) -> DataFrame:
    """c_id, valid_from, valid_to (null: open), status: each customer's order day opens an interval that the next one ends."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_id"), F.to_date("o_orderdate").alias("valid_from")).agg(F.max("o_orderstatus").alias("status"), F.count(F.lit(1)).alias("orders"))
    return o.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(Window.partitionBy("c_id").orderBy("valid_from")), 1))


def month_returns(spark: SparkSession, sf: str) -> DataFrame:
    """security_id, m, close, market_cap, past (one-month return), fwd (next month's return); consecutive months only."""
    from pyspark.sql import Window

    w = Window.partitionBy("security_id").orderBy("m")
    p = monthly(spark, sf)
    past = F.when(F.lag("m").over(w) == F.col("m") - 1, F.col("close") / F.lag("close").over(w) - 1)
    fwd = F.when(F.lead("m").over(w) == F.col("m") + 1, F.lead("close").over(w) / F.col("close") - 1)
    return p.select("security_id", "m", "close", "volume", "market_cap", past.alias("past"), fwd.alias("fwd"))


_BAR = """CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/100 AS close,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
 CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100 AS market_cap FROM lineitem GROUP BY 1, 2"""
DAILY = f"daily AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS event_date, {_BAR})"
MONTHLY = f"monthly AS (SELECT l_suppkey AS security_id, CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS INTEGER) AS m, {_BAR})"
SECTORS = "sectors AS (SELECT s_suppkey AS security_id, CAST(n_nationkey AS INTEGER) AS country, CAST(n_regionkey AS INTEGER) AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
FACTS = "facts AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS vintage_seq FROM events)"
SPELLS = """spells AS (SELECT *, CAST(lead(valid_from) OVER (PARTITION BY c_id ORDER BY valid_from) - INTERVAL 1 DAY AS DATE) AS valid_to
 FROM (SELECT o_custkey AS c_id, CAST(o_orderdate AS DATE) AS valid_from, max(o_orderstatus) AS status, count(*) AS orders FROM orders GROUP BY 1, 2))"""
RETURNS = MONTHLY + """, rets AS (SELECT security_id, m, close, volume, market_cap,
 CASE WHEN lag(m) OVER w = m - 1 THEN close / lag(close) OVER w - 1 END AS past,
 CASE WHEN lead(m) OVER w = m + 1 THEN lead(close) OVER w / close - 1 END AS fwd
 FROM monthly WINDOW w AS (PARTITION BY security_id ORDER BY m))"""
