"""From raw rows to canonical, vintaged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minted_id(ticker: Column, exchange: Column, first_seen: Column, prefix: str = "SEC-") -> Column:
    """prefix + 12 hex digits of SHA-256(TICKER|EXCHANGE|first_seen)."""
    parts = F.concat_ws("|", F.upper(F.trim(ticker)), F.upper(F.trim(exchange)), first_seen.cast("date").cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(parts, 256), 1, 12))


def id_collisions(df: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """Ids that stand for more than one key."""
    return df.groupBy(id_col).agg(F.count_distinct(F.struct(*key)).alias("keys")).where("keys > 1")


def first_seen(df: DataFrame, by: list[str], listed: str, observed: str, retrieved: Column) -> DataFrame:
    """Listing date, else first observation, else the retrieval date."""
    return df.groupBy(*by).agg(F.coalesce(F.min(listed), F.min(observed), F.first(retrieved)).alias("first_seen"))


def stamp_bars(df: DataFrame, provided: str, event: str, retrieved: Column, close_hour: int = 21, pit: bool = True) -> DataFrame:
    """knowledge_time: the provider's stamp, else the close of the event day; retrieval time (a downgrade) if not point-in-time."""
    close = F.col(event).cast("timestamp_ntz") + F.expr(f"INTERVAL {close_hour} HOURS")
    stamp = F.coalesce(F.col(provided), close) if pit else retrieved
    return df.withColumn("knowledge_time", stamp).withColumn("knowledge_basis", F.when(F.lit(not pit), "retrieval").when(F.col(provided).isNotNull(), "provider").otherwise("event_close"))


def stamp_observations(df: DataFrame, provided: str, period_end: str, lag_days: int) -> DataFrame:
    """knowledge_time: the provider's stamp, else the period's end and a lag."""
    guess = F.col(period_end).cast("timestamp_ntz") + F.expr(f"INTERVAL {lag_days} DAYS")
    return df.withColumn("knowledge_time", F.coalesce(F.col(provided), guess)).withColumn("knowledge_basis", F.when(F.col(provided).isNotNull(), "provider").otherwise("period_lag"))


def assemble_vintages(df: DataFrame, event_key: list[str], knowledge: str, stable: list[str], ties: list[str]) -> DataFrame:
    """Numbers the vintages of each event key; a row equal to its predecessor in all stable columns is no vintage."""
    w = Window.partitionBy(*event_key).orderBy(knowledge, *ties)
    row = F.struct(*stable)
    changed = F.lag(F.lit(1)).over(w).isNull() | ~row.eqNullSafe(F.lag(row).over(w))
    kept = df.withColumn("_new", changed).where("_new").drop("_new")
    return kept.withColumn("vintage_seq", (F.row_number().over(w) - 1).cast("long"))


def append_vintages(held: DataFrame, new: DataFrame, event_key: list[str], knowledge: str, stable: list[str]) -> DataFrame:
    """Rows of `new` that add a vintage to `held`: later than, and different from, its latest."""
    latest = held.groupBy(*event_key).agg(F.max("vintage_seq").alias("_seq"), F.max(knowledge).alias("_known"), F.max_by(F.struct(*stable), "vintage_seq").alias("_last"))
    j = new.join(latest, event_key, "left").where(F.col("_known").isNull() | ((F.col(knowledge) > F.col("_known")) & ~F.struct(*stable).eqNullSafe(F.col("_last"))))
    w = Window.partitionBy(*event_key).orderBy(knowledge)
    return j.withColumn("vintage_seq", F.coalesce(F.col("_seq"), F.lit(-1)) + F.row_number().over(w)).drop("_seq", "_known", "_last")


def append_problems(held: DataFrame, new: DataFrame, event_key: list[str], knowledge: str) -> DataFrame:
    """Why `new` may not replace `held`: rows that went missing, and additions that are not strictly newer."""
    gone = held.exceptAll(new).select(*event_key, F.lit("missing_predecessor").alias("problem"))
    top = held.groupBy(*event_key).agg(F.max(knowledge).alias("_known"))
    late = new.exceptAll(held).join(top, event_key).where(F.col(knowledge) <= F.col("_known")).select(*event_key, F.lit("not_newer").alias("problem"))
    return gone.unionByName(late)


def waves(df: DataFrame, key: list[str], knowledge: str, ties: list[str], out: str = "wave") -> DataFrame:
    """The nth arrival of a key belongs to wave n, from 0."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*key).orderBy(knowledge, *ties)) - 1).cast("long"))


def merge_interval_vintages(df: DataFrame, key: list[str], end: str, knowledge: str, grace_days: int = 1) -> tuple[DataFrame, DataFrame]:
    """(one row a key: stamped at its opening, ended by its closure; closures published too late)."""
    closed = F.col(end).isNotNull()
    g = df.groupBy(*key).agg(F.min(knowledge).alias(knowledge), F.max(end).alias(end), F.max(F.when(closed, F.col(knowledge))).alias("closed_at"))
    late = g.where(F.col("closed_at") > F.col(end).cast("timestamp_ntz") + F.expr(f"INTERVAL {grace_days} DAYS"))
    return g.drop("closed_at"), late


def adjustment_factors(actions: DataFrame, by: str, day: str, order: list[str], split: str, payout: str, announced: str, action_id: str) -> DataFrame:
    """Running products by action date: splits, and total return with payout; knowledge and lineage run along.

    The product multiplies along the order, one step a row: exact, where
    exp(sum(log)) would round. Several actions of one date give one row. Only
    the lineage lists, which the table asks for, grow with the history.
    """
    w = Window.partitionBy(by).orderBy(day, *order).rowsBetween(Window.unboundedPreceding, 0)
    product = lambda c: F.coalesce(F.product(c).over(w), F.lit(1.0))
    run = actions.select(by, day, *order, product(F.col(split)).alias("split_factor_cum"), product(F.col(split) * F.col(payout)).alias("total_return_factor_cum"), F.max(announced).over(w).alias("knowledge_time"), F.collect_list(action_id).over(w).alias("derived_from_action_ids"), F.count(F.lit(1)).over(w).alias("_k"))
    rest = ["split_factor_cum", "total_return_factor_cum", "knowledge_time", "derived_from_action_ids"]
    return run.groupBy(by, day).agg(F.max_by(F.struct(*rest), "_k").alias("_l")).select(by, day, "_l.*")


def fiscal_label(label: Column, period_end: Column) -> Column:
    """FY-3 becomes FY<year of its period end>; FY1, an estimate, becomes FY+1."""
    past = F.regexp_extract(label, r"^FY-?0$|^FY-\d+$", 0) != ""
    ahead = F.regexp_extract(label, r"^FY(\d+)$", 1)
    return F.when(past, F.concat(F.lit("FY"), F.year(period_end).cast("string"))).when(ahead != "", F.concat(F.lit("FY+"), ahead)).otherwise(label)


def renamed(df: DataFrame, col: str, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a known name, renamed; rows whose name is not mapped)."""
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = df.withColumn("_new", F.try_element_at(mapping, F.col(col)))
    return out.where("_new is not null").withColumn(col, F.col("_new")).drop("_new"), out.where("_new is null").drop("_new")


def identifier_map(df: DataFrame, security: str, schemes: list[str], extra: list[str]) -> DataFrame:
    """One row for each identifier of a security."""
    rows = F.array(*[F.struct(F.lit(s).alias("id_scheme"), F.col(s).cast("string").alias("id_value")) for s in schemes])
    return df.select(security, *extra, F.explode(rows).alias("_i")).select(security, "_i.*", *extra).where("id_value is not null")


def successors(records: DataFrame, ids: DataFrame, ticker: str, exchange: str, successor: str) -> tuple[DataFrame, DataFrame]:
    """(records with successor_security_id, records whose successor's ticker has no id on its exchange).

    ids: security_id and the same ticker and exchange columns, one row each.
    A record without a successor keeps null and is no error.
    """
    known = ids.select(F.col("security_id").alias("successor_security_id"), F.col(ticker).alias(successor), exchange)
    j = records.join(known, [successor, exchange], "left")
    lost = F.col(successor).isNotNull() & F.col("successor_security_id").isNull()
    return j.where(~lost).select(*records.columns, "successor_security_id"), j.where(lost).select(*records.columns)


def lineage(df: DataFrame, knowledge: str) -> DataFrame:
    """Row count, latest knowledge and an order-free content hash, in one pass."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.max(knowledge).alias("max_knowledge_time"), F.sum(h.cast("decimal(38,0)")).alias("content_sum"), F.bit_xor(h).alias("content_xor"))


def delisting_view(listings: DataFrame, terminals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(listings with their terminal return, terminals that match no listing interval or several)."""
    t = terminals.select(key, F.col("effective_date").alias("_eff"), "terminal_return")
    hit = t.join(listings.select(key, "listing_date", "delisting_date"), key, "left")
    inside = F.col("_eff").between(F.col("listing_date"), F.coalesce(F.col("delisting_date"), F.lit("9999-12-31").cast("date")))
    n = hit.groupBy(key, "_eff").agg(F.sum(inside.cast("int")).alias("n"))
    good = hit.where(inside).join(n.where("n = 1"), [key, "_eff"]).select(key, "listing_date", F.col("terminal_return").alias("delisting_return"))
    return listings.join(good, [key, "listing_date"], "left"), n.where("n is null or n <> 1").withColumn("n", F.coalesce("n", F.lit(0)))
