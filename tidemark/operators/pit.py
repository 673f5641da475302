"""Point-in-time operators: what was known, about when, as of when.

Knowledge is inclusive: a row is visible at `as_of` if its knowledge time plus
the publication lag is at or before it. Validity intervals include both ends.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


class PitError(ValueError):
    """A request that has no defined answer."""


def effective_lag(configured: dt.timedelta, asked: dt.timedelta | None = None) -> dt.timedelta:
    """A call may extend the configured lag, never shorten it."""
    lags = [configured, *([asked] if asked is not None else [])]
    if any(x < dt.timedelta(0) for x in lags):
        raise PitError("a publication lag is never negative")
    return max(lags)


def _seconds(lag: dt.timedelta) -> str:
    return f"INTERVAL {int(lag.total_seconds())} SECONDS"


def knowable(knowledge: Column, as_of: Column, lag: dt.timedelta = dt.timedelta(0)) -> Column:
    return knowledge <= as_of - F.expr(_seconds(lag))


def need_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise PitError(f"unknown columns {missing}; the table has {df.columns}")


def key_filter(df: DataFrame, keys: dict) -> DataFrame:
    """Equality, or membership for lists."""
    need_columns(df, list(keys))
    for name, value in keys.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def contains(day: Column, start: str, end: str) -> Column:
    return day.between(F.col(start), F.coalesce(F.col(end), F.lit(OPEN_END).cast("date")))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    far = F.lit(OPEN_END).cast("date")
    return F.greatest(start_a, start_b) <= F.least(F.coalesce(end_a, far), F.coalesce(end_b, far))


def latest_vintage(df: DataFrame, event_key: list[str], knowledge: str, sequence: str, as_of: Column, lag: dt.timedelta = dt.timedelta(0), keys: dict | None = None) -> DataFrame:
    """One row an event key: the largest (knowledge, sequence) among the knowable rows.

    Key filters go below the choice of vintage, where a filter on a value would
    change the answer. The choice is a map-side combinable max over a struct:
    one shuffle, no sort.
    """
    df = key_filter(df, keys or {}).where(knowable(F.col(knowledge), as_of, lag))
    rest = [c for c in df.columns if c not in event_key]
    best = F.max_by(F.struct(*rest), F.struct(knowledge, sequence)).alias("_best")
    return df.groupBy(*event_key).agg(best).select(*event_key, "_best.*")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, ties: list[str], lag: dt.timedelta = dt.timedelta(0), known_as: str = "knowledge_time_known") -> DataFrame:
    """For each left row the right row of its group with the largest time <= left_time - lag.

    Ties go to the largest `ties`. Unmatched rows keep nulls. Both sides are laid
    on one time line and the last right row is carried forward: one shuffle and
    one sort, whatever the number of matches. The lag moves the right side later.
    """
    need_columns(left, [*by, left_time])
    need_columns(right, [*by, right_time, *ties])
    line = [F.col("_t"), F.col("_side"), F.col("_ties")]
    return _carried(left, right, by, left_time, right_time, ties, lag, known_as, line)


def next_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str) -> DataFrame:
    """For each left row the right row of its group with the smallest time > left_time; the mirror of asof_join."""
    need_columns(left, [*by, left_time])
    need_columns(right, [*by, right_time])
    line = [F.col("_t").desc(), F.col("_side").desc(), F.col("_ties")]
    return _carried(left, right, by, left_time, right_time, [right_time], dt.timedelta(0), right_time, line)


def _carried(left, right, by, left_time, right_time, ties, lag, known_as, line) -> DataFrame:
    """Both sides on one time line in the order `line`; each left row gets the last right row before it."""
    rest = [c for c in right.columns if c not in by]
    held = F.struct(*[F.col(c) for c in rest])
    r = right.where(F.col(right_time).isNotNull()).select(*by, (F.col(right_time) + F.expr(_seconds(lag))).alias("_t"), F.lit(0).alias("_side"), F.struct(*ties).alias("_ties"), F.lit(None).cast(left_struct(left, by)).alias("_l"), held.alias("_r"))
    lcols = [c for c in left.columns if c not in by]
    lead = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_ties"].dataType).alias("_ties"), F.struct(*lcols).alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    w = Window.partitionBy(*by).orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    carried = r.unionByName(lead).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    out = [F.col(f"_m.{c}").alias(known_as if c == right_time else c) for c in rest]
    return carried.select(*by, "_l.*", *out)


def left_struct(left: DataFrame, by: list[str]):
    from pyspark.sql import types as T

    return T.StructType([f for f in left.schema.fields if f.name not in by])


def asof_join_ranged(left: DataFrame, right: DataFrame, by: list[str], row_id: str, left_time: str, right_time: str, ties: list[str], most: int = 1_000) -> DataFrame:
    """The same answer by range join and max_by: for right sides that are short in each group; refused where one has over `most` rows."""
    long = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).limit(1).collect()
    if long:
        raise PitError(f"a group of the right side has {long[0]['_n']} rows; asof_join takes any number")
    rest = [c for c in right.columns if c not in by]
    r = right.select(*by, F.struct(*rest).alias("_r"), F.col(right_time).alias("_t"), F.struct(right_time, *ties).alias("_k"))
    joined = left.join(r, [*by], "left").where(F.col("_t").isNull() | (F.col("_t") <= F.col(left_time)))
    best = joined.groupBy(*by, row_id).agg(F.max_by("_r", "_k").alias("_r"))
    return left.join(best, [*by, row_id], "left").select(*left.columns, *[F.col(f"_r.{c}").alias(f"right_{c}") for c in rest])


def interval_members(intervals: DataFrame, days: DataFrame, day: str, key: list[str], start: str, end: str, knowledge: str | None = None, as_of: str | None = None, bucket_days: int = 64) -> DataFrame:
    """(day, key) where an interval holds the day and, if asked, was known by as_of.

    A range join over day buckets: intervals are spread over the buckets they
    touch within the days' own span, days fall into one, and the join is on
    equal buckets. An open interval so costs as many rows as the span has buckets.
    """
    far = F.lit(OPEN_END).cast("date")
    span = days.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    i = intervals.withColumn("_end", F.coalesce(F.col(end), far)).crossJoin(F.broadcast(span)).where((F.col(start) <= F.col("_hi")) & (F.col("_end") >= F.col("_lo")))
    i = i.withColumn("_b", F.explode(F.sequence(number(F.greatest(start, "_lo")), number(F.least("_end", "_hi")))))
    d = days.withColumn("_b", number(F.col(day)))
    cond = F.col(day).between(F.col(start), F.col("_end"))
    if knowledge:
        cond &= F.col(knowledge) <= F.col(as_of)
    return d.join(i, "_b").where(cond).drop("_b", "_end", "_lo", "_hi")


def classification_asof(intervals: DataFrame, days: DataFrame, day: str, key: list[str], start: str, end: str, value: str, knowledge: str) -> DataFrame:
    """One class a key and day: of the intervals that hold the day, that with the latest (start, knowledge)."""
    held = interval_members(intervals, days, day, key, start, end)
    return held.groupBy(day, *key).agg(F.max_by(value, F.struct(start, knowledge)).alias(value))


def last_on_or_before(df: DataFrame, days: DataFrame, by: list[str], event: str, day: str, value: str, stale_days: int) -> DataFrame:
    """The latest non-null value at or before each day, null if older than stale_days."""
    seen = df.where(F.col(value).isNotNull()).select(*by, F.col(event).alias("_event"), F.col(value).alias("_value"))
    joined = asof_join(days, seen, by, day, "_event", ["_value"], known_as="observed")
    fresh = F.datediff(F.col(day), F.col("observed")) <= stale_days
    return joined.withColumn(value, F.when(fresh, F.col("_value"))).withColumn("observed", F.when(fresh, F.col("observed"))).drop("_value")


def step_lookup(df: DataFrame, steps: DataFrame, by: list[str], day: str, step_day: str, value: str, before: float = 1.0) -> DataFrame:
    """The step function's value in force on a day; `before` ahead of the first step."""
    s = steps.select(*by, F.col(step_day).alias("_event"), F.col(value).alias("_value"))
    return asof_join(df, s, by, day, "_event", ["_value"], known_as="_seen").withColumn(value, F.coalesce("_value", F.lit(before))).drop("_value", "_seen")


def first_event_in(df: DataFrame, events: DataFrame, by: list[str], row_id: str, after: str, through: str, event: str) -> DataFrame:
    """The earliest event with after < event <= through, if any: the next event after each row, kept if it is in time."""
    e = events.select(*by, F.col(event).alias("_event"), F.struct(*[c for c in events.columns if c not in by]).alias("_e"))
    j = next_join(df, e, by, after, "_event")
    return j.withColumn("first_event", F.when(F.col("_event") <= F.col(through), F.col("_e"))).drop("_event", "_e")


def last_day_in(df: DataFrame, days: DataFrame, by: list[str], row_id: str, start: str, through: str, day: str) -> DataFrame:
    """The last day of a group within [start, through]."""
    j = asof_join(df, days.select(*by, F.col(day).alias("_d")), by, through, "_d", ["_d"], known_as="_d")
    return j.withColumn("last_day", F.when(F.col("_d") >= F.col(start), F.col("_d"))).drop("_d")


def exchange_rate(df: DataFrame, fx: DataFrame, day: str, base: str, quote: str) -> DataFrame:
    """Exact-date rate, 1 within one currency, null where there is none."""
    f = fx.select(F.col("event_date").alias(day), F.col("base_ccy").alias(base), F.col("quote_ccy").alias(quote), "rate")
    return df.join(f, [day, base, quote], "left").withColumn("rate", F.when(F.col(base) == F.col(quote), 1.0).otherwise(F.col("rate")))


def truncate_future(df: DataFrame, knowledge: str, as_of: Column) -> DataFrame:
    """Rows not known by as_of are deleted; rows without a knowledge time stay."""
    need_columns(df, [knowledge])
    return df.where(F.col(knowledge).isNull() | (F.col(knowledge) <= as_of))
