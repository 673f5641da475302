"""Trading-day grids and shifts. A calendar is one column of distinct days, small against the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_days(df: DataFrame, day: str) -> DataFrame:
    return df.select(day).where(F.col(day).isNotNull()).distinct()


def indexed(days: DataFrame, day: str) -> DataFrame:
    """day, idx from 0. Orders one row a calendar day, so a single task is enough."""
    return days.withColumn("idx", F.row_number().over(Window.orderBy(day)) - 1)


def shifted(days: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """Each day with the day n trading days later, null past the end."""
    return days.withColumn(out, F.lead(day, n).over(Window.orderBy(day)) if n >= 0 else F.lag(day, -n).over(Window.orderBy(day)))


def month_ends(days: DataFrame, day: str) -> DataFrame:
    return days.groupBy(F.year(day).alias("y"), F.month(day).alias("m")).agg(F.max(day).alias(day)).select(day)


def week_ends(days: DataFrame, day: str, anchor: int = 4) -> DataFrame:
    """The last trading day of each ISO week at or before the anchor weekday (0: Monday)."""
    iso_year, week = F.expr(f"extract(YEAROFWEEK FROM {day})"), F.weekofyear(day)
    return days.where(F.weekday(day) <= anchor).groupBy(iso_year.alias("y"), week.alias("w")).agg(F.max(day).alias(day)).select(day)


def every(grid: DataFrame, day: str, stride: int, first: int = 0) -> DataFrame:
    """Every stride-th day of a grid from the one at `first`."""
    i = indexed(grid, day)
    return i.where((F.col("idx") >= first) & ((F.col("idx") - first) % stride == 0)).select(day)


def overlap_counts(grid: DataFrame, day: str, horizon: int) -> DataFrame:
    """Other grid points whose window of `horizon` steps overlaps: |i - j| < horizon. In closed form."""
    i = indexed(grid, day).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    before, after = F.least(F.col("idx"), F.lit(horizon - 1)), F.least(F.col("n") - 1 - F.col("idx"), F.lit(horizon - 1))
    return i.select(day, (before + after).alias("overlaps"))
