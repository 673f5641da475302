"""Data-quality checks. Each returns the offending rows or keys; run_battery gives every check one verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finite import covered
from .pit import asof_join, next_join


def duplicates(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All but the first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k > 1").drop("_k")


def bad_prices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a price that is there but not positive and finite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & (~covered(F.col(c)) | (F.col(c) <= 0)))
    return df.where(bad)


def stale_runs(df: DataFrame, by: list[str], order: list[str], v: str, least: int) -> DataFrame:
    """Runs of at least `least` equal consecutive values: by, start, end, length, value."""
    w = Window.partitionBy(*by).orderBy(*order)
    island = F.sum((~F.col(v).eqNullSafe(F.lag(v).over(w))).cast("int")).over(w)
    g = df.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"), F.count(F.lit(1)).alias("run_length"), F.first(v).alias("run_value"))
    return g.where(F.col("run_length") >= least).drop("_i")


def spells(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Run-length encoding of a state path: by, state, spell_start, spell_end, steps.

    A spell ends where the state changes or the order, a whole number, skips a step.
    """
    w = Window.partitionBy(*by).orderBy(order)
    same = F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.lag(order).over(w) == F.col(order) - 1)
    island = F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w)
    g = df.withColumn("_i", island).groupBy(*by, "_i", state)
    return g.agg(F.min(order).alias("spell_start"), F.max(order).alias("spell_end"), F.count(F.lit(1)).alias("steps")).drop("_i")


def negative_volume(df: DataFrame, v: str) -> DataFrame:
    return df.where(F.col(v) < 0)


def missing_mandatory(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def known_before_event(df: DataFrame, knowledge: str, event: str) -> DataFrame:
    return df.where(F.to_date(knowledge) < F.to_date(event))


def column_coverage(df: DataFrame) -> DataFrame:
    """column, coverage: share of non-null values, 0 for an empty table; one pass."""
    n = F.count(F.lit(1))
    row = df.agg(*[F.coalesce(F.try_divide(F.count(c).cast("double"), n), F.lit(0.0)).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", "coverage")


def vintage_order(df: DataFrame, event_key: list[str], knowledge: str, sequence: str) -> DataFrame:
    """Vintages that are not known strictly after the one before."""
    before = F.lag(knowledge).over(Window.partitionBy(*event_key).orderBy(sequence))
    return df.withColumn("_b", before).where(F.col("_b") >= F.col(knowledge)).drop("_b")


def after_delisting(bars: DataFrame, listings: DataFrame, by: str, event: str) -> DataFrame:
    """Bars after the last delisting of a name that has no open listing."""
    g = listings.groupBy(by).agg(F.bool_or(F.col("delisting_date").isNull()).alias("_open"), F.max("delisting_date").alias("_last"))
    return bars.join(g, by).where(~F.col("_open") & (F.col(event) > F.col("_last"))).drop("_open", "_last")


def orphan_lineage(factors: DataFrame, actions: DataFrame) -> DataFrame:
    """Factor rows that name an action that does not exist."""
    ids = factors.withColumn("action_id", F.explode("derived_from_action_ids"))
    return ids.join(actions.select("action_id").distinct(), "action_id", "left_anti")


def split_against_jump(actions: DataFrame, bars: DataFrame, by: str, event: str, close: str, tolerance: float) -> DataFrame:
    """Splits whose price jump is further than `tolerance` (as a logarithm) from the ratio."""
    a = actions.select(by, "action_id", "effective_date", "ratio", F.date_sub("effective_date", 1).alias("_eve"))
    b = bars.select(by, F.col(event).alias("_e"), F.col(close).alias("_c"))
    g = asof_join(a, b, [by], "_eve", "_e", ["_e"], known_as="_e").withColumnRenamed("_c", "before").drop("_e")
    g = next_join(g, b, [by], "_eve", "_e").withColumnRenamed("_c", "after").drop("_e", "_eve")
    return g.where(F.abs(F.log(F.col("before") / F.col("after")) - F.log("ratio")) > tolerance)


def retrieved_before_known(df: DataFrame, knowledge: str, retrieved: str) -> DataFrame:
    return df.where(F.col(knowledge) > F.col(retrieved))


def schema_problems(df: DataFrame, columns: dict[str, str], nullable: set[str], forbidden: set[str] = frozenset()) -> list[str]:
    """All differences between a table and its declaration, not only the first."""
    have = dict(df.dtypes)
    out = [f"undeclared column {c}" for c in have if c not in columns and c not in forbidden]
    out += [f"forbidden column {c}" for c in have if c in forbidden]
    out += [f"missing column {c}" for c in columns if c not in have]
    out += [f"column {c} is {have[c]}, declared {t}" for c, t in columns.items() if c in have and have[c] != t]
    must = [c for c in columns if c in have and c not in nullable]
    if must:
        counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in must]).first()
        out += [f"column {c} has {counts[c]} nulls" for c in must if counts[c]]
    return out


def run_battery(checks: dict[str, Callable[[], DataFrame | None]], spark) -> DataFrame:
    """check, status (PASS, FAIL or SKIP), failures: each check exactly once; a check that returns None is skipped."""
    rows = []
    for name, check in checks.items():
        bad = check()
        n = None if bad is None else bad.count()
        rows.append((name, "SKIP" if n is None else "FAIL" if n else "PASS", n or 0))
    return spark.createDataFrame(rows, "check_name string, status string, failures long")
