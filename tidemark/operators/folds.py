"""Walk-forward folds and the choice of their training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FoldRule:
    train_steps: int
    test_steps: int
    step: int | None = None
    expanding: bool = True
    purge: bool = True
    embargo: float = 0.0

    def check(self, horizon: int) -> None:
        if horizon > 1 and not self.purge:
            raise ValueError("overlapping horizons need purging")
        if horizon > 1 and 0 < self.embargo < 1:
            raise ValueError("an embargo below one horizon does not cover it")


def folds(days: list, rule: FoldRule) -> list[dict]:
    """Disjoint, complete test windows over decision days, in order."""
    out, lo = [], rule.train_steps
    while lo + rule.test_steps <= len(days):
        first = 0 if rule.expanding else lo - rule.train_steps
        test = days[lo : lo + rule.test_steps]
        out.append({"fold_id": len(out), "train_from": days[first], "train_to": days[lo - 1], "test_from": test[0], "test_to": test[-1], "fit_as_of": days[lo - 1]})
        lo += rule.step or rule.test_steps
    return out


def select_training(fold_table: DataFrame, records: DataFrame, rule: FoldRule, horizon: int) -> DataFrame:
    """Every fold against every record, with the first reason that excludes it, if any.

    fold_table is small (one row a fold). records: decision, target_start, target_end.
    The reasons in order: out_of_range, unrealized, purged, embargoed.
    """
    rule.check(horizon)
    j = records.crossJoin(F.broadcast(fold_table))
    overlaps = (F.col("target_end") > F.col("test_from")) & (F.col("target_start") < F.col("test_to"))
    length = F.datediff("target_end", "target_start")
    late = (F.col("target_end") > F.col("test_to")) & (F.datediff("target_start", "test_to") < rule.embargo * length)
    reason = F.when(~F.col("decision").between(F.col("train_from"), F.col("train_to")), "out_of_range").when(F.col("target_end") > F.col("fit_as_of"), "unrealized")
    if rule.purge:
        reason = reason.when(overlaps, "purged")
    if horizon > 1 and rule.embargo > 0:
        reason = reason.when(late, "embargoed")
    return j.withColumn("reason", reason)


def refit_days(decisions: DataFrame, day: str, stride: int) -> DataFrame:
    """The latest refit day at or before each decision day, refitting every `stride` days."""
    from .calendar import indexed

    i = indexed(decisions.select(day).distinct(), day)
    at = i.withColumn("_r", (F.floor(F.col("idx") / stride) * stride).cast("int"))
    refits = i.select(F.col("idx").alias("_r"), F.col(day).alias("fit_day"))
    return at.join(refits, "_r").select(day, "fit_day")


def overlapping_tests(fold_rows: list[dict]) -> list[tuple[int, int]]:
    """Pairs of neighbouring folds whose test windows touch: must be none."""
    ordered = sorted(fold_rows, key=lambda f: f["test_from"])
    return [(a["fold_id"], b["fold_id"]) for a, b in zip(ordered, ordered[1:]) if b["test_from"] <= a["test_to"]]
