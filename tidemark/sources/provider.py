"""Providers of raw tables: the protocol, request guards, a file-based and an in-memory one.

Requests are checked on the driver before any plan is built; nothing is ever
truncated to what happens to be there.
"""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ProviderError(ValueError):
    """A request that the provider cannot answer in full."""


#: The families that a provider may serve.
FAMILIES = ("securities", "prices", "fundamentals", "estimates", "actions", "classifications", "universe", "calendar", "fx", "borrow", "metrics")


@dataclass(frozen=True)
class Capability:
    """What a provider keeps of a family: all vintages, stamps in retrospect, or only the latest snapshot."""

    family: str
    fields: tuple[str, ...]
    vintages: str = "latest"  # all, retro, latest, synthetic
    first: dt.date | None = None
    last: dt.date | None = None


def grade(capability: Capability) -> str:
    """How far a family can be used point-in-time."""
    return {"all": "FULL_VINTAGES", "retro": "RETRO_WINDOW", "latest": "SNAPSHOT_STAMPED", "synthetic": "SYNTHETIC_TRUTH"}[capability.vintages]


def guard(capability: Capability | None, known: set[str], ids: list[str], fields: list[str], start: dt.date | None, end: dt.date | None) -> None:
    if capability is None:
        raise ProviderError("the provider does not serve this family")
    if len(set(ids)) != len(ids):
        raise ProviderError("an id is asked for twice")
    if unknown := sorted(set(ids) - known):
        raise ProviderError(f"unknown ids {unknown}")
    if missing := sorted(set(fields) - set(capability.fields)):
        raise ProviderError(f"fields not served: {missing}")
    if start and end and start > end:
        raise ProviderError("the window is empty")
    if (start and capability.first and start < capability.first) or (end and capability.last and end > capability.last):
        raise ProviderError("the window reaches beyond the provider's history")


class Provider(ABC):
    """Raw tables by family. Every fetch is a filter on ids, fields and dates over a lazily read table."""

    @abstractmethod
    def capabilities(self) -> dict[str, Capability]: ...

    @abstractmethod
    def known_ids(self) -> set[str]: ...

    @abstractmethod
    def raw(self, family: str) -> DataFrame: ...

    def fetch(self, family: str, ids: list[str], fields: list[str], start: dt.date | None = None, end: dt.date | None = None, day: str = "event_date") -> DataFrame:
        guard(self.capabilities().get(family), self.known_ids(), ids, fields, start, end)
        df = self.raw(family).where(F.col("security_id").isin(ids))
        if start:
            df = df.where(F.col(day) >= F.lit(start))
        if end:
            df = df.where(F.col(day) <= F.lit(end))
        keys = [c for c in ("security_id", day, "knowledge_time", "period_end", "fiscal_period") if c in df.columns]
        return df.select(*dict.fromkeys([*keys, *fields]))


@dataclass
class TableProvider(Provider):
    """Serves DataFrames that are there already (generated worlds, tests, Parquet folders)."""

    tables: dict[str, DataFrame]
    served: dict[str, Capability]
    ids: set[str] = field(default_factory=set)

    def capabilities(self):
        return self.served

    def known_ids(self):
        return self.ids

    def raw(self, family):
        return self.tables[family]


def read_template(spark: SparkSession, root: str, file: str) -> DataFrame:
    """Long rows of a statement template: security, excel_code, unit, column (FY-5 .. FY2), period_end, value.

    One folder a security (TICKER__EXCHANGE). The first data row of a file
    holds the period ends; blank cells are missing values.
    """
    df = spark.read.option("header", True).csv(f"{root}/*/{file}").withColumn("security", F.element_at(F.split(F.input_file_name(), "/"), -2))
    periods = [c for c in df.columns if c.startswith("FY")]
    keep = ["security", *[c for c in ("excel_code", "label", "unit") if c in df.columns]]
    long = df.unpivot(keep, periods, "column", "cell")
    is_date = F.col("cell").rlike(r"^\d{4}-\d{2}-\d{2}$")
    ends = long.where(is_date).select("security", "column", F.to_date("cell").alias("period_end")).distinct()
    values = long.where(~is_date & (F.trim("cell") != "")).join(ends, ["security", "column"], "left")
    return values.select(*keep, "column", "period_end", F.expr("try_cast(cell AS double)").alias("value"))


def read_multiples(spark: SparkSession, root: str, file: str) -> DataFrame:
    """Long rows of ragged pairs of columns CODE__date, CODE__value: security, code, event_date, value."""
    df = spark.read.option("header", True).csv(f"{root}/*/{file}").withColumn("security", F.element_at(F.split(F.input_file_name(), "/"), -2))
    codes = [c[: -len("__date")] for c in df.columns if c.endswith("__date")]
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.to_date(F.col(f"{c}__date")).alias("event_date"), F.col(f"{c}__value").cast("double").alias("value")) for c in codes])
    return df.select("security", F.explode(rows).alias("r")).select("security", "r.*").where("event_date is not null")


def read_front_page(spark: SparkSession, root: str) -> DataFrame:
    """One row a security with the front page's codes as columns."""
    df = spark.read.option("header", True).csv(f"{root}/*/front_page.csv").withColumn("security", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return df.groupBy("security").pivot("excel_code").agg(F.first("value"))


def catalog_overlap(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    """in_both, only_a, only_b: sizes of two metric catalogues' overlap."""
    x, y = a.select(code).distinct().withColumn("_a", F.lit(1)), b.select(code).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, code, "full_outer")
    both, left, right = F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_b").isNull(), F.col("_a").isNull()
    return j.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("in_both", both), ("only_a", left), ("only_b", right))])
