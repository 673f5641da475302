"""Declared tables: columns, keys, order and time rules, checked all at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """A canonical table. columns: name -> Spark type; rules: name -> SQL condition that every row meets."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    nullable: frozenset[str] = frozenset()
    forbidden: frozenset[str] = frozenset()
    knowledge: str | None = "knowledge_time"
    event: str | None = None
    vintaged: bool = False
    rules: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = [c for c in (*self.key, *self.nullable) if c not in self.columns]
        if unknown:
            raise ValueError(f"{self.name}: unknown columns {unknown}")
        if self.nullable & set(self.key):
            raise ValueError(f"{self.name}: key columns are never null")
        if self.vintaged and "vintage_seq" not in self.key:
            raise ValueError(f"{self.name}: a vintaged table has vintage_seq in its key")

    @property
    def event_key(self) -> list[str]:
        return [k for k in self.key if k != "vintage_seq"]

    def problems(self, df: DataFrame) -> list[str]:
        """Everything that is wrong with a table, from one pass over it and one over its keys."""
        from ..operators.quality import schema_problems

        out = schema_problems(df, self.columns, set(self.nullable), set(self.forbidden))
        if any("missing" in p or "declared" in p for p in out):
            return out
        row = [F.sum(F.when(~F.coalesce(F.expr(r), F.lit(True)), 1).otherwise(0)).alias(n) for n, r in self.rules.items()]
        if self.knowledge and self.event:
            row.append(F.sum((F.to_date(self.knowledge) < F.to_date(self.event)).cast("int")).alias("known_before_event"))
        if row:
            counts = df.agg(*row).first().asDict()
            out += [f"{n}: {c} rows" for n, c in counts.items() if c]
        dup = df.groupBy(*self.key).count().where("count > 1").count()
        if dup:
            out.append(f"{dup} duplicate keys")
        if self.vintaged:
            before = F.lag(self.knowledge).over(Window.partitionBy(*self.event_key).orderBy("vintage_seq"))
            late = df.withColumn("_b", before).where(F.col("_b") >= F.col(self.knowledge)).count()
            if late:
                out.append(f"{late} vintages not known after the one before")
        return out


_T = "timestamp_ntz"
_KNOWN = {"knowledge_time": _T}

#: The canonical tables.
TABLES = {
    t.name: t
    for t in (
        TableSpec("securities", {"security_id": "string", "ticker": "string", "exchange": "string", "first_knowledge_time": _T}, ("security_id",), knowledge="first_knowledge_time"),
        TableSpec("identifier_map", {"security_id": "string", "id_scheme": "string", "id_value": "string", "valid_from": "date", "valid_to": "date", **_KNOWN}, ("security_id", "id_scheme", "id_value", "valid_from"), frozenset({"valid_to"}), rules={"interval_order": "valid_to >= valid_from"}),
        TableSpec("listing_intervals", {"security_id": "string", "exchange": "string", "listing_date": "date", "delisting_date": "date", "delisting_return": "double", **_KNOWN}, ("security_id", "exchange", "listing_date"), frozenset({"delisting_date", "delisting_return"}), rules={"interval_order": "delisting_date >= listing_date"}),
        TableSpec("prices_daily", {"security_id": "string", "event_date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "market_cap": "double", "currency": "string", **_KNOWN}, ("security_id", "event_date"), frozenset({"open", "high", "low", "close", "volume", "market_cap"}), frozenset({"adjusted_close", "adjusted_open"}), event="event_date", rules={"volume_not_negative": "volume >= 0"}),
        TableSpec("adjustment_factors", {"security_id": "string", "event_date": "date", "split_factor_cum": "double", "total_return_factor_cum": "double", "derived_from_action_ids": "array<string>", **_KNOWN}, ("security_id", "event_date"), rules={"factor_positive": "split_factor_cum > 0 AND total_return_factor_cum > 0"}),
        TableSpec("fundamentals", {"security_id": "string", "metric": "string", "fiscal_period": "string", "vintage_seq": "bigint", "period_end": "date", "value": "double", **_KNOWN}, ("security_id", "metric", "fiscal_period", "vintage_seq"), vintaged=True, event="period_end"),
        TableSpec("estimates_consensus", {"security_id": "string", "metric": "string", "forecast_period": "string", "stat": "string", "vintage_seq": "bigint", "value": "double", **_KNOWN}, ("security_id", "metric", "forecast_period", "stat", "vintage_seq"), vintaged=True),
        TableSpec("corporate_actions", {"action_id": "string", "security_id": "string", "action_type": "string", "announcement_time": _T, "effective_date": "date", "ratio": "double", "amount": "double", "terminal_return": "double"}, ("action_id",), frozenset({"ratio", "amount", "terminal_return"}), knowledge="announcement_time"),
        TableSpec("classification_intervals", {"security_id": "string", "scheme": "string", "valid_from": "date", "valid_to": "date", "value": "string", **_KNOWN}, ("security_id", "scheme", "valid_from"), frozenset({"valid_to"}), rules={"interval_order": "valid_to >= valid_from"}),
        TableSpec("universe_membership_intervals", {"universe_id": "string", "security_id": "string", "valid_from": "date", "valid_to": "date", **_KNOWN}, ("universe_id", "security_id", "valid_from"), frozenset({"valid_to"}), rules={"interval_order": "valid_to >= valid_from"}),
        TableSpec("borrow_daily", {"security_id": "string", "event_date": "date", "fee_bps": "double", **_KNOWN}, ("security_id", "event_date"), event="event_date", rules={"fee_not_negative": "fee_bps >= 0"}),
        TableSpec("trading_calendars", {"calendar_id": "string", "event_date": "date", "is_trading_day": "boolean"}, ("calendar_id", "event_date"), knowledge=None),
        TableSpec("fx_rates", {"base_ccy": "string", "quote_ccy": "string", "event_date": "date", "rate": "double", **_KNOWN}, ("base_ccy", "quote_ccy", "event_date"), event="event_date", rules={"rate_positive": "rate > 0"}),
        TableSpec("feature_values", {"feature_id": "string", "feature_version": "string", "security_id": "string", "observation_time": _T, "value": "double", **_KNOWN}, ("feature_id", "feature_version", "security_id", "observation_time"), frozenset({"value"})),
    )
}


def visible(df: DataFrame, spec: TableSpec, fields: list[str]) -> DataFrame:
    """Only the key, the knowledge time and the declared fields reach a kernel."""
    unknown = [f for f in fields if f not in spec.columns]
    if unknown:
        raise ValueError(f"{spec.name}: undeclared fields {unknown}")
    names = dict.fromkeys([*spec.key, *([spec.knowledge] if spec.knowledge else []), *fields])
    return df.select(*names)
