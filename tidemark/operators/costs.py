"""The cost model: additive components, then region and size scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BP = 1e-4


@dataclass(frozen=True)
class CostStack:
    """A component is on where its rate is given. Rates in basis points."""

    commission: float | None = None
    crossing: float | None = None  # share of the quoted spread paid
    linear_bps: float | None = None
    linear_by_region: dict[str, float] = field(default_factory=dict)
    impact_coeff: float | None = None
    impact_exp: float = 0.5
    participation_cap: float | None = None
    participation_bps: float = 0.0
    region_multiplier: dict[str, float] = field(default_factory=dict)
    size_ref: float | None = None
    size_exp: float = 0.0
    aum: float | None = None

    def __post_init__(self):
        if self.crossing is not None and not 0 <= self.crossing <= 1:
            raise ValueError("crossing lies in [0, 1]")
        if self.impact_exp <= 0:
            raise ValueError("the impact exponent is positive")
        rates = (self.commission, self.linear_bps, self.impact_coeff, self.participation_bps, *self.linear_by_region.values())
        if any(r is not None and not 0 <= r < float("inf") for r in rates):
            raise ValueError("rates are finite and not negative")


def _by_region(values: dict[str, float], otherwise: float):
    if not values:
        return F.lit(float(otherwise))
    lookup = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.col("region")), F.lit(float(otherwise)))


def trade_costs(trades: DataFrame, stack: CostStack) -> DataFrame:
    """trades: date, security_id, notional, adv, spread_bps, region. Adds each component, flagged and total."""
    size = F.abs("notional")
    group = F.sum(size).over(Window.partitionBy("date", "security_id"))
    t = trades.withColumn("_t", group)
    zero = F.lit(0.0)
    linear = _by_region(stack.linear_by_region, stack.linear_bps or 0.0) * BP * size if stack.linear_bps is not None else zero
    impact = stack.impact_coeff * BP * F.pow(F.col("_t") / F.col("adv"), stack.impact_exp) * size if stack.impact_coeff is not None else zero
    breach = F.col("_t") - (stack.participation_cap or 0.0) * F.col("adv")
    penalty = F.when(F.col("_t") > 0, stack.participation_bps * BP * F.greatest(zero, breach) * size / F.col("_t")).otherwise(zero) if stack.participation_cap is not None else zero
    scale = _by_region(stack.region_multiplier, 1.0)
    if stack.size_ref and stack.aum:
        scale = scale * (stack.aum / stack.size_ref) ** stack.size_exp
    parts = {
        "commission": F.when(F.col("notional") != 0, F.lit(float(stack.commission or 0.0))).otherwise(zero),
        "half_spread": (stack.crossing or 0.0) * F.col("spread_bps") * BP * size,
        "linear": linear,
        "impact": impact,
        "participation": penalty,
    }
    out = t.withColumns({k: F.coalesce(v * scale, zero) for k, v in parts.items()})
    out = out.withColumn("flagged", (breach > 0) if stack.participation_cap is not None else F.lit(False))
    return out.withColumn("total", sum((F.col(k) for k in parts), zero)).drop("_t")


def ledger_hooks(stack: CostStack, market: dict[str, tuple[float, float, str]], fee_bps: float, day_count_fraction: float, fee_by_region: dict[str, float] | None = None, denominator: int = 365):
    """(cost, borrow): the ledger's two hooks, charging its trades and short positions as trade_costs and borrow do.

    market: name to (adv, spread in basis points, region). The fraction of a
    year becomes whole days. Charges that are not finite and not negative, and
    trades in names without a market, are refused.
    """
    days = round(day_count_fraction * denominator)
    scale_all = (stack.aum / stack.size_ref) ** stack.size_exp if stack.size_ref and stack.aum else 1.0

    def known(name: str) -> tuple[float, float, str]:
        if name not in market:
            raise ValueError(f"no market data for {name}")
        return market[name]

    def refuse(x: float) -> float:
        if not 0 <= x < float("inf"):
            raise ValueError(f"a charge of {x}")
        return x

    def cost(trades: dict[str, float]) -> float:
        total = 0.0
        for name, notional in trades.items():
            adv, spread, region = known(name)
            size = abs(notional)
            if not size:
                continue
            part = (stack.commission or 0.0) + (stack.crossing or 0.0) * spread * BP * size
            if stack.linear_bps is not None:
                part += stack.linear_by_region.get(region, stack.linear_bps) * BP * size
            if stack.impact_coeff is not None:
                part += stack.impact_coeff * BP * (size / adv) ** stack.impact_exp * size
            if stack.participation_cap is not None:
                part += stack.participation_bps * BP * max(0.0, size - stack.participation_cap * adv)
            total += part * stack.region_multiplier.get(region, 1.0) * scale_all
        return refuse(total)

    def borrow_fee(positions: dict[str, float]) -> float:
        fees = fee_by_region or {}
        return refuse(sum(fees.get(known(k)[2], fee_bps) * BP * -v * days / denominator for k, v in positions.items() if v < 0))

    return cost, borrow_fee


def inconsistent_adv(trades: DataFrame) -> DataFrame:
    """Groups whose trades name several volumes: refused."""
    return trades.groupBy("date", "security_id").agg(F.count_distinct("adv").alias("n")).where("n > 1")


def borrow(marks: DataFrame, fee_bps: float, by_region: dict[str, float] | None = None, denominator: int = 365) -> DataFrame:
    """marks: date, security_id, short_notional, days, region, override_bps. Adds borrow."""
    fee = F.coalesce(F.col("override_bps").cast("double"), _by_region(by_region or {}, fee_bps))
    return marks.withColumn("borrow", fee * BP * F.col("short_notional") * F.col("days") / denominator)


def period_costs(costed: DataFrame, accrued: DataFrame) -> DataFrame:
    """date, cost, borrow: sums of trades' and marks' charges."""
    rows = costed.select("date", F.col("total").alias("cost"), F.lit(0.0).alias("borrow")).unionByName(accrued.select("date", F.lit(0.0).alias("cost"), "borrow"))
    return rows.groupBy("date").agg(F.sum("cost").alias("cost"), F.sum("borrow").alias("borrow"))


def net_of(gross: DataFrame, charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gross less charges by date; charged dates that have no gross: refused)."""
    net = gross.join(charges, "date", "left").withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0)) - F.coalesce("borrow", F.lit(0.0)))
    return net, charges.join(gross, "date", "left_anti")


def scenario_grid(axes: dict[str, list]) -> list[dict]:
    """Every combination of the axes' values."""
    import itertools

    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def linear_stack(bps: float) -> CostStack:
    return CostStack(linear_bps=bps)


def preset(name: str) -> list[CostStack]:
    """The named cost grids."""
    if name == "flat_grid":
        return [linear_stack(b) for b in (5, 10, 15, 20, 25, 30)]
    if name == "flat_with_cap":
        return [CostStack(linear_bps=20, participation_cap=0.10)]
    if name == "tiers":
        return [linear_stack(b) for b in (20, 30, 40, 50)]
    if name == "high_frequency":
        return [linear_stack(10)]
    if name == "with_borrow":
        return [linear_stack(5)]
    raise ValueError(f"unknown preset {name}")


def accrual_gaps(marks: DataFrame, by: list[str]) -> DataFrame:
    """Periods whose accrued days differ from the calendar gap to the mark before."""
    before = F.lag("date").over(Window.partitionBy(*by).orderBy("date"))
    return marks.withColumn("gap", F.datediff(F.col("date"), before)).where("gap is not null and gap <> days")
