"""Generated worlds with known truth: panels, price paths, restatements and seeded errors.

Every random stream is named: a generator is seeded by (seed, labels), so any
security or period can be made alone, on any executor, with the same values.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class World:
    seed: int = 1729
    securities: int = 30
    months: int = 72
    start: dt.date = dt.date(2010, 1, 1)
    signal: float = 0.3  # correlation of the next return with today's exposure
    payoff: str = "linear"  # linear, vee (no linear correlation) or none
    persistence: float = 0.8
    delist_share: float = 0.1
    split_share: float = 0.1
    regime_flip: int | None = None  # month from which the signal turns its sign


def stream(seed: int, *labels):
    import numpy as np

    digest = hashlib.sha256("|".join(map(str, (seed, *labels))).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))


#: Named worlds.
SCENARIOS = {
    "baseline": World(),
    "no_signal": World(payoff="none"),
    "monotone_signal": World(signal=0.6),
    "vee_payoff": World(payoff="vee", signal=0.6),
    "regime_flip": World(regime_flip=36),
    "delistings": World(delist_share=0.5),
    "splits": World(split_share=0.5),
    "large": World(securities=300, months=252),
}

PANEL = "security_id string, m int, month_end date, exposure double, total_return double, split double, close double, shares double, delisted boolean"


def _months(w: World) -> list[dt.date]:
    out = []
    for k in range(w.months):
        y, m = divmod(w.start.month + k, 12)
        out.append(dt.date(w.start.year + y, m + 1, 1) - dt.timedelta(days=1))
    return out


def generate(spark: SparkSession, w: World) -> DataFrame:
    """The panel of a world, one row a security and month; securities are made in parallel."""
    days = _months(w)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        market = stream(w.seed, "market").normal(0.005, 0.04, w.months)
        for batch in batches:
            frames = []
            for i in batch["id"].tolist():
                name = f"SYN{i:05d}"
                rng = stream(w.seed, "security", name)
                noise = rng.normal(size=w.months)
                x = np.empty(w.months)
                x[0] = noise[0]
                for t in range(1, w.months):
                    x[t] = w.persistence * x[t - 1] + np.sqrt(1 - w.persistence**2) * noise[t]
                pay = x if w.payoff == "linear" else (np.abs(x) - np.sqrt(2 / np.pi)) / np.sqrt(1 - 2 / np.pi) if w.payoff == "vee" else np.zeros(w.months)
                rho = np.full(w.months, w.signal if w.payoff != "none" else 0.0)
                if w.regime_flip is not None:
                    rho[w.regime_flip :] *= -1
                eps = rng.normal(size=w.months)
                own = np.zeros(w.months)
                own[1:] = rho[1:] * pay[:-1] + np.sqrt(1 - rho[1:] ** 2) * eps[1:]
                total = np.clip(rng.uniform(0.6, 1.4) * market + 0.08 * own, -0.9, 4.0)
                end = w.months if rng.random() >= w.delist_share else int(rng.integers(w.months // 2, w.months))
                split = np.ones(w.months)
                if rng.random() < w.split_share:
                    split[int(rng.integers(6, w.months))] = 2.0
                close, shares, c, s = [], [], 100.0, 1e6
                for t in range(w.months):
                    c, s = c * (1 + total[t]) / split[t], s * split[t]
                    close.append(c)
                    shares.append(s)
                frame = pd.DataFrame({"security_id": name, "m": range(w.months), "month_end": days, "exposure": x, "total_return": total, "split": split, "close": close, "shares": shares, "delisted": False})
                frame = frame.iloc[:end].copy()
                if end < w.months:
                    frame.loc[frame.index[-1], "delisted"] = True
                frames.append(frame)
            yield pd.concat(frames) if frames else pd.DataFrame(columns=[c.split(" ")[0] for c in PANEL.split(", ")])

    return spark.range(w.securities).mapInPandas(run, PANEL)


def price_identity(panel: DataFrame) -> DataFrame:
    """Rows whose close is not the one before, grown by the total return and split: must be none."""
    before = F.lag("close").over(Window.partitionBy("security_id").orderBy("m"))
    want = F.col("_b") * (1 + F.col("total_return")) / F.col("split")
    return panel.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.abs(F.col("close") - want) > 1e-9 * F.abs(want))).drop("_b")


#: Seeded error classes.
ERRORS = ("duplicate_bar", "negative_price", "stale_price", "impossible_volume", "missing_mandatory", "inverted_timestamp")


def bars(panel: DataFrame) -> DataFrame:
    """Month bars with volume and the time at which they are known."""
    return panel.select("security_id", F.col("month_end").alias("event_date"), "close", (F.col("shares") / 100).alias("volume"), (F.col("month_end").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOURS")).alias("knowledge_time"))


#: Bars after a stale price's first one that repeat its close.
FROZEN = 5


def seed_errors(clean: DataFrame, kinds: tuple[str, ...] = ERRORS, every: int = 97) -> tuple[DataFrame, DataFrame]:
    """(bars with errors, the rows that were spoilt and how), chosen by a hash of the key.

    A stale price freezes the closes of the next FROZEN bars, and those are the
    rows spoilt; it is seeded where that many follow and no other error is among
    them.
    """
    w = Window.partitionBy("security_id").orderBy("event_date")
    ahead, behind = w.rowsBetween(1, FROZEN), w.rowsBetween(-FROZEN, -1)
    pick = F.pmod(F.xxhash64("security_id", "event_date"), F.lit(every))
    kind = F.lit(None).cast("string")
    for k, name in enumerate(kinds):
        kind = F.when(pick == k, name).otherwise(kind)
    d = clean.withColumn("_k", kind).withColumn("_free", (F.count(F.lit(1)).over(ahead) == FROZEN) & (F.count("_k").over(ahead) == 0))
    d = d.withColumn("_frozen", F.max(F.when((F.col("_k") == "stale_price") & F.col("_free"), F.col("close"))).over(behind))
    d = d.withColumn("_e", F.when(F.col("_frozen").isNotNull(), "stale_price").when(F.col("_k") != "stale_price", F.col("_k"))).drop("_k", "_free")
    spoilt = d.withColumns(
        {
            "close": F.when(F.col("_e") == "stale_price", F.col("_frozen")).when(F.col("_e") == "negative_price", -F.col("close")).when(F.col("_e") == "missing_mandatory", None).otherwise(F.col("close")),
            "volume": F.when(F.col("_e") == "impossible_volume", -F.col("volume")).otherwise(F.col("volume")),
            "knowledge_time": F.when(F.col("_e") == "inverted_timestamp", F.col("knowledge_time") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("knowledge_time")),
        }
    )
    doubled = spoilt.unionByName(spoilt.where("_e = 'duplicate_bar'"))
    truth = d.where("_e is not null").select("security_id", "event_date", F.col("_e").alias("error"))
    return doubled.drop("_e", "_frozen"), truth


def restated(panel: DataFrame, lag_days: int = 45, every: int = 4) -> DataFrame:
    """Quarterly facts known after a lag, some restated later at another scale."""
    q = panel.where("m % 3 = 2").select("security_id", F.col("month_end").alias("period_end"), (F.col("close") * F.col("shares") / 1e6).alias("value"))
    first = q.withColumn("knowledge_time", F.date_add("period_end", lag_days).cast("timestamp_ntz")).withColumn("vintage_seq", F.lit(0).cast("long"))
    again = first.where(F.pmod(F.xxhash64("security_id", "period_end"), F.lit(every)) == 0)
    again = again.withColumns({"value": F.col("value") * 0.9, "knowledge_time": F.col("knowledge_time") + F.expr("INTERVAL 200 DAYS"), "vintage_seq": F.lit(1).cast("long")})
    return first.unionByName(again).withColumn("metric", F.lit("BOOK_VALUE"))


def ablated(w: World, **changes) -> World:
    return replace(w, **changes)
