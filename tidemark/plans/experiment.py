"""The whole run: panel, features, labels, walk-forward fits, books, costs, ledger, report, artefacts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xsec
from ..operators import folds, ledger, metrics, model, portfolio
from ..sources import store


@dataclass(frozen=True)
class Experiment:
    features: tuple[str, ...] = ("reversal", "momentum", "size")
    horizon: int = 1
    bins: int = 5
    rounds: int = 5
    top: float = 0.3
    bottom: float = 0.3
    fractiles: int = 5
    gross: float = 2.0
    cost_bps: float = 20.0
    borrow_bps: float = 50.0
    rule: folds.FoldRule = field(default_factory=lambda: folds.FoldRule(train_steps=24, test_steps=12))

    def run_id(self) -> str:
        return "run-" + hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def feature_frame(panel: DataFrame, e: Experiment) -> DataFrame:
    """panel: security_id, m, close, market_cap. Ranks of the features, fwd, label; one row a name and month."""
    w = Window.partitionBy("security_id").orderBy("m")
    back = lambda k: F.when(F.lag("m", k).over(w) == F.col("m") - k, F.lag("close", k).over(w))
    ahead = F.when(F.lead("m", e.horizon).over(w) == F.col("m") + e.horizon, F.lead("close", e.horizon).over(w))
    raw = panel.select("security_id", "m", (F.col("close") / back(1) - 1).alias("reversal"), (back(1) / back(12) - 1).alias("momentum"), (-F.log("market_cap")).alias("size"), (ahead / F.col("close") - 1).alias("fwd"))
    # a rank for each feature in one pass over the month: the places of covered names only
    out = raw
    for f in e.features:
        seen = F.col(f).isNotNull() & ~F.isnan(f)
        by = Window.partitionBy("m", seen)
        out = out.withColumn(f"r_{f}", F.when(seen, F.row_number().over(by.orderBy(F.col(f), "security_id")) / F.count(F.lit(1)).over(by)))
    labelled = F.col("fwd").isNotNull()
    by = Window.partitionBy("m", labelled)
    k, n = F.row_number().over(by.orderBy("fwd", "security_id")), F.count(F.lit(1)).over(by)
    low = F.floor(n * F.lit(e.bottom))
    label = F.when(labelled & (k <= low), -1).when(labelled & (k > n - F.least(F.floor(n * F.lit(e.top)), n - low)), 1).cast("int")
    return out.withColumn("label", label).select("security_id", "m", *[F.col(f"r_{f}").alias(f) for f in e.features], "fwd", "label")


def walk_forward(frame: DataFrame, e: Experiment) -> tuple[DataFrame, DataFrame]:
    """(out-of-sample scores: fold_id, m, security_id, score, fwd; ledger of folds without a fit).

    Folds are months on the driver; each fit trains on months whose label is
    realized before the test begins. All folds are fitted side by side.
    """
    e.rule.check(e.horizon)
    months = sorted(r[0] for r in frame.select("m").distinct().collect())
    frame = store.materialised(frame)
    spark = frame.sparkSession
    found = folds.folds(months, e.rule)
    table = spark.createDataFrame([(f["fold_id"], int(f["train_from"]), int(f["fit_as_of"])) for f in found], "fold_id int, train_from int, fit_as_of int")
    inside = (F.col("m") >= F.col("train_from")) & (F.col("m") + e.horizon <= F.col("fit_as_of")) & F.col("label").isNotNull()
    train = frame.join(F.broadcast(table), inside).select("fold_id", *e.features, "label")
    models, refused = model.boost_groups(train, "fold_id", list(e.features), "label", e.rounds, e.bins, save=store.materialised)
    scores, skipped = [], []
    for f in found:
        if f["fold_id"] not in models:
            skipped.append((f["fold_id"], refused.get(f["fold_id"], "no labelled observations")))
            continue
        test = frame.where(F.col("m").between(f["test_from"], f["test_to"]))
        scores.append(model.predict(test, models[f["fold_id"]]).select(F.lit(f["fold_id"]).alias("fold_id"), "m", "security_id", "score", "fwd"))
    out = scores[0] if scores else frame.limit(0).select(F.lit(0).alias("fold_id"), "m", "security_id", F.lit(0.0).alias("score"), "fwd")
    for s in scores[1:]:
        out = out.unionByName(s)
    return store.materialised(out), spark.createDataFrame(skipped, "fold_id int, reason string")


def report(scores: DataFrame, e: Experiment) -> dict[str, DataFrame]:
    """ic, ic_ledger, quantiles, book, ledger, summary."""
    ic, ic_ledger = metrics.ic_series(scores, ["m"], "score", "fwd")
    seen = scores.where("fwd is not null")
    book = portfolio.level1(seen, ["m"], "score", "security_id", e.fractiles, e.gross)
    targets = book.select(F.lit("level1").alias("book"), F.col("m").alias("period"), F.col("security_id").alias("name"), "weight")
    marks = book.select(F.lit("level1").alias("book"), F.col("m").alias("period"), F.lit(0).alias("step"), F.col("security_id").alias("name"), F.col("fwd").alias("ret"), F.lit(False).alias("terminated"))
    # a name held last month and not this one is closed by its trade, so it needs no mark
    led = ledger.run_ledger(targets, marks, e.cost_bps, e.borrow_bps)
    return {"ic": ic, "ic_ledger": ic_ledger, "quantiles": metrics.quantile_spread(seen, ["m"], "score", "fwd", "security_id", e.fractiles), "book": book.select("m", "security_id", "weight"), "ledger": led, "summary": metrics.summary(led, ["book"], "ret", 12)}


def acceptance(value: float | None, target: float, band: float) -> bool:
    return value is not None and abs(value - target) <= band


def write_run(tables: dict[str, DataFrame], root: str, e: Experiment) -> str:
    """Writes every table as a content-addressed dataset and a manifest; an existing run is left alone."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{root}/{e.run_id()}"
    if store.exists(spark, f"{path}/manifest.json"):
        return path
    ids = {name: store.write_dataset(df, path, name) for name, df in tables.items()}
    store._write_text(spark, f"{path}/manifest.json", json.dumps({"run": e.run_id(), "config": asdict(e), "tables": ids}, sort_keys=True))
    return path


def verify_run(spark, path: str) -> list[str]:
    """Differences between a run's tables and its manifest, and breaks in the ledger's chain of values."""
    manifest = json.loads(store._read_text(spark, f"{path}/manifest.json"))
    out = [f"{t}: {p}" for t, i in manifest["tables"].items() for p in store.verify(spark, path, t, i)]
    led = store.read_dataset(spark, path, "ledger", manifest["tables"]["ledger"], check=False)
    ahead = F.lead("nav_start").over(Window.partitionBy("book").orderBy("period"))
    broken = led.withColumn("_n", ahead).where(F.col("_n").isNotNull() & (F.abs(F.col("_n") - F.col("nav_end")) > 1e-6)).count()
    return out + ([f"{broken} periods do not start where the one before ended"] if broken else [])
