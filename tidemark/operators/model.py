"""The boosted bin classifier, its ensembles and their weights.

Ranks never change between rounds, so bins are made once. A round is one
aggregate over (factor, bin); only factors x bins numbers reach the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finite import bins_below, ratio


def equal_count_edges(panel: DataFrame, factor: str, v: str, key: list[str], bins: int) -> DataFrame:
    """factor, edges: the values at places ceil(j n / bins), j = 1 .. bins - 1; ties (by key) have one value.

    Values are counted before any is ordered: a factor's task sees its distinct
    values, not its rows.
    """
    counts = panel.where(F.col(v).isNotNull()).groupBy(factor, v).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(factor).orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_k": upto, "_n": F.sum("_c").over(Window.partitionBy(factor))})
    place = F.ceil(F.col("_j") * F.col("_n") / bins)
    hit = placed.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))).where((place <= F.col("_k")) & (place > F.col("_k") - F.col("_c")))
    return hit.groupBy(factor).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", v))), lambda x: x[v]).alias("edges"))


def equal_width_edges(bins: int) -> list[float]:
    return [j / bins for j in range(1, bins)]


def binned(panel: DataFrame, edges: DataFrame, factor: str, v: str) -> DataFrame:
    """Adds bin, null where v is missing. Edges are few: factors x bins."""
    return panel.join(edges, factor, "left").withColumn("bin", F.when(F.col(v).isNotNull(), bins_below(F.col("edges"), F.col(v)))).drop("edges")


def bin_value(plus, minus, eps):
    return 0.5 * F.log((plus + eps) / (minus + eps))


def bin_masses(rows: DataFrame, factor: str, label: str, weight: str) -> DataFrame:
    """factor, bin, w_plus, w_minus; bin null holds the uncovered mass."""
    w = F.col(weight)
    return rows.groupBy(factor, "bin").agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(label) == -1, w).otherwise(0.0)).alias("w_minus"))


def z_scores(masses: DataFrame, factor: str) -> DataFrame:
    """factor, z: sum of sqrt(w_plus w_minus) over bins, and half the uncovered mass."""
    inner = F.sum(F.when(F.col("bin").isNotNull(), F.sqrt(F.col("w_plus") * F.col("w_minus"))).otherwise(0.0))
    outside = F.sum(F.when(F.col("bin").isNull(), F.col("w_plus") + F.col("w_minus")).otherwise(0.0))
    return masses.groupBy(factor).agg((inner + outside / 2).alias("z"))


def least_z(z: DataFrame, factor: str, order: str) -> DataFrame:
    """The factor with the least z; ties go to the first in registry order."""
    return z.agg(F.min_by(F.struct(factor, "z"), F.struct("z", order)).alias("_m")).select("_m.*")


def weight_digest(state: DataFrame, weight: str = "w") -> str:
    """Count, sum and xor of the weights' hashes: the multiset of a round's weights, whatever their order; no sort."""
    h = F.xxhash64(weight)
    r = state.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


def trace_hash(trace: list[str]) -> str:
    """SHA-256 over the rounds' weight digests."""
    import hashlib

    return hashlib.sha256("\n".join(f"round={i}:{t}" for i, t in enumerate(trace)).encode()).hexdigest()


#: Rounds between two writes of the weights: a chain of that many stays one expression.
CHAIN = 5


def boost(observations: DataFrame, factors: list[str], label: str, rounds: int, bins: int, save=None, trace: list[str] | None = None) -> list[dict]:
    """Fits `rounds` bin classifiers on wide rank columns; returns [{factor, edges, values, z}].

    save(df): cuts lineage by writing to shared storage (checkpoint() if not given).
    trace: gets each round's weight_digest.
    """
    models, refused = boost_groups(observations.withColumn("_group", F.lit(0)), "_group", factors, label, rounds, bins, save, trace)
    if not models:
        raise ValueError(refused.get(0, "no labelled observations"))
    return models[0]


def boost_groups(observations: DataFrame, group: str, factors: list[str], label: str, rounds: int, bins: int, save=None, trace: list[str] | None = None) -> tuple[dict, dict]:
    """(a model by group, reasons of the groups that have none): all groups train side by side.

    A round is one job for all groups; groups x factors x bins numbers reach the
    driver, and each group's chosen bins go back with it. Groups are folds or
    experts: few, whatever the number of observations.
    """
    held = observations.select(F.col(group).alias("g"), F.col(label).alias("y"), *[F.col(f).cast("double").alias(f"v_{i}") for i, f in enumerate(factors)])
    long = held.select("g", F.posexplode(F.array(*[f"v_{i}" for i in range(len(factors))])).alias("f", "v"))
    n = {r["g"]: r["n"] for r in held.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = equal_count_edges(long.withColumn("gf", F.struct("g", "f")), "gf", "v", [], bins).select("gf.g", "gf.f", "edges").collect()
    edges = {(r["g"], r["f"]): list(r["edges"]) for r in found}
    refused = {}
    for g in n:
        bare = [f for i, f in enumerate(factors) if (g, i) not in edges]
        if bare:
            refused[g] = f"factor {bare[0]} covers no observation"
    live = sorted(g for g in n if g not in refused)
    if not live:
        return {}, refused
    spark, kind = observations.sparkSession, held.schema["g"].dataType.simpleString()
    table = spark.createDataFrame([(g, float(n[g]), [edges[g, i] for i in range(len(factors))]) for g in live], f"g {kind}, n double, e array<array<double>>")
    place = lambda i: F.when(F.col(f"v_{i}").isNotNull(), bins_below(F.get("e", F.lit(i)), F.col(f"v_{i}")))
    state = held.join(F.broadcast(table), "g").select("g", "y", F.array(*[place(i) for i in range(len(factors))]).alias("b"), (F.lit(1.0) / F.col("n")).alias("w"))
    write = lambda df: save(df) if save else df.checkpoint()
    state = write(state)
    models: dict = {g: [] for g in live}
    for k in range(rounds):
        rows = bin_masses(state.select("g", "y", "w", F.posexplode("b").alias("f", "bin")).withColumn("gf", F.struct("g", "f")), "gf", "y", "w").collect()
        masses: dict = {g: [] for g in live}
        for r in sorted(rows, key=lambda r: (r["gf"]["f"], -1 if r["bin"] is None else r["bin"])):
            masses[r["gf"]["g"]].append((r["gf"]["f"], r["bin"], r["w_plus"], r["w_minus"]))
        chosen = []
        for g in live:
            total = sum(p + m for f, _, p, m in masses[g] if f == 0)
            eps, z = 1.0 / n[g], [0.0] * len(factors)
            for f, at, p, m in masses[g]:
                z[f] += ((p + m) / 2 if at is None else math.sqrt(p * m)) / total
            best = min(range(len(factors)), key=lambda i: (z[i], i))
            values = [0.0] * bins
            for f, at, p, m in masses[g]:
                if f == best and at is not None:
                    values[at] = 0.5 * math.log((p / total + eps) / (m / total + eps))
            models[g].append({"factor": factors[best], "edges": edges[g, best], "values": values, "z": z[best]})
            chosen.append((g, best, values, total))
        if k + 1 == rounds and trace is None:
            break
        sent = F.broadcast(spark.createDataFrame(chosen, f"g {kind}, best int, h array<double>, total double"))
        h = F.coalesce(F.get("h", F.get("b", F.col("best"))), F.lit(0.0))
        state = state.join(sent, "g").select("g", "y", "b", (F.col("w") / F.col("total") * F.exp(-F.col("y") * h)).alias("w"))
        if (k + 1) % CHAIN == 0:
            state = write(state)
        if trace is not None:
            trace.append(weight_digest(state))
    return models, refused


def predict(observations: DataFrame, model: list[dict], out: str = "score", missing_as_zero: bool = True) -> DataFrame:
    """Sum of bin values over the rounds; a missing factor counts 0, or makes the score missing."""
    terms = []
    for m in model:
        place = bins_below(F.array(*[F.lit(float(e)) for e in m["edges"]]), F.col(m["factor"])) + 1
        h = F.when(F.col(m["factor"]).isNotNull(), F.try_element_at(F.array(*[F.lit(float(v)) for v in m["values"]]), place))
        terms.append(F.coalesce(h, F.lit(0.0)) if missing_as_zero else h)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return observations.withColumn(out, total)


def dump_model(model: list[dict]) -> str:
    return json.dumps(model, sort_keys=True, separators=(",", ":"))


def load_model(text: str) -> list[dict]:
    return json.loads(text)


# -- sample selection: periods are (period_id, label_date, target_end) --------


def realized(periods: DataFrame, fit) -> DataFrame:
    return periods.where(F.col("target_end") <= fit)


def select_trailing(periods: DataFrame, fit, n: int) -> DataFrame:
    """The last n realized periods."""
    return realized(periods, fit).orderBy(F.col("label_date").desc(), F.col("period_id").desc()).limit(n)


def select_seasonal(periods: DataFrame, fit, month: int, years: int, lag_years: int = 0) -> DataFrame:
    """Realized periods of a calendar month: the latest `years` years that have one, after skipping lag_years."""
    same = realized(periods, fit).where(F.month("label_date") == month).withColumn("_y", F.year("label_date"))
    place = F.dense_rank().over(Window.orderBy(F.col("_y").desc()))
    return same.withColumn("_k", place).where(F.col("_k").between(lag_years + 1, lag_years + years)).drop("_y", "_k")


def select_hedge(periods: DataFrame, fit, metric: str, lookback: int, below: float | None = None, ceil: bool = False) -> DataFrame:
    """Of the last `lookback` realized periods those with a metric strictly below a bound, or the lower half."""
    recent = select_trailing(periods, fit, lookback)
    if below is not None:
        return recent.where(F.col(metric) < below)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    half = F.ceil(n / 2) if ceil else F.floor(n / 2)
    return recent.withColumn("_k", F.row_number().over(Window.orderBy(metric, "period_id"))).withColumn("_h", half).where("_k <= _h").drop("_k", "_h")


# -- ensembles ----------------------------------------------------------------


def pooled(frame: DataFrame, selected: DataFrame, period: str) -> DataFrame:
    """The rows of the selected periods, unweighted: boosting starts from equal weights."""
    if not selected.take(1):
        raise ValueError("no period is selected")
    wanted = selected.select(period).distinct()
    missing = wanted.join(frame.select(period).distinct(), period, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"selected periods have no rows: {[r[0] for r in missing]}")
    return frame.join(wanted, period, "left_semi")


def train_ensemble(frame: DataFrame, experts: dict[str, DataFrame], period: str, factors: list[str], label: str, rounds: int, bins: int, save=None) -> tuple[dict[str, list[dict]], list[tuple[str, str]]]:
    """(a model for each expert by name, experts left out with the reason): all with the same settings.

    experts: name to its selected periods. An expert without periods is left
    out and listed; one whose periods the frame lacks is an error.
    """
    dropped = [(name, "no period is selected") for name in sorted(experts) if not experts[name].take(1)]
    live = sorted(set(experts) - {name for name, _ in dropped})
    rows = None
    for name in live:
        mine = pooled(frame, experts[name], period).select(F.lit(name).alias("_expert"), *factors, label)
        rows = mine if rows is None else rows.unionByName(mine)
    if rows is None:
        return {}, dropped
    models, refused = boost_groups(rows, "_expert", factors, label, rounds, bins, save)
    return models, sorted([*dropped, *refused.items()])


def expert_scores(observations: DataFrame, models: dict[str, list[dict]], keys: list[str]) -> DataFrame:
    """keys, component, v: each expert's score, in the long form that combine() takes."""
    out = observations
    for name, m in models.items():
        out = predict(out, m, f"_score_{name}")
    rows = F.array(*[F.struct(F.lit(name).alias("component"), F.col(f"_score_{name}").alias("v")) for name in models])
    return out.select(*keys, F.explode(rows).alias("_s")).select(*keys, "_s.*")


def equal_weights(components: DataFrame, component: str) -> DataFrame:
    return components.select(component).distinct().withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))


def seasonal_weights(components: DataFrame, history: DataFrame, component: str, as_of, month: int, floor: float, least: int) -> DataFrame:
    """Weights by mean rank IC of the same month, realized strictly before as_of; equal if one has too few or none is positive."""
    h = history.where((F.col("target_end") < as_of) & (F.month("label_date") == month)).groupBy(component).agg(F.avg("ic").alias("_m"), F.count(F.lit(1)).alias("_n"))
    j = components.select(component).distinct().join(h, component, "left")
    every = Window.partitionBy()
    mean = F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(floor))
    j = j.withColumn("_w", mean).withColumn("_t", F.sum("_w").over(every)).withColumn("_short", F.min(F.coalesce("_n", F.lit(0))).over(every) < least)
    even = F.lit(1.0) / F.count(F.lit(1)).over(every)
    return j.withColumn("weight", F.when(F.col("_short") | (F.col("_t") <= 0), even).otherwise(F.try_divide("_w", "_t"))).select(component, "weight")


def hedge_weights(weights: DataFrame, component: str, hedge: str) -> DataFrame:
    """The hedge gets the others' mean weight, then all are normalised."""
    mean = weights.agg(F.avg("weight").alias("weight")).select(F.lit(hedge).alias(component), "weight")
    both = weights.unionByName(mean)
    return both.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def combine(scores: DataFrame, weights: DataFrame, by: list[str], component: str, name: str, v: str) -> DataFrame:
    """Weighted sum of per-component z-scores over names that every positive-weight component covers."""
    from ..functions.xsec import zscore

    w = weights.where("weight > 0")
    z = zscore(scores.join(F.broadcast(w), component), [*by, component], v, "_z")
    need = w.agg(F.count(F.lit(1)).alias("_k"))
    g = z.groupBy(*by, name).agg(F.sum(F.col("weight") * F.col("_z")).alias("score"), F.count(F.lit(1)).alias("_n"))
    return g.crossJoin(F.broadcast(need)).where("_n = _k").drop("_n", "_k")


def blend(a: DataFrame, b: DataFrame, keys: list[str], share: float) -> DataFrame:
    """share * a + (1 - share) * b over common names."""
    return a.withColumnRenamed("score", "_a").join(b.withColumnRenamed("score", "_b"), keys).withColumn("score", share * F.col("_a") + (1 - share) * F.col("_b")).drop("_a", "_b")


def ic_shares(contribution: DataFrame, family: str, v: str) -> DataFrame:
    """Share of the sum of |v| by family."""
    g = contribution.groupBy(family).agg(F.sum(F.abs(v)).alias("_s"))
    return g.withColumn("share", ratio(F.col("_s"), F.sum("_s").over(Window.partitionBy()))).drop("_s")
