"""Cross-sectional transforms: within a date (and a cell), never across dates.

Each takes and returns a DataFrame; `by` are the partition columns, `v` the
value, `key` the tie-break. Names whose value is null, NaN or infinite are not
covered and leave the result, except where said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .finite import EPSILON, covered


def _over(by: list[str]) -> Window:
    return Window.partitionBy(*by)


def _order(v: str, key: str, highest_first: bool) -> list[Column]:
    return [F.col(v).desc() if highest_first else F.col(v).asc(), F.col(key).asc()]


def ordinal(df: DataFrame, by: list[str], v: str, key: str, out: str, highest_first: bool = False) -> DataFrame:
    """1-based place by (value, key)."""
    return df.withColumn(out, F.row_number().over(_over(by).orderBy(*_order(v, key, highest_first))))


def midrank(df: DataFrame, by: list[str], v: str, out: str, highest_first: bool = False) -> DataFrame:
    """1-based average rank."""
    w = _over(by).orderBy(F.col(v).desc() if highest_first else F.col(v).asc())
    ties = F.count(F.lit(1)).over(_over([*by, v]))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2.0)


def rank_normalize(df: DataFrame, by: list[str], v: str, key: str, out: str = "rank", highest_first: bool = True, average: bool = False) -> DataFrame:
    """rank / covered names, in (0, 1]; ties by key, or shared."""
    df = df.where(covered(F.col(v)))
    df = midrank(df, by, v, out, highest_first) if average else ordinal(df, by, v, key, out, highest_first)
    return df.withColumn(out, F.col(out) / F.count(F.lit(1)).over(_over(by)))


def rank_columns(df: DataFrame, by: list[str], ranks: dict[str, str], key: str, highest_first: bool = True) -> DataFrame:
    """Adds for each name: value column of `ranks` the rank that rank_normalize gives, null where not covered; no row leaves.

    All windows are dealt by the same columns: one exchange for any number of ranks.
    """
    out = {}
    for name, v in ranks.items():
        inside = covered(F.col(v))
        place = F.row_number().over(_over(by).orderBy(inside.desc(), *_order(v, key, highest_first)))
        out[name] = F.when(inside, place / F.sum(inside.cast("int")).over(_over(by)))
    return df.withColumns(out)


def rank_normalize_by_cell(df: DataFrame, by: list[str], cell: str, v: str, key: str, out: str = "rank", **how) -> DataFrame:
    """As rank_normalize, within date and cell; names without a cell are left out."""
    return rank_normalize(df.where(F.col(cell).isNotNull()), [*by, cell], v, key, out, **how)


def _standardised(v: Column, mean: Column, sd: Column, most: Column, n: Column) -> Column:
    return F.when(sd <= most * n * EPSILON, 0.0).otherwise(F.try_divide(v - mean, sd))


def zscore(df: DataFrame, by: list[str], v: str, out: str = "z") -> DataFrame:
    """(v - mean) / population deviation; 0 where the deviation is rounding only."""
    df, w, c = df.where(covered(F.col(v))), _over(by), F.col(v)
    return df.withColumn(out, _standardised(c, F.avg(c).over(w), F.stddev_pop(c).over(w), F.max(F.abs(c)).over(w), F.count(c).over(w)))


def zscore_with_universe(df: DataFrame, by: list[str], v: str, inside: str, out: str = "z") -> DataFrame:
    """Moments over the rows flagged `inside`, applied to all."""
    df, w = df.where(covered(F.col(v))), _over(by)
    own = F.when(F.col(inside), F.col(v))
    return df.withColumn(out, _standardised(F.col(v), F.avg(own).over(w), F.stddev_pop(own).over(w), F.max(F.abs(own)).over(w), F.count(own).over(w)))


def fit_winsor(df: DataFrame, by: list[str], v: str, low: float, high: float) -> DataFrame:
    """by, lo, hi: interpolated quantiles of the covered values."""
    return df.where(covered(F.col(v))).groupBy(*by).agg(F.percentile(v, F.lit(low)).alias("lo"), F.percentile(v, F.lit(high)).alias("hi"))


def apply_winsor(df: DataFrame, fitted: DataFrame, by: list[str], v: str, out: str = "w") -> DataFrame:
    joined = df.where(covered(F.col(v))).join(fitted, by)
    return joined.withColumn(out, F.greatest(F.least(F.col(v), F.col("hi")), F.col("lo"))).drop("lo", "hi")


def winsorize(df: DataFrame, by: list[str], v: str, low: float, high: float, out: str = "w") -> DataFrame:
    return apply_winsor(df, fit_winsor(df, by, v, low, high), by, v, out)


def pctrank(df: DataFrame, by: list[str], v: str, key: str, out: str = "pct") -> DataFrame:
    """(place - 1) / (n - 1); a lone name gets one half."""
    df = ordinal(df.where(covered(F.col(v))), by, v, key, out)
    n = F.count(F.lit(1)).over(_over(by))
    return df.withColumn(out, F.when(n == 1, 0.5).otherwise(F.try_divide((F.col(out) - 1).cast("double"), (n - 1).cast("double"))))


def quantile_labels(df: DataFrame, by: list[str], v: str, key: str, bottom: float, top: float, out: str = "label") -> DataFrame:
    """-1 for the bottom floor(bottom n), +1 for the top floor(top n) of the rest, else null."""
    df = ordinal(df.where(covered(F.col(v))), by, v, key, "_k")
    n = F.count(F.lit(1)).over(_over(by))
    low = F.floor(n * F.lit(bottom))
    high = F.least(F.floor(n * F.lit(top)), n - low)
    return df.withColumn(out, F.when(F.col("_k") <= low, -1).when(F.col("_k") > n - high, 1).cast("int")).drop("_k")


def threshold_labels(df: DataFrame, v: str, low: float, high: float, out: str = "label") -> DataFrame:
    """+1 above high, -1 below low, both strict."""
    return df.withColumn(out, F.when(F.col(v) > high, 1).when(F.col(v) < low, -1).cast("int"))


def fractile(df: DataFrame, by: list[str], v: str, key: str, k: int, out: str = "fractile") -> DataFrame:
    """place * k div n, counted from 0; dates with fewer than k names are left out (see too_few)."""
    df = ordinal(df.where(covered(F.col(v))), by, v, key, "_k")
    df = df.withColumn("_n", F.count(F.lit(1)).over(_over(by))).where(F.col("_n") >= k)
    return df.withColumn(out, F.floor((F.col("_k") - 1) * k / F.col("_n")).cast("int")).drop("_k", "_n")


def too_few(df: DataFrame, by: list[str], v: str, k: int) -> DataFrame:
    """Ledger of the dates that fractile() leaves out."""
    n = F.sum(covered(F.col(v)).cast("int"))
    return df.groupBy(*by).agg(n.alias("covered")).where(F.col("covered") < k).withColumn("reason", F.lit("too_few_names"))


def top_bottom(df: DataFrame, by: list[str], v: str, key: str, k: int) -> DataFrame:
    """Names of the outer fractiles with leg +1 or -1."""
    f = fractile(df, by, v, key, k)
    return f.where(F.col("fractile").isin(0, k - 1)).withColumn("leg", F.when(F.col("fractile") == 0, -1).otherwise(1)).drop("fractile")


def demean(df: DataFrame, by: list[str], v: str, weight: str | None = None, out: str = "demeaned") -> DataFrame:
    """v less its group mean, equal- or `weight`-weighted."""
    w = _over(by)
    mean = F.avg(v).over(w) if weight is None else F.try_divide(F.sum(F.col(weight) * F.col(v)).over(w), F.sum(weight).over(w))
    return df.withColumn(out, F.col(v) - mean)


def residual(df: DataFrame, by: list[str], y: str, x: str, out: str = "residual") -> DataFrame:
    """y less its least-squares line on x; a slope of 0 where x does not vary."""
    w = _over(by)
    my, mx = F.avg(y).over(w), F.avg(x).over(w)
    sxx = F.var_pop(x).over(w)
    slope = F.coalesce(F.try_divide(F.covar_pop(y, x).over(w), sxx), F.lit(0.0))
    slope = F.when(sxx <= 0, 0.0).otherwise(slope)
    return df.withColumn(out, F.col(y) - my - slope * (F.col(x) - mx))
