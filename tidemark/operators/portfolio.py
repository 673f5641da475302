"""Books from scores: equal legs, signal weights with caps, and a constrained optimiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xsec
from ..sources.store import materialised


def level1(df: DataFrame, by: list[str], score: str, key: str, k: int, gross: float = 2.0) -> DataFrame:
    """Outer fractiles, each leg gross/2 in equal weights."""
    legs = xsec.top_bottom(df, by, score, key, k)
    return legs.withColumn("weight", F.col("leg") * (gross / 2) / F.count(F.lit(1)).over(Window.partitionBy(*by, "leg")))


def level2(df: DataFrame, by: list[str], score: str, key: str, k: int, gross: float = 2.0, beta: str | None = None, joint: bool = False) -> DataFrame:
    """Signal weights over the outer fractiles.

    The score is centred within the selection (residual on beta if given: by leg,
    or over both legs), names whose sign disagrees with their leg drop out in the
    by-leg form, and each side is scaled to gross/2.
    """
    legs = xsec.top_bottom(df, by, score, key, k)
    if beta:
        signed = xsec.residual(legs, by if joint else [*by, "leg"], score, beta, "_s")
        if not joint:
            signed = signed.withColumn("_s", F.col("_s") + F.avg(score).over(Window.partitionBy(*by, "leg")) - F.avg(score).over(Window.partitionBy(*by)))
    else:
        signed = xsec.demean(legs, by, score, out="_s")
    sided = signed.where(F.col("_s") != 0).withColumn("_side", F.signum("_s"))
    total = F.sum(F.abs("_s")).over(Window.partitionBy(*by, "_side"))
    return sided.withColumn("weight", F.col("_s") / total * (gross / 2)).drop("_s", "_side")


def capped(df: DataFrame, by: list[str], weight: str, key: str, cap: float) -> DataFrame:
    """Weights of one sign pinned at the cap, the excess spread pro rata over the rest, until none exceeds it.

    In closed form: sorted by falling size, the first m are pinned for the least
    m at which the (m+1)th, scaled by what remains, is within the cap. Sides
    whose names times cap cannot hold their gross are all at the cap.
    """
    side = F.signum(F.col(weight))
    w = Window.partitionBy(*by, "_side").orderBy(F.abs(weight).desc(), key)
    part = Window.partitionBy(*by, "_side")
    d = df.withColumn("_side", side).withColumn("_a", F.abs(weight))
    d = d.withColumn("_k", F.row_number().over(w) - 1).withColumn("_total", F.sum("_a").over(part)).withColumn("_rest", F.sum("_a").over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_scale", F.try_divide(F.col("_total") - F.col("_k") * cap, F.col("_rest")))
    fits = F.when((F.col("_scale") * F.col("_a") <= cap) & (F.col("_scale") >= 0), F.col("_k"))
    d = d.withColumn("_m", F.min(fits).over(part)).withColumn("_s", F.min(F.when(F.col("_k") == F.col("_m"), F.col("_scale"))).over(part))
    pinned = F.col("_m").isNull() | (F.col("_k") < F.col("_m"))
    return d.withColumn("capped", F.col("_side") * F.when(pinned, F.lit(cap)).otherwise(F.col("_a") * F.col("_s"))).drop("_side", "_a", "_k", "_total", "_rest", "_scale", "_m", "_s")


class Infeasible(ValueError):
    """No book satisfies the constraints; names the most violated."""


def optimise(alpha, cov, lower, upper, rows, bounds, gross: float, risk: float = 0.0, steps: int = 4_000, tolerance: float = 1e-6, volatility: float | None = None, held=None, cost: float = 0.0, borrow: float = 0.0, turnover: float | None = None):
    """Maximises alpha'w - risk w'Cw/2 - cost sum|w - held| - borrow sum max(-w, 0) subject to lower <= w <= upper, rows w in bounds, sum|w| <= gross, w'Cw <= volatility**2 and sum|w - held| <= 2 turnover.

    Operator splitting: the quadratic step is one factored linear system, the
    constraints are projections; then every constraint is checked again. Bounds
    that contradict one another are named before anything is solved.
    rows: list of (name, vector); bounds: list of (low, high). cov may be a
    vector of variances: then a step's work and memory follow names times rows,
    with no matrix of names by names.
    """
    import numpy as np

    alpha, cov = np.asarray(alpha, float), np.asarray(cov, float)
    n = len(alpha)
    many = np.array([np.asarray(v, float) for _, v in rows]).reshape(len(rows), n)
    low = np.concatenate((np.asarray(lower, float), [b[0] for b in bounds]))
    high = np.concatenate((np.asarray(upper, float), [b[1] for b in bounds]))
    held = np.zeros(n) if held is None else np.asarray(held, float)
    if found := conflicts(low, high, [(name, many[k]) for k, (name, _) in enumerate(rows)], gross, held, turnover):
        raise Infeasible(", ".join(found[:3]))
    rho, sigma = 1.0, 1e-6
    charged = cost > 0 or borrow > 0
    plain = sigma + rho * (2 + charged + (turnover is not None))
    if cov.ndim == 1:
        root = None if volatility is None else np.sqrt(np.maximum(cov, 0))
        of_root = lambda v: root * v
        # a diagonal and a few rows: the rows' part of the inverse is small
        slim = 1 / (risk * cov + plain + (0 if root is None else rho * root * root))
        inner = np.linalg.inv(np.eye(len(many)) / rho + (many * slim) @ many.T)
        solve = lambda v: slim * (v - many.T @ (inner @ (many @ (slim * v))))
    else:
        root = None
        if volatility is not None:
            values, vectors = np.linalg.eigh(cov)
            root = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
        of_root = lambda v: root @ v
        system = np.linalg.inv(risk * cov + plain * np.eye(n) + rho * (many.T @ many + (0 if root is None else root @ root)))
        solve = lambda v: system @ v
    w, z, y = np.zeros(n), np.zeros(len(low)), np.zeros(len(low))
    g, u = np.zeros(n), np.zeros(n)
    h, q = np.zeros(n), np.zeros(n)  # the charged copy of w
    v, x = np.zeros(n), np.zeros(n)  # root w, within its ball
    b, p = held.copy(), np.zeros(n)  # the copy of w that is near held
    for _ in range(steps):
        push = rho * z - y
        pull = alpha + sigma * w + push[:n] + many.T @ push[n:] + rho * g - u
        if charged:
            pull = pull + rho * h - q
        if root is not None:
            pull = pull + of_root(rho * v - x)
        if turnover is not None:
            pull = pull + rho * b - p
        w = solve(pull)
        az = np.concatenate((w, many @ w))
        z_new = np.clip(az + y / rho, low, high)
        g_new = _onto_l1(w + u / rho, gross)
        y, u = y + rho * (az - z_new), u + rho * (w - g_new)
        done = max(np.abs(az - z_new).max(), np.abs(w - g_new).max(), np.abs(z_new - z).max(), np.abs(g_new - g).max())
        z, g = z_new, g_new
        if charged:
            h_new = _charged(w + q / rho, held, cost / rho, borrow / rho)
            q, done = q + rho * (w - h_new), max(done, np.abs(w - h_new).max(), np.abs(h_new - h).max())
            h = h_new
        if turnover is not None:
            b_new = held + _onto_l1(w + p / rho - held, 2 * turnover)
            p, done = p + rho * (w - b_new), max(done, np.abs(w - b_new).max(), np.abs(b_new - b).max())
            b = b_new
        if root is not None:
            at = of_root(w)
            v_new = at + x / rho
            v_new = v_new * min(1.0, volatility / max(np.linalg.norm(v_new), 1e-300))
            x, done = x + rho * (at - v_new), max(done, np.abs(at - v_new).max(), np.abs(v_new - v).max())
            v = v_new
        if done < tolerance / 10:
            break
    w = np.where(np.abs(w) < tolerance / 10, 0.0, w)
    names = [f"position_{k}" for k in range(n)] + [r[0] for r in rows] + ["gross", "volatility", "turnover"]
    aw = np.concatenate((w, many @ w))
    over = np.concatenate((np.maximum(low - aw, aw - high), [np.abs(w).sum() - gross, 0.0 if root is None else np.linalg.norm(of_root(w)) - volatility, 0.0 if turnover is None else np.abs(w - held).sum() - 2 * turnover]))
    if over.max() > 100 * tolerance:
        worst = sorted(zip(over, names), reverse=True)[:3]
        raise Infeasible(", ".join(f"{name} by {x:.3g}" for x, name in worst if x > 0))
    return w


def conflicts(low, high, rows, gross: float, held, turnover: float | None) -> list[str]:
    """Contradictions that the bounds alone show: low and high of each position, then of each row."""
    import numpy as np

    n = len(held)
    out = [f"position_{k} has no room" for k in np.flatnonzero(low[:n] > high[:n])]
    lower, upper = low[:n], high[:n]
    for k, (name, v) in enumerate(rows):
        least, most = np.minimum(v * lower, v * upper).sum(), np.maximum(v * lower, v * upper).sum()
        if low[n + k] > high[n + k] or least > high[n + k] + 1e-12 or most < low[n + k] - 1e-12:
            out.append(f"{name} cannot be reached within the position bounds")
    if gross < 0 or np.maximum(np.maximum(lower, -upper), 0).sum() > gross + 1e-12:
        out.append("gross is less than the positions need")
    if turnover is not None and (turnover < 0 or np.maximum(np.maximum(lower - held, held - upper), 0).sum() > 2 * turnover + 1e-12):
        out.append("turnover is less than the positions need")
    return out


def _charged(x, held, cost: float, borrow: float):
    """The h that minimises cost |h - held| + borrow max(-h, 0) + (h - x)**2 / 2, by name."""
    import numpy as np

    first, second = np.minimum(held, 0), np.maximum(held, 0)
    h = x + cost + borrow
    h = np.where(h > first, np.maximum(first, x - np.where(held > 0, -cost, cost - borrow)), h)
    return np.where(h > second, np.maximum(second, x - cost), h)


def _onto_l1(v, radius: float):
    import numpy as np

    size = np.abs(v)
    if size.sum() <= radius:
        return v
    s = np.sort(size)[::-1]
    c = np.cumsum(s) - radius
    k = np.flatnonzero(s > c / np.arange(1, len(s) + 1))[-1]
    return np.sign(v) * np.maximum(size - c[k] / (k + 1), 0)


def level3(df: DataFrame, by: list[str], key: str, score: str, cap: float, gross: float, beta: str | None = None, groups: list[str] = (), group_net: float = 0.05, variance: str | None = None, risk: float = 1.0, held: str | None = None, most_turnover: float | None = None, adv: str | None = None, nav: float | None = None, most_participation: float | None = None, hard_to_borrow: str | None = None, volatility: float | None = None, cost: float = 0.0, borrow: float = 0.0) -> DataFrame:
    """One optimised book a date: dollar and beta neutral, capped, group-neutral within group_net, with a one-way turnover of at most most_turnover against held.

    Trades are within most_participation of adv for a book of nav; names that
    are hard_to_borrow are not short; volatility bounds the book's, in the
    period of variance; cost and borrow are rates a period on trades and shorts.
    A name without its adv makes a date infeasible.
    Dates are independent; each is one task's group, of the size of a universe.
    Infeasible dates return no weights and the named constraints.
    """
    from pyspark.sql import types as T

    if volatility is not None and not variance:
        raise ValueError("a volatility bound needs variances")
    if most_participation is not None and not (adv and nav and nav > 0):
        raise ValueError("a participation bound needs adv and a positive nav")
    schema = T.StructType([*[df.schema[c] for c in by], df.schema[key], T.StructField("weight", T.DoubleType()), T.StructField("status", T.StringType())])

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(key)
        n = len(pdf)
        rows, bounds = [("net", np.ones(n))], [(0.0, 0.0)]
        if beta:
            rows.append(("beta", pdf[beta].to_numpy(float)))
            bounds.append((0.0, 0.0))
        for g in groups:
            for value in sorted(pdf[g].dropna().unique()):
                rows.append((f"{g}={value}", (pdf[g] == value).to_numpy(float)))
                bounds.append((-group_net, group_net))
        lower, upper = np.full(n, -cap), np.full(n, cap)
        now = pdf[held].fillna(0).to_numpy(float) if held else np.zeros(n)
        unknown = 0
        if most_participation is not None:
            volume = pdf[adv].to_numpy(float)
            unknown = int((~np.isfinite(volume) | (volume < 0)).sum())
            each = most_participation * np.nan_to_num(volume) / nav
            lower, upper = np.maximum(lower, now - each), np.minimum(upper, now + each)
        if hard_to_borrow:
            lower = np.where(pdf[hard_to_borrow].fillna(True).to_numpy(bool), np.maximum(lower, 0), lower)
        cov = pdf[variance].to_numpy(float) if variance else np.ones(n)
        out = pd.DataFrame({c: pdf[c].to_numpy() for c in by} | {key: pdf[key].to_numpy()})
        try:
            if unknown:
                raise Infeasible(f"{adv} unknown for {unknown} names")
            out["weight"], out["status"] = optimise(pdf[score].to_numpy(float), cov, lower, upper, rows, bounds, gross, risk, volatility=volatility, held=now, cost=cost, borrow=borrow, turnover=most_turnover if held else None), "ok"
        except Infeasible as e:
            out["weight"], out["status"] = np.nan, f"infeasible: {e}"
        return out[[*by, key, "weight", "status"]]

    return df.groupBy(*by).applyInPandas(run, schema)


NAMES = 500  # of a block at most
VALUES = 1 << 19  # of a block at most, unless one name has more
CELLS = 100_000  # pairs of names worked on at once


def covariance(returns: DataFrame, date: str, name: str, r: str, shrink: float = 0.0) -> DataFrame:
    """a, b, cov: sample covariance over common dates, off-diagonals shrunk towards 0.

    Names are packed into blocks, which are written once to the shared folder
    when this is called. Each pair of blocks is read from there for its matrix
    products, and pairs of names leave them as results only, so that disk
    follows the rows of returns and not the pairs: neither names nor their
    copies are dealt out to the pairs. Pairs with a value that is not finite
    have NaN. A pair's two rows lie near each other, so that files hold its
    value about once.
    """
    from collections.abc import Iterator

    from pyspark.sql import types as T

    kind = returns.schema[name].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("_c", T.DoubleType())])

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def block(part):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            most = -(-batch.num_rows // -(-batch.num_rows // NAMES))  # blocks of a size
            lo = values = 0
            for k, n in enumerate(pc.list_value_length(batch.column(1)).to_pylist()):
                if k > lo and (k - lo == most or values + n > VALUES):
                    yield block(batch.slice(lo, k - lo))
                    lo, values = k, 0
                values += n
            yield block(batch.slice(lo))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def pairs(blocks):
            tables = [pa.ipc.open_stream(x).read_all() for x in blocks]
            table = pa.concat_tables(tables)
            names, rows = table.column("name").combine_chunks(), table.column("rows").combine_chunks()
            who, flat = pc.list_parent_indices(rows).to_numpy(), pc.list_flatten(rows)
            days = flat.field(0).dictionary_encode()
            day, width = days.indices.to_numpy(), len(days.dictionary)
            x = flat.field(1)
            known, x = x.is_valid().to_numpy(zero_copy_only=False), x.cast(pa.float64()).fill_null(0.0).to_numpy()
            whole = np.isfinite(x)
            x = np.where(whole, x, 0.0)
            n, at = len(names), who * width + day
            per = np.bincount(who, weights=known & whole, minlength=n)
            mean = np.bincount(who, weights=x, minlength=n) / np.maximum(per, 1)
            there, held, sums, odd = (np.bincount(at, weights=v, minlength=n * width).reshape(n, width) for v in (np.ones(len(x)), known, np.where(known & whole, x - mean[who], 0.0), ~whole))
            left, right = np.arange(tables[0].num_rows), np.arange(n - tables[-1].num_rows, n)
            step = max(1, CELLS // len(right))
            for lo in range(0, len(left), step):
                u = left[lo : lo + step]
                meet = there[u] @ there[right].T > 0
                k = held[u] @ held[right].T
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = (sums[u] @ sums[right].T - (sums[u] @ held[right].T) * (held[u] @ sums[right].T) / k) / (k - 1)
                if not whole.all():
                    c[(odd[u] @ held[right].T + held[u] @ odd[right].T) > 0] = np.nan
                # a name's pairs, then the same pairs the other way round, unless the block meets itself
                a, back, b = np.nonzero(np.stack([meet] * len(tables), 1))
                one, two = u[a], right[b]
                one, two = np.where(back, two, one), np.where(back, one, two)
                c = pa.array(c[a, b], mask=k[a, b] < 2)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(one)), names.take(pa.array(two)), c], names=["a", "b", "_c"])

        for batch in batches:
            i, one, j, two = batch.columns
            for k in range(batch.num_rows):
                blocks = [one[k].as_buffer()] if i[k] == j[k] else [one[k].as_buffer(), two[k].as_buffer()]
                yield from pairs(blocks)

    known = returns.where(F.col(date).isNotNull())
    each = known.groupBy(F.col(name).alias("name")).agg(F.collect_list(F.struct(F.col(date).alias("d"), F.col(r).alias("x"))).alias("rows"))
    blocks = materialised(each.mapInArrow(pack, "block binary").select(F.monotonically_increasing_id().alias("i"), "block"))
    other = blocks.select(F.col("i").alias("j"), F.col("block").alias("other"))
    i, j = F.col("i"), F.col("j")
    once = (i == j) | ((i < j) == ((i + j) % 2 == 0))  # of two blocks, either comes first about as often, for even tasks
    c = blocks.hint("shuffle_replicate_nl").join(other, once).mapInArrow(run, schema)
    return c.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("_c")).otherwise((1 - shrink) * F.col("_c")).alias("cov"))
