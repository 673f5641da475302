"""Removal of repeated byte strings with per-shard suffix arrays.

A byte is removed if it lies in a string of `length` bytes that starts anywhere
else as well. The windows of `length` bytes of a text are cut into runs that
share their lowest k-gram hash, the run's anchor; equal windows have equal
anchors, so a window can only repeat where its anchor does. Runs with a lone
anchor are done. The texts of the others, one of each kind, are dealt to
shards by anchor. A shard builds one suffix array over its runs (Larsson-
Sadakane refinement: only groups not yet sorted are sorted again, by the rank
`h` further on, doubling h), takes common prefixes in Kasai's way (a prefix is
at least its left neighbour's less one, so only places where that chain breaks
are compared), and marks windows with a neighbour that shares `length` bytes.
An anchor with more runs than a shard holds is split over several shards;
each writes the sorted fingerprints of its distinct windows, and these are
merged two by two by binary search, by fingerprint range; the ranges of an
anchor grow with its runs.

Runs that are the same string are counted before anything is shuffled to a
shard, so copies cost one row each and no shard sees them twice.

Defined cases: null text is empty; texts under `length` bytes keep all; a row
that repeats another (its doc_id too) is a copy like any other; a null doc_id
is handled under null; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, materialise, scratch, shuffles_end_with_the_write

LENGTH, GRAM = 400, 24
RUN_MOST = 512  # windows of a run at most; bounds a run's text
SHARD_BYTES = 1_000_000
HOT_RUNS = 1_200  # runs of an anchor that one shard takes
RANGES = 64  # fingerprint ranges of a split anchor at least
RANGE_RUNS = 1_000  # runs of a split anchor for each of its ranges, above that


def _prefix(values, data):
    import numpy as np

    from .words import _powers

    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _prints(data, starts, ends):
    """Two 64-bit fingerprints of data[starts:ends], from prefix sums over two tables of byte values."""
    import numpy as np

    from .words import _state, mix

    values = _state()["values"]
    out = []
    for table in (values, mix(values)):
        sums, down = _prefix(table, data)
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out


def _loads(data):
    """The 8 bytes from each place on, as one number; zero bytes past the end."""
    import numpy as np

    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(np.uint64).ravel()


def _runs(data, bounds, length: int):
    """(start, windows, anchor, twice) of the runs of some texts end to end.

    twice: windows within the run may be equal. That needs an occurrence of the
    anchor that some of the run's windows hold and others do not, besides the
    one that opens or closes the run.
    """
    import numpy as np

    from .words import mix

    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64), none
    eight = _loads(data)
    gram = mix(eight[: n - 16] + mix(eight[8 : n - 8] + mix(eight[16:])))  # of 24 bytes
    wide = length - GRAM + 1
    gram = gram[: n - GRAM + 1]
    windows = len(gram) - wide + 1
    rows = -(-len(gram) // wide)
    square = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    square[: len(gram)] = gram
    square = square.reshape(rows, wide)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    # windows that stay inside their text
    last = np.repeat(bounds[1:], np.diff(bounds))[:windows] - length
    inside = np.arange(windows) <= last
    fresh = np.ones(windows, bool)
    fresh[1:] = (lowest[1:] != lowest[:-1]) | ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < windows]
    fresh[firsts] = True
    fresh &= inside
    start = np.flatnonzero(fresh)
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none
    stop = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1  # where stretches of inside windows end
    end = np.minimum(np.append(start[1:], windows), stop[np.searchsorted(stop, start, side="right")])
    leaves = np.concatenate(([0], np.cumsum(gram[:windows] == lowest)))
    enters = np.concatenate(([0], np.cumsum(gram[wide - 1 : wide - 1 + windows] == lowest)))
    twice = ((leaves[end - 1] - leaves[start]) > 0) | ((enters[end] - enters[start + 1]) > 0)
    parts = -(-(end - start) // RUN_MOST)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        far = np.repeat(end, parts)
        start = np.repeat(start, parts) + step * RUN_MOST
        end = np.minimum(start + RUN_MOST, far)
        twice = np.repeat(twice, parts)
    return start, end - start, lowest[start], twice


def run_table(source: DataFrame, length: int) -> DataFrame:
    """One row for each run: anchor, c1, c2 (its string), doc_id, h (its text), at, n (windows)."""
    schema = "anchor long, c1 long, c2 long, doc_id long, h long, at int, n int, twice boolean"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices

        for batch in batches:
            for lo, hi, w in slices(batch.column(2)):
                start, n, anchor, twice = _runs(w.data, w.bounds, length)
                if not len(start):
                    continue
                c1, c2 = _prints(w.data, start, start + n + length - 1)
                doc = np.searchsorted(w.bounds, start, side="right") - 1
                at = start - w.bounds[doc]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
                texts = batch.column(1).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, c1, c2)] + [ids, texts, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(twice)], names=["anchor", "c1", "c2", "doc_id", "h", "at", "n", "twice"])

    return source.select("doc_id", "h", "t").mapInArrow(run, schema)


def suffix_array(symbols):
    """Larsson-Sadakane over integers that end in symbols of their own, so that no suffix is another's prefix."""
    import numpy as np

    n = len(symbols)
    bits = max(1, int(n).bit_length())
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(2 * n + 1, np.int64)  # places past the end rank lowest
    rank[sa] = first + 1
    alone = new & np.append(new[1:], True)
    slots = np.flatnonzero(~alone)
    h = 1
    while len(slots):
        e = sa[slots]
        own, ahead = rank[e], rank[np.minimum(e + h, 2 * n)]
        if 3 * bits <= 64:
            packed = np.sort((own.astype(np.uint64) << np.uint64(2 * bits)) | (ahead.astype(np.uint64) << np.uint64(bits)) | e.astype(np.uint64))
            e = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
            pair = packed >> np.uint64(bits)
            new = np.ones(len(e), bool)
            new[1:] = pair[1:] != pair[:-1]
        else:
            order = np.lexsort((ahead, own))
            e, own, ahead = e[order], own[order], ahead[order]
            new = np.ones(len(e), bool)
            new[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        sa[slots] = e
        lead = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
        rank[e] = slots[lead] + 1
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(symbols, data, ends, sa):
    """(phi, plcp): each suffix's predecessor in order and the bytes it shares with it.

    ends: the place of the end symbol behind each place. Kasai's chain:
    plcp[i] >= plcp[i - 1] - 1, with equality unless the symbols before i and
    before its predecessor differ; only those places are compared.
    """
    import numpy as np

    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    broken = (phi <= 0) | (i == 0)
    ok = ~broken
    broken[ok] = symbols[i[ok] - 1] != symbols[phi[ok] - 1]
    at = np.flatnonzero(broken)
    there = phi[at]
    limit = np.where(there < 0, 0, np.minimum(ends[at] - at, ends[np.maximum(there, 0)] - there))
    value = np.zeros(len(at), np.int64)
    eight = _loads(data)
    live = np.flatnonzero(limit > 0)
    step = 0
    while len(live):
        a, b = at[live] + step, there[live] + step
        x = eight[a] ^ eight[b]
        same = x == 0
        low = x & (~x + np.uint64(1))
        byte = np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        value[live] = np.minimum(step + byte, limit[live])
        step += 8
        live = live[same & (limit[live] > step)]
    chain = np.maximum.accumulate(np.where(broken, i, 0))
    base = np.zeros(n, np.int64)
    base[at] = value
    return phi, np.maximum(base[chain] - (i - chain), 0)


def repeated_windows(bodies: list[bytes], length: int):
    """(data, starts, repeated, first): the runs end to end with an end byte behind each, which places start a
    window that also starts elsewhere, and which is the first of its kind in order."""
    import numpy as np

    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    stop = np.cumsum(sizes + 1) - 1
    starts = np.concatenate(([0], stop[:-1] + 1))
    symbols = data.astype(np.int64) + len(bodies)
    symbols[stop] = np.arange(len(bodies))
    sa = suffix_array(symbols)
    ends = np.repeat(stop, sizes + 1)
    phi, plcp = common_prefixes(symbols, data, ends, sa)
    long = plcp >= length
    repeated = long.copy()
    repeated[phi[long]] = True
    return data, starts, repeated, ~long


def _shard(length: int):
    """A shard's group function: intervals of repeated windows, and the fingerprints of split anchors."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        bodies = [b.as_py() for b in table.column("body")]
        data, starts, repeated, first = repeated_windows(bodies, length)
        n = table.column("n").to_numpy()
        copies, hot = table.column("copies").to_numpy() > 1, np.asarray(table.column("hot").to_pylist(), bool)
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = starts[which] + place
        marked = repeated[at] | copies[which]
        # intervals end at run ends too
        same = np.append(which[1:] == which[:-1], False)
        opens = marked & ~np.concatenate(([False], (marked[:-1] & same[:-1])))
        closes = marked & ~np.append(marked[1:] & same[:-1], False)
        o, c = np.flatnonzero(opens), np.flatnonzero(closes)
        keys = [table.column(k).to_numpy() for k in ("anchor", "c1", "c2")]
        rows = [k[which[o]] for k in keys] + [place[o], place[c] + 1]
        out = {"kind": np.zeros(len(o), np.int32), "anchor": rows[0], "c1": rows[1], "c2": rows[2], "lo": rows[3], "hi": rows[4]}
        arrays = [pa.array(out[k], t) for k, t in (("kind", pa.int32()), ("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))]
        arrays += [pa.nulls(len(o), pa.int32()), pa.nulls(len(o), pa.binary())]
        names = ["kind", "anchor", "c1", "c2", "lo", "hi", "range", "prints"]
        tables = [pa.Table.from_arrays(arrays, names=names)]
        w = np.flatnonzero(hot[which] & first[at])
        if len(w):
            f1, f2 = _prints(data, at[w], at[w] + length)
            ranges = table.column("ranges").to_numpy()[which[w]].astype(np.uint64)
            part = ((f1 >> np.uint64(32)) * ranges >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((f1, part, keys[0][which[w]]))
            w, f1, f2, part = w[order], f1[order], f2[order], part[order]
            anchor = keys[0][which[w]]
            cut = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]))))
            packed = np.empty(len(w), dtype=[("f1", "<u8"), ("f2", "<u8"), ("c1", "<i8"), ("c2", "<i8"), ("at", "<i4"), ("done", "<i4")])
            packed["f1"], packed["f2"], packed["c1"], packed["c2"], packed["at"], packed["done"] = f1, f2, keys[1][which[w]], keys[2][which[w]], place[w], marked[w]
            blobs = [packed[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(w)))]
            m = len(cut)
            tables.append(pa.Table.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(anchor[cut]), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.int32())] * 2, pa.array(part[cut], pa.int32()), pa.array(blobs, pa.binary())], names=names))
        return pa.concat_tables(tables)

    return run


def _merge(table):
    """Windows of a split anchor that two shards hold: sorted fingerprints are looked up in each other, two by two."""
    import numpy as np
    import pyarrow as pa

    kind = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("c1", "<i8"), ("c2", "<i8"), ("at", "<i4"), ("done", "<i4")])
    runs = [np.frombuffer(b.as_py(), kind) for b in table.column("prints")]
    anchor = table.column("anchor")[0].as_py()
    found = [runs[0][:0]]
    while len(runs) > 1:
        merged = [runs[-1]] if len(runs) % 2 else []
        for a, b in zip(runs[0::2], runs[1::2]):
            at = np.searchsorted(a["f1"], b["f1"])
            inside = at < len(a)
            hit = np.zeros(len(b), bool)
            hit[inside] = (a["f1"][at[inside]] == b["f1"][inside]) & (a["f2"][at[inside]] == b["f2"][inside])
            found += [b[hit], a[at[hit]]]
            merged.append(np.insert(a, at[~hit], b[~hit]))
        runs = merged
    rows = np.concatenate(found)
    rows = np.unique(rows[rows["done"] == 0])
    return pa.Table.from_arrays([pa.array(np.full(len(rows), anchor, np.int64)), pa.array(rows["c1"]), pa.array(rows["c2"]), pa.array(rows["at"], pa.int32()), pa.array(rows["at"] + 1, pa.int32())], names=["anchor", "c1", "c2", "lo", "hi"])


def repeated_spans(source: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, h, spans (array of from, to in bytes, unordered, may overlap) for texts with a repeated window.

    source: doc_id, h (a hash of the text), t (the text as bytes).
    """
    spark = source.sparkSession
    path = scratch(spark, "runs")
    with shuffles_end_with_the_write(spark):
        run_table(source, length).write.parquet(path)
    every = spark.read.schema("anchor long, c1 long, c2 long, doc_id long, h long, at int, n int, twice boolean").parquet(path)
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice")).where("times > 1 or twice").select("anchor")
    runs = materialise(every.drop("twice").join(again, "anchor", "left_semi"), "repeated-anchors")
    delete_path(spark, path)
    rep = F.min(F.struct("doc_id", "h", "at")).alias("rep")
    kinds = runs.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), rep)
    kinds = materialise(kinds, "run-kinds")
    by_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("times")).where("kinds > 1 or times = 1").drop("times")
    several = kinds.join(by_anchor, "anchor")
    size = several.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    hot = F.col("kinds") > HOT_RUNS
    part = F.pmod(F.xxhash64("c1", "c2"), F.ceil(F.col("kinds") / HOT_RUNS))
    shard = F.when(hot, F.xxhash64("anchor", part)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    ranges = F.greatest(F.lit(RANGES), F.ceil(F.col("kinds") / RANGE_RUNS)).cast("int")
    wanted = several.select(F.col("rep.doc_id").alias("r_id"), F.col("rep.h").alias("r_h"), F.struct("anchor", "c1", "c2", "copies", "n", F.col("rep.at").alias("at"), hot.alias("hot"), shard.alias("shard"), ranges.alias("ranges")).alias("k"))
    wanted = wanted.groupBy("r_id", "r_h").agg(F.collect_list("k").alias("ks"))
    cut = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))).select("t", F.explode("ks").alias("k"))
    bodies = cut.select("k.anchor", "k.c1", "k.c2", "k.copies", "k.n", "k.hot", "k.shard", "k.ranges", F.substring(F.col("t"), F.col("k.at") + 1, F.col("k.n") + length - 1).alias("body"))
    if source.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").take(1):
        bodies = bodies.dropDuplicates(["anchor", "c1", "c2"])  # a row and its repeat each gave the string
    found = bodies.groupBy("shard").applyInArrow(_shard(length), "kind int, anchor long, c1 long, c2 long, lo int, hi int, range int, prints binary")
    found = materialise(found, "shards")
    merged = found.where("kind = 1").groupBy("anchor", "range").applyInArrow(_merge, "anchor long, c1 long, c2 long, lo int, hi int")
    # a string alone under its anchor that came more than once repeats as a whole
    lone = kinds.join(by_anchor, "anchor", "left_anti").select("anchor", "c1", "c2", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    marks = found.where("kind = 0").select("anchor", "c1", "c2", "lo", "hi").unionByName(merged).unionByName(lone)
    marks = marks.groupBy("anchor", "c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    spans = runs.join(marks, ["anchor", "c1", "c2"]).select("doc_id", "h", F.explode(F.transform("marks", lambda m: F.struct((F.col("at") + m["lo"]).alias("a"), (F.col("at") + m["hi"] + length - 1).alias("b")))).alias("s"))
    return spans.groupBy("doc_id", "h").agg(F.collect_set("s").alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row."""
    if length < GRAM + 16:
        raise ValueError("strings must be longer than an anchor's gram")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    spans = repeated_spans(source, length).select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    joined = source.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "t", "spans")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, rows = batch.column(0), []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces, end, spans_n = [], 0, 0
                for x in sorted((x["a"], x["b"]) for x in s or ()):
                    if x[0] > end or (x[0] == 0 and end == 0):
                        pieces.append(t[end : x[0]])
                        spans_n += 1
                    end = max(end, x[1])
                pieces.append(t[end:])
                kept = b"".join(pieces)
                rows.append((len(t), len(t) - len(kept), spans_n, kept))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
