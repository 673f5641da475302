"""Jaccard self-join over word shingles with PartEnum signatures.

Documents with the same shingle set are one class. Classes are put into bands
of near-equal size. A band divides the feature domain into first-level
partitions, each into three second-level parts; a signature is a first-level
partition's place with the features of two of its three parts. Two sets that
are similar enough differ in few features, so some first-level partition holds
at most one of the differences, and one choice of two parts holds none: the two
sets share that signature. A set signs only as many partitions as its largest
partner could need, and signs for the next band too if a partner can lie there.

Signatures of fewer than two features are common by chance. Each set signs
`spare` partitions more than it needs, and leaves such signatures out as long
as they are no more than the spare ones of the smallest set that it could meet
in that band. A pair shares one signature more than the spare ones of its
smaller set, so keeps at least one, whichever of the two leaves some out.

Rows that share a signature are found by sorting on it and streaming over the
sorted rows. What sets have in common lies in features that at least two
sets with a shared signature hold, so a set too many of whose features are its
own alone can link with none and is left out; one count by feature, combined
before it is shuffled, finds these. Of the rest, two sets that share a signature
are near if the counts of their features in 256 cells differ by no more than
those of linked sets can; sets joined by chains of near ones are a family. Mere
shared signatures would not do: by chance they chain ever more of a growing
table into one family. A family is compared in blocks of bounded size, by the
sizes of the intersections of whole sets; from each pair of blocks comes at most
one row for each set, that which joins it to its group there. So no link
between different sets is lost, and what is written follows the number of sets,
not of pairs. A family of more sets than a block holds is compared block
against block: work that grows with the square of such a family, at the speed
of a matrix product.

Features are 64-bit hashes of shingles; a class is a set's size and 128-bit
hash.

Defined cases: null texts and texts without words have empty sets, which link
with nothing; fewer than four words are one shingle; repeated rows are members
of one class; null doc_ids are members that never name a component unless all
of a component's are null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release, shuffle_tasks

BLOCK_SETS = 1_500  # sets of a block at most, on average
BLOCK_FEATURES = 1_000_000  # features of a block at most, on average
DENSE = 16  # sets that hold a feature from which on it is a column of a matrix
TILE = 8 << 20  # cells of such a matrix at once
CELLS = 256  # of the feature domain, in which a set's features are counted


@dataclass(frozen=True)
class Similar:
    """Sets link when 100 * intersection >= percent * union."""

    percent: int = 85
    words: int = 4
    ratio: float = 1.3  # of a band's sizes

    def most_apart(self, sizes: int) -> int:
        """The largest symmetric difference of two linked sets of that total size."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    def smallest_partner(self, size: int) -> int:
        return -(-self.percent * size // 100)

    def bands(self, size: int) -> list[int]:
        """The bands in which a set of that size signs."""
        b = self.band(size)
        return [b, b + 1] if self.largest_partner(size) >= self.band_start(b + 1) else [b]

    def band_start(self, b: int) -> int:
        n = 1
        for _ in range(b):
            n = max(n + 1, int(n * self.ratio))
        return n

    def band(self, size: int) -> int:
        b, n = 0, 1
        while (m := max(n + 1, int(n * self.ratio))) <= size:
            b, n = b + 1, m
        return b

    def needed(self, size: int) -> int:
        """First-level partitions that a set of that size signs."""
        return self.least(size) + self.spare(size)

    def least(self, size: int) -> int:
        """Partitions of which one, at least, holds at most one difference from any partner."""
        return self.most_apart(size + self.largest_partner(size)) // 2 + 1

    def spare(self, size: int) -> int:
        n = self.least(size)
        return 1 + n // 12 if n > 3 else 0

    def width(self, band: int) -> int:
        """First-level partitions of a band's domain: enough for its largest set."""
        return self.needed(self.band_start(band + 1) - 1)


def _sets(words, k: int):
    """(features, document bounds): each document's distinct shingle hashes, ascending."""
    import numpy as np

    from .words import mix, windows

    h, first = words.hashes(), words.first
    n = np.diff(first)
    runs = windows(h, k)
    out, bounds = [], [0]
    for d in range(len(n)):
        a, b = first[d], first[d + 1]
        if n[d] >= k:
            s = np.unique(runs[a : b - k + 1])
        elif n[d]:
            whole = np.full(1, n[d], np.uint64)
            for j in range(a, b):
                whole = mix(whole * np.uint64(31) + h[j : j + 1])
            s = whole
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bounds)


def _class_hashes(features, bounds):
    import numpy as np

    from .words import mix

    sums = []
    for k in (1, 2):
        total = np.zeros(len(features) + 1, np.uint64)
        np.cumsum(mix(features + np.uint64(k)), out=total[1:])
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return sums


def parts_of(features, sizes_band: int, similar: Similar, needed: int):
    """(sums, counts) of the second-level parts that a set signs, three for each first-level partition."""
    import numpy as np

    width = similar.width(sizes_band)
    place = ((features >> np.uint64(11)) % np.uint64(3 * width)).astype(np.int64)
    low = (features & np.uint64(0xFFFFFFFF)).astype(np.float64)  # sums stay below 2**53, so exact
    high = (features >> np.uint64(32)).astype(np.float64)
    m = 3 * needed
    counts = np.bincount(place, minlength=3 * width)[:m]
    a = np.bincount(place, weights=low, minlength=3 * width)[:m].astype(np.uint64)
    b = np.bincount(place, weights=high, minlength=3 * width)[:m].astype(np.uint64)
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F), counts


def signatures(features, similar: Similar):
    """(signature hashes) of one set, over its bands."""
    import numpy as np

    from .words import mix

    size, out = len(features), []
    needed = similar.needed(size)
    for band in similar.bands(size):
        sums, counts = parts_of(features, band, similar, needed)
        sums, counts = sums.reshape(-1, 3), counts.reshape(-1, 3)
        place = np.arange(len(sums), dtype=np.uint64) * np.uint64(3)
        found, weights = [], []
        for skip in range(3):
            i, j = [x for x in range(3) if x != skip]
            key = mix(sums[:, i]) + np.uint64(3) * mix(sums[:, j] + np.uint64(1))
            found.append(mix(key + mix((place + np.uint64(skip)) * np.uint64(64) + np.uint64(band))))
            weights.append(counts[:, i] + counts[:, j])
        found, weights = np.concatenate(found), np.concatenate(weights)
        weak = weights < 2
        # partners in its own band may be smaller; the next band is signed for larger ones
        spare = similar.spare(similar.smallest_partner(size) if band == similar.band(size) else size)
        out.append(found[~weak] if 0 < weak.sum() <= spare else found)
    return np.concatenate(out)


def class_table(docs: DataFrame, similar: Similar) -> DataFrame:
    """doc_id, h (the text's hash), n, c1, c2 of each row; no texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices

        for batch in batches:
            for lo, hi, w in slices(batch.column(2), fold=True):
                features, bounds = _sets(w, similar.words)
                c1, c2 = _class_hashes(features, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(c1), pa.array(c2)], names=["doc_id", "h", "n", "c1", "c2"])

    return docs.select("doc_id", "h", "t").mapInArrow(run, "doc_id long, h long, n long, c1 long, c2 long")


def signed(docs: DataFrame, similar: Similar) -> DataFrame:
    """sig, c (the first half of a class's hash) over all rows; a task signs each class once while it remembers it.

    Should two classes agree in c, each stands for both: a pair more to verify, none lost.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices

        seen: set = set()
        for batch in batches:
            for _, _, w in slices(batch.column(2), fold=True):
                features, bounds = _sets(w, similar.words)
                c1, c2 = _class_hashes(features, bounds)
                sigs, who = [], []
                for d in range(len(c1)):
                    if bounds[d] == bounds[d + 1] or (key := (c1[d], c2[d])) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(key)
                    s = signatures(features[bounds[d] : bounds[d + 1]], similar)
                    sigs.append(s)
                    who.append(np.full(len(s), d))
                if sigs:
                    s, who = np.concatenate(sigs).view(np.int64), np.concatenate(who)
                    for a in range(0, len(s), 200_000):
                        b = a + 200_000
                        yield pa.RecordBatch.from_arrays([pa.array(s[a:b]), pa.array(c1[who[a:b]])], names=["sig", "c"])

    return docs.select("doc_id", "h", "t").mapInArrow(run, "sig long, c long")


def shared(sigs: DataFrame) -> DataFrame:
    """sig, c of signatures with several classes, each class once; streams over sorted rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = None  # the last row of what came before: sig, c, its place among its signature's classes
        for batch in batches:
            sig, c, place = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            if not len(sig):
                continue
            if held is not None:
                sig, c, place = np.concatenate(([held[0]], sig)), np.concatenate(([held[1]], c)), held[2]
            n = len(sig)
            new = np.ones(n, bool)
            new[1:] = sig[1:] != sig[:-1]
            fresh = new.copy()  # not a repeat of the row before
            fresh[1:] |= c[1:] != c[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            count = np.cumsum(fresh)
            k = count - count[first] + np.where(first == 0, place, 0)
            last_place = np.zeros(n, np.int64)
            np.maximum.at(last_place, first, k)
            out = fresh & (last_place[first] > 0)
            if held is not None:
                out[0] = place == 0 and last_place[0] > 0  # a later place was put out with its own batch
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(c[out])], names=["sig", "c"])
            held = (sig[-1], c[-1], int(k[-1]))

    spark = sigs.sparkSession
    return sigs.repartition(shuffle_tasks(spark), "sig").sortWithinPartitions("sig", "c").mapInArrow(run, "sig long, c long")


SENT = 200_000  # class names sent to every task at most; beyond, texts are shuffled to them


def _texts(names: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """c1, c2, t (its first text) of the classes with the names c."""
    wanted = classes.join(names, classes["c1"] == names["c"], "left_semi").select(F.col("rep.doc_id").alias("w_id"), F.col("rep.h").alias("w_h"), "c1", "c2")
    wanted = materialise(wanted, "wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    return found.select("c1", "c2", "t")


def own_features(texts: DataFrame, similar: Similar, share: int = 1) -> DataFrame:
    """c, own: how many features of the classes named c no other text of the table has, of one in `share` features."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices

        for batch in batches:
            for lo, hi, w in slices(batch.column(1), fold=True):
                f, bounds = _sets(w, similar.words)
                c = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), np.diff(bounds))
                if share > 1:
                    some = f % np.uint64(share) == 0
                    f, c = f[some], c[some]
                for a in range(0, len(f), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(f[a : a + 200_000].view(np.int64)), pa.array(c[a : a + 200_000])], names=["f", "c"])

    held = texts.select("c1", "t").mapInArrow(run, "f long, c long").groupBy("f").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("c"))
    return held.where("times = 1").groupBy("c").agg(F.count(F.lit(1)).alias("own"))


def cell_counts(features, bounds):
    """Rows of how many of a set's features lie in each cell, 255 at most. Two rows differ by no more than their sets do."""
    import numpy as np

    sets = len(bounds) - 1
    cell = np.repeat(np.arange(sets) * CELLS, np.diff(bounds)) + (features >> np.uint64(3)).astype(np.int64) % CELLS
    return np.minimum(np.bincount(cell, minlength=sets * CELLS), 255).astype(np.uint8).reshape(sets, CELLS)


def set_table(texts: DataFrame, similar: Similar) -> DataFrame:
    """c1, c2, n, s (the features as bytes), counts (those of cell_counts) of texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices

        for batch in batches:
            for lo, hi, w in slices(batch.column(2), fold=True):
                f, bounds = _sets(w, similar.words)
                sets = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((8 * bounds).astype(np.int32).tobytes()), pa.py_buffer(f.tobytes())])
                counts = pa.array([row.tobytes() for row in cell_counts(f, bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), sets, counts], names=["c1", "c2", "n", "s", "counts"])

    return texts.select("c1", "c2", "t").mapInArrow(run, "c1 long, c2 long, n long, s binary, counts binary")


def intersections(sets: list, left: int):
    """Sizes of the intersections of each of the first `left` sets with each of the others; with left = all, of all with all."""
    import numpy as np

    rows = len(sets)
    within = left == rows
    f = np.concatenate(sets)
    who = np.repeat(np.arange(rows), [len(s) for s in sets])
    order = np.argsort(f, kind="stable")
    f, who = f[order], who[order]
    new = np.ones(len(f), bool)
    new[1:] = f[1:] != f[:-1]
    held = np.diff(np.append(np.flatnonzero(new), len(f)))
    column = np.cumsum(new) - 1
    out = np.zeros((left, rows if within else rows - left), np.float32)
    few = held[column] < DENSE
    low, at = who[few], column[few]
    for d in range(1, DENSE - 1):  # features that few sets hold, pair by pair
        a, b = low[:-d], low[d:]  # a column's rows ascend
        pair = at[:-d] == at[d:]
        if not pair.any():
            break
        if not within:
            pair &= (a < left) & (b >= left)
        a, b = a[pair], b[pair]
        if len(a):
            cells = a * out.shape[1] + (b if within else b - left)
            out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    many = ~few
    if many.any():  # the others as a matrix
        _, at = np.unique(column[many], return_inverse=True)
        who, total = who[many], int(at[-1]) + 1
        wide = max(1, TILE // rows)
        for a in range(0, total, wide):
            part = slice(*np.searchsorted(at, (a, a + wide)))
            cells = np.zeros((rows, min(wide, total - a)), np.float32)
            cells[who[part], at[part] - a] = 1
            out += cells[:left] @ (cells if within else cells[left:]).T
    return out


def least_labels(a, b, n: int):
    """The least of the nodes 0..n-1 that each reaches by edges a, b."""
    import numpy as np

    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _joined(similar: Similar):
    """A block pair's group function: each set that links, with the first of the sets to which links join it there."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("side").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        side, i, j = (table.column(k).to_numpy() for k in ("side", "i", "j"))
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("s")]
        rows = len(sets)
        left = rows if i[0] == j[0] else int((side == i[0]).sum())
        if 0 < left and (left < rows or i[0] == j[0]):
            common = intersections(sets, left)
            n = np.array([len(s) for s in sets])
            both = n[:left, None] + (n if left == rows else n[left:])[None, :]
            a, b = np.nonzero((100 + similar.percent) * common.astype(np.int64) >= similar.percent * both)
            label = least_labels(a, b if left == rows else b + left, rows)
        else:
            label = np.arange(rows)
        tied = np.flatnonzero(label != np.arange(rows))
        c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
        return pa.Table.from_arrays([pa.array(x) for x in (c1[tied], c2[tied], c1[label[tied]], c2[label[tied]])], names=["a1", "a2", "b1", "b2"])

    return run


def links_within(sets: DataFrame, families: DataFrame, similar: Similar) -> DataFrame:
    """Pairs (a1, a2, b1, b2) of classes that links join, over each family (c, family) of set_table's rows."""
    # a family's rows meet in one task as names only; the sets themselves are dealt out by class, then by pair of blocks
    light = sets.select("c1", "c2", "n").join(families, sets["c1"] == families["c"]).drop("c")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_FEATURES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    named = light.drop("n").join(light.groupBy("family").agg(blocks.alias("blocks")), "family")
    sized = sets.select("c1", "c2", "s").join(named, ["c1", "c2"])
    sized = sized.withColumn("side", F.pmod(F.xxhash64("c1", "c2"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("side")).alias("i"), F.greatest(k, F.col("side")).alias("j")))
    sized = sized.withColumn("ij", F.explode(both)).select("family", "ij.i", "ij.j", "side", "c1", "c2", "s")
    return sized.groupBy("family", "i", "j").applyInArrow(_joined(similar), "a1 long, a2 long, b1 long, b2 long")


def components(edges: DataFrame) -> DataFrame:
    """v, comp (the least node reachable) of the nodes with edges a, b. Labels spread along edges and jump over labels until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = materialise(both, "edges")
    linked = both.select(F.col("a").alias("v")).distinct()
    labels = materialise(linked.withColumn("comp", F.col("v")), "labels")
    while True:
        # least label among a node and its neighbours
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", "comp", F.least("comp", "near").alias("least"))
        # a label is itself a node: take on its label
        jump = step.select(F.col("v").alias("j"), F.col("least").alias("far"))
        step = step.join(jump, F.col("least") == F.col("j")).select("v", "comp", F.least("least", "far").alias("next"))
        step = materialise(step, "labels")
        changed = step.where(F.col("next") != F.col("comp")).limit(1).count()
        labels = step.select("v", F.col("next").alias("comp"))
        if not changed:
            return labels


def near_chains(n, counts, similar: Similar):
    """(a, b): places of near sets, enough to chain all that near ones join; each set is met with those not yet joined only."""
    import numpy as np

    counts, found_a, found_b = counts.astype(np.int16), [], []
    free, wide = np.arange(len(n)), max(1, TILE // CELLS)
    while len(free) > 1:
        front, free = free[:1], free[1:]
        while len(front) and len(free):
            by = np.full(len(free), -1)
            step = max(1, TILE // (CELLS * len(free)))
            for lo in range(0, len(front), step):
                f, open_ = front[lo : lo + step], np.flatnonzero(by < 0)
                for at in range(0, len(open_), wide):
                    g = open_[at : at + wide]
                    apart = np.abs(counts[f][:, None] - counts[free[g]][None]).sum(2, dtype=np.int64)
                    near = (100 + similar.percent) * apart <= (100 - similar.percent) * (n[f][:, None] + n[free[g]][None])
                    by[g] = np.where(near.any(0), f[near.argmax(0)], -1)
            joined = by >= 0
            found_a.append(by[joined])
            found_b.append(free[joined])
            front, free = free[joined], free[~joined]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_edges(members: DataFrame, similar: Similar) -> DataFrame:
    """a, b: near ones of the classes (sig, c, n, counts) that share a signature, enough for all their chains; streams over sorted rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def edges(table):
            sig, c, n = (table.column(k).to_numpy() for k in ("sig", "c", "n"))
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, CELLS)
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(first, len(sig)))
            one = np.repeat(first, size)
            apart = np.zeros(len(sig), np.int64)
            for at in range(0, len(sig), 4096):
                part = slice(at, at + 4096)
                apart[part] = np.abs(counts[part].astype(np.int16) - counts[one[part]]).sum(1, dtype=np.int64)
            near = (100 + similar.percent) * apart <= (100 - similar.percent) * (n + n[one])
            whole = np.logical_and.reduceat(near, first)  # all of the signature's are near the first
            a, b = [one[np.repeat(whole, size)]], [np.flatnonzero(np.repeat(whole, size))]
            for k in np.flatnonzero(~whole & (size > 2)):
                part = slice(first[k], first[k] + size[k])
                x, y = near_chains(n[part], counts[part], similar)
                a.append(x + first[k])
                b.append(y + first[k])
            a, b = c[np.concatenate(a)], c[np.concatenate(b)]
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        held: list = []  # rows of the signature that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column(0).to_numpy()
            start = int(np.searchsorted(sig, sig[-1]))
            if start or (held and held[0].column(0)[0].as_py() != sig[0]):
                # all before the last signature is whole; held rows belong to it or are whole too
                yield edges(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield edges(pa.Table.from_batches(held))

    spark = members.sparkSession
    rows = members.select("sig", "c", "n", "counts").repartition(shuffle_tasks(spark), "sig").sortWithinPartitions("sig")
    return rows.mapInArrow(run, "a long, b long").distinct()


def families(members: DataFrame, sets: DataFrame, similar: Similar) -> DataFrame:
    """c, family of the classes that still share a signature (sig, c), by chains of near ones."""
    # of signatures with the same classes, one is enough
    kept = members.groupBy("sig").agg(F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("k"))
    kept = kept.where("k > 1").groupBy("x", "y", "k").agg(F.min("sig").alias("sig")).select("sig")
    counted = sets.select(F.col("c1").alias("c"), "n", "counts")
    edges = near_edges(members.join(kept, "sig", "left_semi").join(counted, "c"), similar)
    return components(edges).select(F.col("v").alias("c"), F.col("comp").alias("family"))


def link(docs: DataFrame, doc_id: Column, text: Column, similar: Similar = Similar()) -> DataFrame:
    """doc_id, h, n_shingles, component_id, g1, g2 for every row.

    h: xxhash64 of the text, null as empty. component_id: the smallest doc_id
    reachable by links. g1, g2: the component's name, which tells components
    apart whose doc_ids are all null; null for an empty set.
    """
    spark = docs.sparkSession
    content = F.coalesce(text, F.lit(""))
    source = docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(content).alias("h"), content.cast("binary").alias("t"))
    rows = materialise(class_table(source, similar), "classes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    classes = materialise(rows.where("n > 0").groupBy("c1", "c2").agg(least.alias("rep"), F.first("n").alias("n")), "class-reps")
    members = materialise(shared(signed(source, similar)), "shared-signatures")
    release(spark)
    sizes = classes.groupBy(F.col("c1").alias("c")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    left = members
    # a third of the features shows most sets that leave; all are counted only among those that stay
    for share in (3, 1):
        own = own_features(_texts(left.select("c").distinct(), classes, source), similar, share)
        # a name that two classes have stays, whatever the count
        apart = own.join(sizes, "c").where((F.col("k") == 1) & (100 * (F.col("n") - F.col("own")) < similar.percent * F.col("n"))).select("c")
        before, left = left, materialise(left.join(apart, "c", "left_anti"), "near-signatures")
        discard(before)
        release(spark)
    sets = materialise(set_table(_texts(left.select("c").distinct(), classes, source), similar).dropDuplicates(["c1", "c2"]), "sets")
    near = materialise(families(left, sets, similar), "families")
    discard(left)
    edges = materialise(links_within(sets, near, similar), "links")
    discard(sets)
    release(spark)
    name = F.struct(F.col("rep.none").alias("none"), F.col("rep.doc_id").alias("doc_id"), "c1", "c2")
    a = classes.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), name.alias("a"))
    b = classes.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), name.alias("b"))
    labelled = components(edges.distinct().join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a", "b"))
    release(spark)
    owners = labelled.select("v.c1", "v.c2", F.col("comp.doc_id").alias("owner"), F.col("comp.c1").alias("o1"), F.col("comp.c2").alias("o2"))
    out = rows.join(classes.select("c1", "c2", F.col("rep.doc_id").alias("first_id")), ["c1", "c2"], "left").join(owners, ["c1", "c2"], "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("owner", "first_id", "doc_id").alias("component_id"), *[F.when(F.col("n") > 0, F.coalesce(f"o{k}", f"c{k}")).alias(f"g{k}") for k in (1, 2)])
