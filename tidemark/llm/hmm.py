"""Hidden Markov language model.

Words are emitted through classes: each of the commonest words is a class of
its own, every other word belongs to a class chosen by its ending. A class
emits its words by their add-one share of the class, with one share kept for
words never seen. So the latent part (states x classes) has a fixed size, while
the word counts behind it cover, and grow with, the whole training corpus.

Training: each task runs scaled forward and backward recursions over its
documents and adds up Baum-Welch counts; Spark sums them; the driver holds only
the states x classes tables. Scoring: the scaled forward recursion gives the
exact likelihood of each text, its end included.

Word counts are a distributed table. The commonest words (a fixed number) are
looked up in the scoring task; rarer ones are joined to the table by word, so
no key is hot.

Defined cases: null or empty text is the end alone; a null doc_id hashes as the
empty string; repeated rows count each; without training rows all counts are 0;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Shape:
    states: int = 4
    own: int = 4096  # words with a class of their own
    endings: int = 1024  # classes of the other words
    looked_up: int = 131_072  # words, at most, whose counts every scoring task holds
    rounds: int = 4
    stay: float = 0.9  # first guess of the chance to stay in a state
    smooth: float = 20.0  # tokens' worth of corpus frequencies mixed into each state's emissions
    seed: int = 7

    @property
    def classes(self) -> int:
        return self.own + self.endings + 1  # the end is the last


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """word (lower-cased bytes), c over a binary column t."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import distinct, slices

        for batch in batches:
            for _, _, w in slices(batch.column(0), fold=True):
                which, inverse = distinct(w.hashes())
                c = np.bincount(inverse, minlength=len(which))
                yield pa.RecordBatch.from_arrays([pa.array(w.some(which), pa.binary()), pa.array(c, pa.int64())], names=["word", "c"])

    return texts.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ending_class(data, starts, ends, shape: Shape):
    """Class by the last three bytes and whether the word is longer."""
    import numpy as np

    from .words import mix

    key = np.minimum(ends - starts, 4).astype(np.uint64)
    for back in (1, 2, 3):
        there = ends - back >= starts
        key = key * np.uint64(257) + np.where(there, data[np.maximum(ends - back, 0)] + np.uint64(1), np.uint64(0)).astype(np.uint64)
    return shape.own + (mix(key) % np.uint64(shape.endings)).astype(np.int64)


class Lexicon:
    """The looked-up words, commonest first: hashes, counts, classes."""

    def __init__(self, words, counts, shape: Shape):
        """words: a binary Arrow array; counts: a numpy array."""
        import numpy as np

        from .words import slices

        self.shape = shape
        h = np.concatenate([w.hashes() for _, _, w in slices(words, fold=True)] or [np.zeros(0, np.uint64)])
        order = np.argsort(h)
        self.hash, self.count, self.rank = h[order], counts[order], order

    def find(self, w, which, h):
        """(class, count or -1 where not looked up) of some words of w."""
        import numpy as np

        cls = _ending_class(w.data, w.starts[which], w.ends[which], self.shape)
        count = np.full(len(which), -1, np.int64)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[at] == h
            count[hit] = self.count[at[hit]]
            own = hit & (self.rank[at] < self.shape.own)
            cls[own] = self.rank[at[own]]
        return cls, count


def encode(docs: DataFrame, lexicon, shape: Shape) -> DataFrame:
    """For each document: its class sequence, sums over looked-up words, and its other words.

    lexicon: a broadcast Lexicon. log_known: log10(c + 1) over looked-up words;
    log_inner: the same over those without a class of their own.
    """
    schema = "row long, doc_id long, held_out boolean, n_tokens long, seq binary, log_known double, log_inner double, n_known long, tail array<binary>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .words import distinct, slices

        lex, row = lexicon.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, w in slices(batch.column(2), fold=True):
                h = w.hashes()
                which, inverse = distinct(h)
                cls, count = lex.find(w, which, h[which])
                docs_n, n = hi - lo, len(w)
                doc = w.doc_of()
                seq = np.full(n + docs_n, shape.classes - 1, np.uint16)
                seq[np.arange(n) + doc] = cls[inverse]
                bounds = 2 * (w.first + np.arange(docs_n + 1))
                logs = np.log10(np.maximum(count, 0) + 1.0)
                inner = np.where(cls >= shape.own, logs, 0.0)
                rare = count < 0
                at = np.flatnonzero(rare[inverse])
                names = np.zeros(len(which), np.int64)
                names[rare] = np.arange(rare.sum())
                words = pa.array(w.some(which[rare]), pa.binary()).take(pa.array(names[inverse[at]]))
                ends = np.searchsorted(at, w.first).astype(np.int32)
                known = np.bincount(doc, weights=(count > 0)[inverse], minlength=docs_n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(docs_n)),
                        batch.column(0).slice(lo, docs_n),
                        batch.column(1).slice(lo, docs_n),
                        pa.array(np.diff(w.first) + 1),
                        pa.Array.from_buffers(pa.binary(), docs_n, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(seq.tobytes())]),
                        pa.array(np.bincount(doc, weights=logs[inverse], minlength=docs_n)),
                        pa.array(np.bincount(doc, weights=inner[inverse], minlength=docs_n)),
                        pa.array(known),
                        pa.ListArray.from_arrays(pa.array(ends), words),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "seq", "log_known", "log_inner", "n_known", "tail"],
                )
                row += docs_n

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    start: object  # states
    move: object  # states x states
    emit: object  # classes x states


def _first_model(class_counts, shape: Shape) -> Model:
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(shape.seed))
    k = shape.states
    emit = (class_counts + 0.5)[:, None] * np.exp(rng.uniform(-1, 1, (shape.classes, k)))
    move = np.full((k, k), (1 - shape.stay) / max(1, k - 1))
    np.fill_diagonal(move, shape.stay if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(0))


def _by_time(column):
    """Sequences of a binary column, longest first: (classes end to end, starts, lengths, order)."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(column.buffers()[2], np.uint16)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    return flat, off[:-1][order], size[order], order


def forward(model: Model, flat, starts, sizes, keep: list | None = None):
    """log10 likelihood of each sequence, given longest first. keep: gets each step's scaled messages and scales."""
    import numpy as np

    total = np.zeros(len(starts))
    active = len(starts) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    ones = np.ones(model.move.shape[0])
    a = None
    for t, n in enumerate(active.tolist()):
        b = model.emit[flat[starts[:n] + t]]
        a = model.start * b if a is None else (a[:n] @ model.move) * b
        s = a @ ones
        a /= s[:, None]
        total[:n] += np.log10(s)
        if keep is not None:
            keep.append((a, s, b))
    return total


def _expect(model: Model, flat, starts, sizes, counts) -> None:
    """Adds the Baum-Welch counts of some sequences to counts (start, move, emit)."""
    import numpy as np

    keep: list = []
    forward(model, flat, starts, sizes, keep)
    k = len(model.start)
    move, where, what = np.zeros((k, k)), [], []
    beta = np.ones((0, k))
    for t in range(len(keep) - 1, -1, -1):
        a, s, b = keep[t]
        n = len(a)
        if len(beta) < n:  # sequences that end here
            beta = np.concatenate((beta, np.ones((n - len(beta), k))))
        what.append(a * beta)
        where.append(flat[starts[:n] + t])
        if t:
            beta = b * beta / s[:, None]
            before = keep[t - 1][0]
            move += before[:n].T @ beta
            beta = beta @ model.move.T
        keep[t] = None if t == 0 else (keep[t][0], None, None)
    gamma, cls = np.concatenate(what), np.concatenate(where)
    counts[0] += what[-1].sum(0)
    counts[1] += move * model.move
    for j in range(k):
        counts[2][:, j] += np.bincount(cls, weights=gamma[:, j], minlength=len(counts[2]))


def baum_welch_round(encoded: DataFrame, model, shape: Shape, tokens_at_once: int = 1_500_000) -> DataFrame:
    """place, value: expected counts summed over all rows; places run over start, move, emit in turn. model: a broadcast Model."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m, k = model.value, shape.states
        counts = [np.zeros(k), np.zeros((k, k)), np.zeros((shape.classes, k))]
        for batch in batches:
            column, lo = batch.column(0), 0
            size = np.cumsum(np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])) // 2
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + tokens_at_once, side="right")))
                flat, starts, sizes, _ = _by_time(column.slice(lo, hi - lo))
                _expect(m, flat, starts, sizes, counts)
                lo = hi
        values = np.concatenate([c.ravel() for c in counts])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at])], names=["place", "value"])

    return encoded.select("seq").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))


def _maximise(rows, class_counts, shape: Shape) -> Model:
    import numpy as np

    k = shape.states
    values = np.zeros(k + k * k + shape.classes * k)
    for place, value in rows:
        values[place] = value
    start, move, emit = values[:k] + 1e-3, values[k : k + k * k].reshape(k, k) + 1e-3, values[k + k * k :].reshape(shape.classes, k)
    common = (class_counts + 0.5) / (class_counts + 0.5).sum()
    emit = emit + shape.smooth * common[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, class_counts, shape: Shape) -> Model:
    """Baum-Welch over all rows not held out. Only states x classes tables reach the driver."""
    sc = encoded.sparkSession.sparkContext
    model = _first_model(class_counts, shape)
    rows = encoded.where(~F.col("held_out"))
    for _ in range(shape.rounds):
        sent = sc.broadcast(model)
        model = _maximise(baum_welch_round(rows, sent, shape).collect(), class_counts, shape)
        sent.destroy()
    return model


def _class_totals(counts: DataFrame, lexicon, shape: Shape):
    """Tokens of each class, and the logarithm of the shares in each class of endings."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .words import slices

        tokens, words = np.zeros(shape.classes, np.int64), np.zeros(shape.classes, np.int64)
        for batch in batches:
            c = batch.column(1).to_numpy()
            for lo, hi, w in slices(batch.column(0), fold=True):
                cls, _ = lexicon.value.find(w, np.arange(len(w)), w.hashes())
                tokens += np.bincount(cls, weights=c[lo:hi], minlength=shape.classes).astype(np.int64)
                words += np.bincount(cls, minlength=shape.classes)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(tokens[at]), pa.array(words[at])], names=["cls", "tokens", "words"])

    found = counts.select("word", "c").mapInArrow(run, "cls long, tokens long, words long").groupBy("cls").agg(F.sum("tokens"), F.sum("words")).collect()
    tokens, shares = np.zeros(shape.classes), np.ones(shape.classes)
    for cls, t, w in found:
        tokens[cls] = t
        shares[cls] = t + w + 1
    shares[: shape.own] = 1.0
    shares[-1] = 1.0
    return tokens, np.log10(shares)


PARTS = 2_048  # of a histogram step that does not fit whole


def commonest(counts: DataFrame, most: int):
    """(words, counts), commonest first, of at most `most` words: all above a count that a histogram of logarithms gives.

    The step of the histogram that no longer fits whole is filled from its
    largest counts on, and the counts where that ends by ranges of the words'
    hashes. Every task sends only words that are in the result, so no more than
    `most` rows reach the driver, as Arrow columns.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    octave = F.floor(F.log2("c") * 16).cast("int")
    sizes = dict(counts.groupBy(octave.alias("o")).count().collect())  # under a thousand rows
    wanted, room, inside = F.lit(False), most, F.lit(True)
    low = F.pow(F.lit(2.0), F.floor(F.log2("c") * 16) / 16)
    part = F.least(F.floor((F.col("c") / low - 1) * PARTS / (2 ** (1 / 16) - 1)), F.lit(PARTS - 1)).cast("int")
    for steps, key in ((sizes, octave), (None, part), (None, F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int"))):
        if steps is None:  # at most PARTS rows, of the step that did not fit
            steps = dict(counts.where(inside).groupBy(key.alias("o")).count().collect())
        cut = None
        for o in sorted(steps, reverse=True):
            if steps[o] > room:
                cut = o
                break
            room -= steps[o]
        if cut is None:
            wanted |= inside
            break
        wanted |= inside & (key > cut)
        inside &= key == cut
    t = counts.where(wanted).select("word", "c").toArrow()
    if not t.num_rows:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    t = t.take(pc.sort_indices(t, [("c", "descending"), ("word", "ascending")])).combine_chunks()
    return t["word"].combine_chunks(), t["c"].to_numpy()


def score(docs: DataFrame, doc_id: Column, text: Column, shape: Shape = Shape()) -> DataFrame:
    """Learns from the rows not held out and scores all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    source = docs.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), text.cast("binary").alias("t"))
    counts = materialise(word_counts(source.where(~F.col("held_out"))), "word-counts")
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = source.where(~F.col("held_out")).count()
    lexicon = sc.broadcast(Lexicon(*commonest(counts, shape.looked_up), shape))
    class_counts, log_shares = _class_totals(counts, lexicon, shape)
    class_counts[-1] = ends
    encoded = materialise(encode(source, lexicon, shape), "encoded")
    model = sc.broadcast((train(encoded, class_counts, shape), log_shares))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m, shares = model.value
        for batch in batches:
            flat, starts, sizes, order = _by_time(batch.column(1))
            ll = np.zeros(len(order))
            if len(order):
                ll[order] = forward(m, flat, starts, sizes)
                off = np.concatenate(([0], np.cumsum(shares[flat])))
                ll[order] -= off[starts + sizes] - off[starts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ll)], names=["row", "latent"])

    latent = encoded.select("row", "seq").mapInArrow(run, "row long, latent double")
    tail = (
        encoded.select("row", F.explode("tail").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("log_tail"), F.count("c").alias("known_tail"))
    )
    tokens, distinct = int(words) + ends, int(types) + (1 if ends else 0)
    joined = encoded.drop("seq", "tail").join(latent, "row").join(tail, "row", "left")
    log_tail = F.coalesce(F.col("log_tail"), F.lit(0.0))
    base = F.col("log_known") + log_tail + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("known_tail"), F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("latent") + F.col("log_inner") + log_tail).alias("score"),
    )
