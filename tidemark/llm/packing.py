"""Hierarchical multi-length packing.

Each document becomes ids plus an end id. Whole top windows are cut from long
documents first; what remains is routed to the smallest tier (a power of two)
that holds it. A tier's sequence starts with one of its own pieces, its gap is
filled with the largest whole pieces of the shorter tiers that fit, and the
last of the gap with a cut of one more, whose rest is routed again. So every
sequence has exactly its tier's length. At a partition's end what is left goes
into top windows and then into falling powers of two. Sequences are dealt into
step groups of equal token totals.

Defined cases: null or empty text is the end id alone; a null doc_id keeps its
pieces under a null id; repeated rows are packed each on its own; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 65_536
WAITING = 48  # pieces a tier holds back as filler before it packs a sequence of its own
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class _Packer:
    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, task << 36
        self.waiting: dict[int, list[tuple]] = {t: [] for t in tiers}  # sorted by length
        self.sequences = self.tokens = 0
        self.rows: list[tuple] = []

    def route(self, piece: tuple) -> None:
        from bisect import insort

        tier = next(t for t in self.tiers if piece[0] <= t)
        insort(self.waiting[tier], piece, key=lambda p: p[0])

    def emit(self, pieces: list[tuple], tier: int) -> None:
        """pieces: (length, doc_id, start, ids, doc_tokens)."""
        sequence, offset = self.base + self.sequences, 0
        group = self.base + self.tokens // self.step_tokens
        for length, doc, start, ids, total in pieces:
            self.rows.append((doc, start, length, ids, total, sequence, offset, tier, group))
            offset += length
        self.sequences += 1
        self.tokens += offset

    def take(self, gap: int, below: int) -> tuple | None:
        """The largest waiting piece that fits the gap, of tiers up to `below`."""
        from bisect import bisect_right

        for t in reversed([t for t in self.tiers if t <= below]):
            if k := bisect_right(self.waiting[t], gap, key=lambda p: p[0]):
                return self.waiting[t].pop(k - 1)
        return None

    def cut(self, gap: int, below: int) -> tuple | None:
        """The first `gap` ids of the shortest waiting piece longer than that; the rest is routed again."""
        for t in (t for t in self.tiers if t <= below):
            for k, (length, doc, start, ids, total) in enumerate(self.waiting[t]):
                if length > gap:
                    del self.waiting[t][k]
                    self.route((length - gap, doc, start + gap, ids[4 * gap :], total))
                    return gap, doc, start, ids[: 4 * gap], total
        return None

    def pack(self, tier: int) -> bool:
        """Whether a sequence came of it: all that waits can be shorter than one."""
        pieces = [self.waiting[tier].pop()]
        gap = tier - pieces[0][0]
        while gap:
            piece = self.take(gap, tier) or self.cut(gap, self.tiers[-1])
            if piece is None:  # nothing else waits: back into the pool
                for p in pieces:
                    self.route(p)
                return False
            pieces.append(piece)
            gap -= piece[0]
        self.emit(pieces, tier)
        return True

    def add(self, doc, ids: bytes) -> None:
        top, total = self.tiers[-1], len(ids) // 4
        start = 0
        while total - start >= top:
            self.emit([(top, doc, start, ids[4 * start : 4 * (start + top)], total)], top)
            start += top
        if start < total:
            self.route((total - start, doc, start, ids[4 * start :], total))
        for t in self.tiers:
            while len(self.waiting[t]) > WAITING and self.pack(t):
                pass

    def finish(self) -> None:
        left = [p for t in reversed(self.tiers) for p in reversed(self.waiting[t])]
        n = sum(p[0] for p in left)
        tier = self.tiers[-1]
        while n:
            while tier > n:
                tier //= 2
            pieces, gap = [], tier
            while gap:
                length, doc, start, ids, total = left.pop()
                used = min(length, gap)
                pieces.append((used, doc, start, ids[: 4 * used], total))
                gap -= used
                if used < length:
                    left.append((length - used, doc, start + used, ids[4 * used :], total))
            self.emit(pieces, tier)
            n -= tier

    def drain(self):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5)
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
        columns = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece, with its ids. No shuffle: every task packs its own documents."""
    from .tokens import encoder
    from .words import slices

    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        end = int(end_id).to_bytes(4, "little")
        packer, enc = _Packer(TaskContext.get().partitionId(), tiers, step_tokens), encoder(vocabulary)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, words in slices(batch.column(1)):
                ids, bounds = enc.encode_all(words)
                raw, at = ids.tobytes(), (4 * bounds).tolist()
                for doc, a, b in zip(keys[lo:hi], at, at[1:]):
                    packer.add(doc, raw[a:b] + end)
                if packer.rows:
                    yield packer.drain()
        packer.finish()
        if packer.rows:
            yield packer.drain()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, SCHEMA)
