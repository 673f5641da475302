"""Host-level quality rules.

Each document is measured and held to rules. Failures are summed by host, and
each host's failure rate is shrunk towards the corpus by a beta prior whose
mean and strength come from the hosts themselves (method of moments). The
shrunk rate gives the host a verdict, which is joined back to its documents:
a blocked host loses all of them, a suspect host has its documents held to
tighter limits, a trusted one to looser limits.

The host totals are aggregated map-side; the join back salts the host key, so
a host with a third of all rows spreads over many tasks.

Defined cases: a null text has no words and fails the length rule; a null host
is a host of its own; equal rows count each; an empty table gives no rows;
columns of the input other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The symbols that the contract counts.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = "doc_id long, host string, h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Limits:
    """Rules on a document and on a host. Shares are of words, characters or lines."""

    min_words: int = 20
    max_repeat_percent: int = 30
    symbol_share: float = 0.10
    dup_line_share: float = 0.30
    suspect_factor: float = 0.5  # a suspect host's limits are this times the above, a trusted host's this less often
    suspect_rate: float = 0.25
    blocked_rate: float = 0.60
    min_strength: float = 10.0  # the prior weighs at least this many documents
    salts: int = 32


def measures(docs: DataFrame, host: Column) -> DataFrame:
    """One row for each document: the counts that the rules need, and h, a hash of its text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .words import slices, windows

        symbol = np.zeros(256, np.int64)
        symbol[list(SYMBOLS)] = 1
        inner = np.zeros(256, np.int64)
        inner[128:192] = 1  # bytes within a code point
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for _, _, w in slices(batch.column(3)):
                b, first, h = w.bounds, w.first, w.hashes()
                n = np.diff(first)
                # code points in words: bytes in words, less bytes within a code point
                chars = np.concatenate(([0], np.cumsum(w.ends - w.starts)))[first]
                part = np.concatenate(([0], np.cumsum(inner[w.data])))
                marks = np.concatenate(([0], np.cumsum(symbol[w.data])))
                repeat = _repeats(h, first, windows)
                dup, lines = _dup_lines(w, h)
                out[0].append(n)
                out[1].append(np.diff(chars) - np.diff(part[b]))
                out[2].append(np.diff(marks[b]))
                out[3].append(dup)
                out[4].append(repeat)
                out[5].append(lines)
            counts = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *counts], names=[f.split(" ")[0] for f in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t")).mapInArrow(run, MEASURES)


def _repeats(h, first, windows):
    """Words of each document inside windows that it holds twice or more."""
    import numpy as np

    from .words import mix

    n, docs = len(h), len(first) - 1
    out = np.zeros(docs, np.int64)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(docs), np.diff(first))
    runs = windows(h, WINDOW)
    whole = doc[WINDOW - 1 :] == doc[: n - WINDOW + 1]  # windows within one document
    at = np.flatnonzero(whole)
    keys = mix(runs[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys_sorted = np.sort(keys)
    twice = np.unique(keys_sorted[1:][keys_sorted[1:] == keys_sorted[:-1]])
    if not len(twice):
        return out
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = at[twice[place] == keys]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=docs).astype(np.int64)


def _dup_lines(w, h):
    """Lines with a word that equal an earlier line of their document, and lines with a word.

    Lines are compared as they stand, white space included.
    """
    import numpy as np

    from .words import _powers, _state, mix

    data, b = w.data, w.bounds
    docs = len(b) - 1
    stops = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((b[:-1], stops + 1)))
    # a line ends at the newline or at its document's end
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    ends = np.concatenate((starts[1:], [len(data)]))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    held = _state()
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(held["values"][data] * up[: len(data)], out=sums[1:])
    key = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(b, starts, side="right") - 1
    words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    key, doc = key[words > 0], doc[words > 0]
    both = mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(both)
    again = np.zeros(len(order), bool)
    again[1:] = order[1:] == order[:-1]
    # copies beyond the first, counted by document through any member of the group
    lines = np.bincount(doc, minlength=docs)
    if not again.any():
        return np.zeros(docs, np.int64), lines.astype(np.int64)
    values, times = np.unique(order[again], return_counts=True)
    by = np.argsort(both, kind="stable")
    member = by[np.searchsorted(both[by], values)]
    return np.bincount(doc[member], weights=times, minlength=docs).astype(np.int64), lines.astype(np.int64)


def rule_flags(m: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """base_failed and the two soft rules at their plain limits."""
    base = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    symbol = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    soft = (symbol > limits.symbol_share) | (dup > limits.dup_line_share)
    return m.withColumns({"base_failed": base, "symbol_share": symbol, "dup_share": dup}).withColumn("failed", F.col("base_failed") | soft)


def host_verdicts(flagged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, docs, failures, prior_alpha, prior_beta, shrunk_rate, verdict.

    Method of moments over hosts, weighted by documents: the prior's strength is
    p(1-p)/v - 1, v being the spread of host rates beyond what sampling explains.
    """
    hosts = flagged.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    p = (F.sum("failures") / F.sum("docs")).alias("p")
    spread = hosts.crossJoin(F.broadcast(hosts.agg(p, F.count(F.lit(1)).alias("hosts")))).agg(
        F.max("p").alias("p"),
        F.max("hosts").alias("hosts"),
        F.sum("docs").alias("n"),
        F.sum(F.col("docs") * F.pow(F.col("failures") / F.col("docs") - F.col("p"), 2)).alias("ss"),
    )
    v = (F.col("ss") / F.col("n")) - F.col("p") * (1 - F.col("p")) * F.col("hosts") / F.col("n")
    bounded = F.col("p") * (1 - F.col("p"))
    strength = F.when((v > 0) & (bounded > 0), F.greatest(bounded / v - 1, F.lit(limits.min_strength))).otherwise(F.lit(1e6))
    prior = spread.select((F.col("p") * strength).alias("prior_alpha"), ((1 - F.col("p")) * strength).alias("prior_beta"))
    rate = (F.col("failures") + F.col("prior_alpha")) / (F.col("docs") + F.col("prior_alpha") + F.col("prior_beta"))
    mean = F.col("prior_alpha") / (F.col("prior_alpha") + F.col("prior_beta"))
    verdict = (
        F.when(F.col("shrunk_rate") >= limits.blocked_rate, "blocked")
        .when(F.col("shrunk_rate") >= F.greatest(F.lit(limits.suspect_rate), mean), "suspect")
        .when(F.col("shrunk_rate") <= mean, "trusted")
        .otherwise("plain")
    )
    return hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", rate).withColumn("verdict", verdict)


def judge(docs: DataFrame, host: Column, limits: Limits = Limits()) -> DataFrame:
    """Measures, base_failed, the host's shrunk rate and verdict, and kept for each document."""
    # counts only, no texts: read twice, for the host totals and for the join back
    flagged = materialise(rule_flags(measures(docs, host), limits), "measures")
    hosts = host_verdicts(flagged, limits).select(F.col("host").alias("h_host"), "shrunk_rate", "verdict")
    # every task sees each host once in each salt: the host table is small against the documents
    spread = hosts.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(limits.salts - 1))))
    left = flagged.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(limits.salts)).cast("int"))
    joined = left.join(spread, (F.col("salt") == F.col("h_salt")) & F.col("host").eqNullSafe(F.col("h_host")), "left")
    scale = F.when(F.col("verdict") == "suspect", limits.suspect_factor).when(F.col("verdict") == "trusted", 1 / (1 - limits.suspect_factor / 2)).otherwise(1.0)
    soft = (F.col("symbol_share") > limits.symbol_share * scale) | (F.col("dup_share") > limits.dup_line_share * scale)
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & ~soft
    return joined.withColumn("kept", kept).drop("h_host", "h_salt", "salt")
