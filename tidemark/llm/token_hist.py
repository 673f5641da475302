"""Exact histogram of encoded lengths with suffix sums.

Documents are counted by encoded length; suffix sums over the histogram answer,
for every context limit, how many documents and tokens lie above it, what
truncation keeps, and any quantile. Sums run within blocks of lengths and over
block totals, so no single task orders the whole histogram.

Defined cases: null or empty text has length 0 (plus the end id if one is
counted); repeated rows count each; an empty table gives an empty histogram;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str, extra: int = 1) -> DataFrame:
    """Counts of encoded lengths for each task; extra ids a document (its end id) are added."""
    import numpy as np

    from .tokens import encoder
    from .words import slices

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        enc, found = encoder(vocabulary), Counter()
        for batch in batches:
            for _, _, words in slices(batch.column(0)):
                found.update((np.diff(enc.encode_all(words)[1]) + extra).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["tokens", "docs"])

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "tokens long, docs long")


def histogram(lengths: DataFrame) -> DataFrame:
    """tokens, docs, then the suffix sums from that length on.

    docs_from, tokens_from: documents of at least that length and their tokens.
    truncated_total: tokens kept if every document is cut at that length.
    total_docs, total_tokens: of the whole table.
    """
    # written, since two branches read it: else every text would be encoded twice
    h = materialise(lengths.groupBy("tokens").agg(F.sum("docs").alias("docs")), "histogram").withColumn("block", F.floor(F.col("tokens") / BLOCK))
    mass = F.col("docs") * F.col("tokens")
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(mass).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "block").select("tokens", "docs", (F.sum("docs").over(inside) + F.col("d_after")).alias("docs_from"), (F.sum(mass).over(inside) + F.col("t_after")).alias("tokens_from"), "total_docs", "total_tokens")
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """One row for each context limit: documents above it, tokens kept and lost by truncation, share kept."""
    spark = hist.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the suffix from the first length above a limit holds what that limit cuts
    above = hist.join(F.broadcast(asked), F.col("tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_from").alias("docs_above"), F.max("tokens_from").alias("tokens_above"))
    totals = hist.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    out = asked.join(above, "context_limit", "left").crossJoin(F.broadcast(totals)).fillna(0)
    kept = F.col("total_tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("context_limit")
    return out.select("context_limit", "total_docs", "total_tokens", "docs_above", kept.alias("kept_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length with at least a share q of documents at or below it."""
    at_or_below = F.col("total_docs") - F.col("docs_from") + F.col("docs")
    return hist.where(at_or_below >= F.ceil(F.lit(float(q)) * F.col("total_docs"))).agg(F.min("tokens").alias("tokens"))
