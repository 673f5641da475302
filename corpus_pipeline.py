"""A corpus pipeline of five stages, each over all that the one before kept.

Quality rules, line deduplication, near-duplicate removal, benchmark
decontamination, packing. Every stage's result is written as Parquet and read
again as the next one's documents; all but the last keep the columns of
documents.

A row is known by its doc_id, its text and, in the first stage, its source, so
stages decide on rows that share a doc_id, or have none, each by itself.

Defined cases: null texts have no words, so the quality stage rejects them;
empty tables pass every stage as empty tables; rows that repeat doc_id and text
share a verdict in every stage, and the n-gram stage keeps one of them; texts
without words are in no group there, so none goes; further columns, whatever
their names, pass through all stages but the last. A stage whose column of the
same name is its own (`n_lines`, `n_dropped` of the line stage) gives back the
table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, host_quality, line_runs, packing, partenum
from tidemark.llm.common import materialise
from tidemark.llm.tokens import default_vocabulary


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _only(docs: DataFrame, keep: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs that keep names by doc_id, text hash h and, if it has one, host (left_anti: the others)."""
    keep = keep.toDF(*[f"_cp_{c}" for c in keep.columns]).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_cp_doc_id")) & (_text_hash() == F.col("_cp_h"))
    if "_cp_host" in keep.columns:
        same &= F.col("source").eqNullSafe(F.col("_cp_host"))
    return docs.join(keep, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    judged = host_quality.judge(docs.withColumn("text", F.coalesce("text", F.lit(""))), F.col("source"))
    return _only(docs, judged.where("kept").select("doc_id", "h", "host"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; n_chars follows the text."""
    own = {c: f"_cp_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_runs.dedup(docs.withColumnsRenamed(own))
    out = out.drop("n_lines", "n_dropped").withColumnsRenamed({new: c for c, new in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingle similarity, that with the smallest doc_id; of equal ones any."""
    linked = materialise(partenum.link(docs, F.col("doc_id"), F.col("text")), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    chosen = linked.where("g1 is not null").groupBy("g1", "g2").agg(first).select("first.doc_id", "first.h")
    wordless = linked.where("g1 is null").select("doc_id", "h")
    times = linked.where("g1 is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    repeated = materialise(chosen.join(times.toDF("r_id", "r_h"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left_semi"), "repeated")
    kept = _only(docs, chosen.unionByName(wordless))
    if not repeated.take(1):
        return kept
    # rows that repeat both doc_id and text: one of each
    one = _only(kept, repeated).withColumn("_cp_h", _text_hash()).dropDuplicates(["doc_id", "_cp_h"]).drop("_cp_h")
    return _only(kept, repeated, "left_anti").unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    hits = decontam.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, hits.select("doc_id", "h"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the packing tiers."""
    pieces = packing.pack(docs, default_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: The last stage needs a tokenizer, which SQL has not; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
