"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    return score(documents(spark, sf_dir), F.col("doc_id"), F.col("text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("h")


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_quality import judge

    judged = judge(documents(spark, sf_dir), F.col("source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import dedup

    return dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), "tidemark-example-key").where(F.size("found") > 0)
    return out.select("doc_id", F.size("found").cast("long").alias("n_values"), F.transform("found", lambda x: x["kind"]).alias("kinds"), F.transform("found", lambda x: x["new"]).alias("pseudonyms"), F.sha2("text", 256).alias("text_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_hist import encoded_lengths, histogram
    from .tokens import default_vocabulary

    return histogram(encoded_lengths(documents(spark, sf_dir), default_vocabulary()))


def op9_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import default_vocabulary

    pieces = pack(documents(spark, sf_dir), default_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum import link

    return link(documents(spark, sf_dir), F.col("doc_id"), F.col("text")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
