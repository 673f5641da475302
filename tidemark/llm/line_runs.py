"""Line deduplication over levelled sorted runs of line hashes. Built-in functions only.

A run is a table (k1, k2, docs, owner), bucketed and sorted by the 128-bit line
key (k1, k2). Each batch of documents is aggregated to one row a key; a merge
anti-join against every run tells which keys are new, and only for new keys the
batch names an owner; then the batch adds its own run. When a level holds
`fanout` runs they are merged into one run of the next level. Runs, like the
batches against them, are bucketed alike, so the anti-joins need no shuffle; a
merge deals the keys out once, in buckets of the run that it writes.

Batches arrive in falling doc_id ranges, so a key's owner is the largest doc_id
that holds it.

Defined cases: a null or empty text is one empty line; keys shorter than the
limit are never dropped; rows that repeat a doc_id count as documents each and
share its fate; a null doc_id owns a line only if no other document has it; an
empty table gives no rows; other columns pass through, but for any named n_lines
or n_dropped, which the counts replace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, delete_path, materialise, scratch, shuffle_tasks, shuffles_end_with_the_write

MIN_CHARS, MIN_DOCS = 40, 5
HOT_DOCS = 5_000  # a line in more documents is sent to every task, or salted
HOT_SENT = 100_000  # such lines sent to every task at most
SALTS = 64


def line_key(line: Column) -> Column:
    """A lower-cased line without white space at either end."""
    return F.btrim(line, F.lit(SPACES))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


def keys_of(text: Column, min_chars: int) -> Column:
    """Distinct keys of a text's lines that are long enough."""
    lines = F.split(ascii_lower(text), "\n", -1)
    keys = F.filter(F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), line_key), lambda x: F.length(x) >= min_chars)
    return F.array_distinct(F.transform(keys, _hash))


class LineRuns:
    """The runs of one store, by level."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_tasks(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame, dealt: bool = False) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "line-run")
        rows = rows if dealt else rows.repartition(self.buckets, "k1", "k2")
        with shuffles_end_with_the_write(self.spark):
            (rows.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name))
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose key no run holds."""
        for run in self.tables():
            batch = batch.join(run.select("k1", "k2"), ["k1", "k2"], "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, k1, k2, one row for each document and distinct key."""
        own = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("owner"))
        if any(self.levels):
            held = self._write(own)
            table = self.spark.table(held[0])
            new = self.fresh(table).select("k1", "k2", F.lit(True).alias("is_new"))
            marked = table.join(new, ["k1", "k2"], "left").select("k1", "k2", "docs", F.when(F.col("is_new"), F.col("owner")).alias("owner"))
            run = self._write(marked)
            self._drop([held])
        else:
            run = self._write(own)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self.compact()

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read as plain files: a union of bucketed scans claims to be dealt by key, but its tasks are the runs' tasks one after another
        union = self.spark.read.schema("k1 long, k2 long, docs long, owner long").parquet(*[path for _, path in runs])
        return union.repartition(self.buckets, "k1", "k2").groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def compact(self, least: int | None = None) -> None:
        """Merge every level that is full into one run of the next."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= (least or self.fanout):
                merged = self._write(self._merged(runs), dealt=True)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                self._drop(runs)
            level += 1

    def merged(self) -> DataFrame:
        return self._merged([run for level in self.levels for run in level])

    def drop(self) -> None:
        """Forget all runs and delete their tables."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def frequent_lines(docs: DataFrame, batches: int, min_chars: int, min_docs: int, fanout: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lines: doc_id, k1, k2), (k1, k2, docs, owner of those in at least min_docs documents)."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(cuts or []):
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    path = scratch(spark, "line-keys")
    lines = docs.select("doc_id", F.explode(keys_of(F.col("text"), min_chars)).alias("k")).select("doc_id", "k.k1", "k.k2", batch.alias("batch"))
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, k1 long, k2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches - 1, -1, -1):
        runs.add(lines.where(F.col("batch") == b))
    frequent = materialise(runs.merged().where(F.col("docs") >= min_docs).select("k1", "k2", "docs", "owner"), "frequent-lines")
    runs.drop()
    return lines, frequent


def dedup(docs: DataFrame, batches: int = 3, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines, n_dropped (before: n_lines)."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    lines, frequent = frequent_lines(docs.select("doc_id", "text"), batches, min_chars, min_docs)
    # a hot line is one row of `frequent` and many of `lines`
    hot = frequent.where(F.col("docs") > HOT_DOCS)
    n_hot = hot.count()
    gone = lines.join(frequent.where(F.col("docs") <= HOT_DOCS), ["k1", "k2"])
    if n_hot > HOT_SENT:
        spread = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        gone = gone.unionByName(salted.join(spread, ["k1", "k2", "salt"]).drop("salt"))
    elif n_hot:
        gone = gone.unionByName(lines.join(F.broadcast(hot), ["k1", "k2"]))
    gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    by_doc = gone.groupBy(F.col("doc_id").alias("_ld_id")).agg(F.collect_set(F.struct("k1", "k2")).alias("_ld_gone"))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_ld_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    all_lines = F.split(text, "\n", -1)
    first = F.transform(F.col("_ld_gone"), lambda g: g["k1"])

    def stays(line: Column) -> Column:
        key = _hash(line_key(ascii_lower(line)))
        return ~(F.array_contains(F.col("_ld_k1"), key["k1"]) & F.array_contains(F.col("_ld_gone"), key))

    joined = joined.withColumns({"_ld_k1": first, "n_lines": F.size(all_lines).cast("long")})
    kept = F.when(F.col("_ld_gone").isNotNull(), F.filter(all_lines, lambda x: (F.length(x) < min_chars) | stays(x)))
    out = joined.withColumn("_ld_kept", kept)
    return out.withColumns({"n_dropped": F.when(F.col("_ld_gone").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_ld_kept")).cast("long"), "text": F.when(F.col("_ld_gone").isNull(), text).otherwise(F.array_join("_ld_kept", "\n"))}).drop("_ld_gone", "_ld_k1", "_ld_id", "_ld_kept")
