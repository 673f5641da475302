"""Benchmark decontamination by containment search. Built-in functions only.

Items are partitioned by their number of distinct five-word shingles. A
partition's MinHash sketch of an item is its m lowest shingle hashes, m being one
more than the shingles that the partition's largest item may lack; so an item
contained in a document shares a sketch hash with it for certain, and the
number it must share follows from its size. A document is searched only in
partitions whose smallest items it is long enough to contain. Documents, however
long, are streamed against the sketches; candidates are verified by exact
containment of all shingles.

Words are runs of other than ASCII white space, A-Z lower-cased.

Defined cases: null texts and texts under five words have no shingles and
match nothing; repeated items count once; a document is its id and text, so
rows that share an id, or have none, are matched each by its own text, and rows
that repeat both count once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

PERCENT = 80
BROADCAST_ROWS = 500_000  # sketch or shingle rows sent to every task at most; beyond, Spark joins by shuffle


def once(value: Column, then) -> Column:
    """then(value), with value evaluated once a row however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def shingles(text: Column, k: int = 5) -> Column:
    """Hashes of a text's k-word shingles, in order; null if it has fewer words."""
    words = F.filter(F.split(ascii_lower(text), "[ \\t-\\r]+", -1), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return once(words, lambda w: F.when(F.size(w) >= k, runs(w)))


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, shingles(F.col(text)))


def _name(item: str) -> Column:
    """An item's id as text, for sets, which drop nulls."""
    return F.coalesce(F.col(item).cast("string"), F.lit("none"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, s (distinct shingle hashes), q, missing (how many may lack), partition, least (shingles of a document that can hold an item of the partition), sketch, need."""
    t = with_shingles(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "text", "s").where("s is not null")
    t = t.withColumn("s", F.array_sort(F.array_distinct("s"))).withColumn("q", F.size("s"))
    t = t.withColumn("missing", F.floor(F.col("q") * (100 - percent) / 100).cast("int"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("q") + 1))) - 1  # partitions 1, 2-3, 4-7, 8-15, ...
    m = F.floor(upper * (100 - percent) / 100).cast("int") + 1
    low = F.floor((F.col("partition") + 1) / 2)
    t = t.withColumn("partition", upper.cast("int")).withColumn("least", (low - F.floor(low * (100 - percent) / 100)).cast("int")).withColumn("sketch", F.slice("s", F.lit(1), F.least(m, F.col("q"))))
    return t.withColumn("need", F.size("sketch") - F.col("missing"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (xxhash64 of the text), item_id, item_shingles, shared: pairs with at least percent of the item's shingles in the document."""
    table = materialise(item_table(items, percent), "items")
    n_sketch, n_all = table.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))).first()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sketch = table.select("item_id", "need", "least", F.explode("sketch").alias("g"))
    words = with_shingles(source, "text", "s").select("doc_id", "h", F.size("s").alias("n_s"), F.explode("s").alias("g"))
    hits = words.join(_sent(sketch, n_sketch), "g").where(F.col("n_s") >= F.col("least")).groupBy("doc_id", "h", "item_id", "need").agg(F.count_distinct("g").alias("n"))
    candidates = materialise(hits.where(F.col("n") >= F.col("need")).select("doc_id", "h", "item_id"), "candidates")
    wanted = candidates.groupBy(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h")).agg(F.collect_set(_name("item_id")).alias("wanted"))
    again = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")))
    again = with_shingles(again, "text", "s").select("doc_id", "h", "wanted", F.explode("s").alias("g"))
    full = table.select("item_id", "q", F.explode("s").alias("g"))
    shared = again.join(_sent(full, n_all), "g").where(F.array_contains("wanted", _name("item_id"))).groupBy("doc_id", "h", "item_id", "q").agg(F.count_distinct("g").alias("shared"))
    return shared.where(100 * F.col("shared") >= percent * F.col("q")).select("doc_id", "h", "item_id", F.col("q").cast("long").alias("item_shingles"), "shared")
