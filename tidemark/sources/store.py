"""Parquet tables, content-addressed datasets and scratch space on shared storage.

A dataset is an immutable folder named by its content: data, and a JSON
manifest beside it. Writing the same content again does nothing.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StoreError(ValueError):
    """A dataset is missing, ambiguous or not what its manifest says."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors cannot read a folder of the driver's own")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: its cluster owns the folder
            pass

    atexit.register(drop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet scan with a declared schema; columns and filters are pushed into it."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_sorted(df: DataFrame, path: str, sort_key: list[str], partition_year: str | None = None) -> None:
    """Rows in key order within range partitions, by year of a date if asked."""
    out = df.withColumn("year", F.year(partition_year)) if partition_year else df
    out = out.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key)
    writer = out.write.mode("errorifexists")
    (writer.partitionBy("year") if partition_year else writer).parquet(path)


def canonical_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object a row, keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias(out))


def content_id(df: DataFrame, extra: dict | None = None, prefix: str = "ds") -> str:
    """An order-free content name: row count, sum and xor of row digests, and what else identifies it.

    Not the hash of the sorted rows: that needs a total sort on one task.
    """
    import hashlib

    a, b = F.xxhash64(*sorted(df.columns)), F.xxhash64(F.lit(1), *[F.col(c) for c in sorted(df.columns)])
    row = df.agg(F.count(F.lit(1)), F.sum(a.cast("decimal(38,0)")), F.bit_xor(a), F.sum(b.cast("decimal(38,0)")), F.bit_xor(b)).first()
    body = json.dumps([[str(x) for x in row], sorted(df.dtypes), extra or {}], sort_keys=True)
    return f"{prefix}-{hashlib.sha256(body.encode()).hexdigest()[:16]}"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def write_dataset(df: DataFrame, root: str, table: str, knowledge: str | None = None, extra: dict | None = None) -> str:
    """Writes a dataset under its content id and returns the id; the same content is a no-op."""
    spark = df.sparkSession
    name = content_id(df, {"table": table} | (extra or {}))
    path = f"{root}/{table}/{name}"
    if exists(spark, f"{path}/manifest.json"):
        return name
    df.write.mode("overwrite").parquet(f"{path}/data")
    stats = df.agg(F.count(F.lit(1)).alias("n"), (F.max(knowledge) if knowledge else F.lit(None)).cast("string").alias("k")).first()
    manifest = {"id": name, "table": table, "row_count": stats["n"], "max_knowledge_time": stats["k"], "extra": extra or {}}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return name


def resolve(spark: SparkSession, root: str, table: str, dataset: str | None = None) -> str:
    """Exactly one dataset, or an error: never simply the latest."""
    found = [c for c in children(spark, f"{root}/{table}") if dataset in (None, c)]
    if len(found) != 1:
        raise StoreError(f"{table}: {'no dataset' if not found else f'{len(found)} datasets, name one'}")
    return found[0]


def verify(spark: SparkSession, root: str, table: str, dataset: str) -> list[str]:
    """Differences between a dataset and its manifest."""
    path = f"{root}/{table}/{dataset}"
    manifest = json.loads(_read_text(spark, f"{path}/manifest.json"))
    df = spark.read.parquet(f"{path}/data")
    problems = []
    if manifest["id"] != dataset:
        problems.append("the manifest names another dataset")
    if (n := df.count()) != manifest["row_count"]:
        problems.append(f"{n} rows, {manifest['row_count']} recorded")
    if content_id(df, {"table": table} | manifest["extra"]) != dataset:
        problems.append("the content differs from its id")
    return problems


def read_dataset(spark: SparkSession, root: str, table: str, dataset: str | None = None, check: bool = True) -> DataFrame:
    name = resolve(spark, root, table, dataset)
    if check and (problems := verify(spark, root, table, name)):
        raise StoreError(f"{table}/{name}: " + "; ".join(problems))
    return spark.read.parquet(f"{root}/{table}/{name}/data")


def knowledge_contract(df: DataFrame, point_in_time: bool, knowledge: str, event: str) -> DataFrame:
    """Rows against the contract: a family with history stamps every row at or after its event, others none."""
    k = F.col(knowledge)
    return df.where(k.isNull() | (F.to_date(k) < F.to_date(event)) if point_in_time else k.isNotNull())
