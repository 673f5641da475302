"""Structured Streaming forms of the batch operators.

Each stream gives, on the same input, what its batch operator gives. State is
keyed and bounded: a fact's latest vintage, or a watermark's windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by event type in windows of event time; rows later than the watermark are left out."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    w = stamped.withWatermark("at", late).groupBy(F.window("at", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Each user's sessions: bursts with no gap longer than `gap`."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    s = stamped.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "n")


VINTAGE = "user_id long, event_type string, ts timestamp_ntz, event_id long, level long, vintage_seq long"


def vintages(levels: DataFrame) -> DataFrame:
    """New vintages of each (user_id, event_type) as they arrive: rows that differ from the last one in force.

    levels: user_id, event_type, ts, event_id, level. The state of a key is its
    last level and sequence. Rows of one trigger are taken in time order.
    """

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        last, seq = (state.get[0], state.get[1]) if state.exists else (None, -1)
        started, out = state.exists, []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for r in rows.itertuples(index=False):
            if not started or r.level != last:
                seq, last, started = seq + 1, int(r.level), True
                out.append((key[0], key[1], r.ts, r.event_id, r.level, seq))
        state.update((last, seq))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "ts", "event_id", "level", "vintage_seq"])

    return levels.groupBy("user_id", "event_type").applyInPandasWithState(run, VINTAGE, "last long, seq long", "append", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, batch by batch into the shared folder, and reads the result."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        sink = lambda df, k: df.write.mode("overwrite").parquet(f"{root}/data")
    else:
        sink = lambda df, k: df.write.mode("overwrite").parquet(f"{root}/data/batch={k}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{root}/data")
    return out.drop("batch") if "batch" in out.columns else out
