"""Change-data capture: rows, validation with dead letters, batches and event-time windows; batch and streaming alike.

Micro-batching, back-pressure, recovery and ordering are Structured Streaming's own: triggers, source
options, checkpoints, and deduplication within a watermark.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Kinds of events.
KINDS = ["OBJECT_CREATED", "OBJECT_DELETED", "REF_UPDATED", "COMMIT_CREATED", "PACK_RECEIVED", "BRANCH_CREATED", "BRANCH_DELETED", "TAG_CREATED", "TAG_DELETED", "MERGE_COMPLETED"]


def valid() -> Column:
    """An id, a known kind, a time from 1970 on, and a sequence from 0 on."""
    ok = (F.col("event_id") != "") & F.col("event_type").isin(KINDS) & (F.col("ts") >= F.lit("1970-01-01").cast("timestamp")) & (F.col("sequence") >= 0)
    return F.coalesce(ok, F.lit(False))


def rows(events: DataFrame) -> DataFrame:
    """The lake's change table; the payload's k as a column of its own."""
    return events.select("event_id", "event_type", "source", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "sequence", "payload", F.get_json_object("payload", "$.k").cast("int").alias("k"))


def batches(events: DataFrame, size: int) -> DataFrame:
    """Statistics of runs of size events by sequence."""
    return events.groupBy(F.floor(F.col("sequence") / size).alias("batch")).agg(
        F.count("*").alias("events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("first_ms"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms")
    )


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of kinds by event-time window; later than the watermark is dropped from a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a gap without events."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), "events")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def pipeline(stream: DataFrame, table: str, dead_letters: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, retries: int = 3, first_wait: float = 0.1, most_wait: float = 5.0) -> StreamingQuery:
    """Writes valid events to table and others to dead_letters; available data are taken, then the query ends.

    Each batch has a folder of its own that a repeated batch overwrites, so every event is written once.  A
    batch that fails is tried again after first_wait seconds, twice as long each time up to most_wait; after
    retries times it is written to dead_letters whole, with the error."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            good = df.where(valid())
            df.where(~valid()).withColumn("error", F.lit("VALIDATION_ERROR")).write.mode("overwrite").parquet(f"{dead_letters}/batch={batch}")
            for attempt in range(retries):
                try:
                    rows(good).write.mode("overwrite").parquet(f"{table}/batch={batch}")
                    if on_batch:
                        on_batch(good, batch)
                    return
                except Exception as e:
                    if attempt == retries - 1:
                        good.withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{dead_letters}/failed/batch={batch}")
                    else:
                        time.sleep(min(most_wait, first_wait * 2**attempt))
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(events: DataFrame, size: int) -> DataFrame:
    """One row: batches of size events by sequence, their events, payload bytes and invalid kinds, and the largest batch."""
    batch = events.groupBy(F.floor(F.col("sequence") / size).alias("batch")).agg(F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("b"), F.count_if(~F.coalesce(F.col("event_type").isin(KINDS), F.lit(False))).alias("e"))
    return batch.agg(F.count("*").alias("batches"), F.sum("n").alias("events"), F.sum("b").alias("bytes"), F.sum("e").alias("errors"), F.max("n").alias("largest"))


WEBHOOK = "ref string, before string, after string, commits array<struct<id:string,message:string>>, repository struct<full_name:string>, ref_type string, master_branch string, zen string, hook_id long"


def webhook_rows(rows: DataFrame, json: str) -> DataFrame:
    """(name, kind, ref, commits) of rows(name, json): push, create, delete or ping by the shape of the payload; null for others."""
    p = F.from_json(json, WEBHOOK)
    rows = rows.select("name", p.alias("p"))
    has = lambda c: F.col(f"p.{c}").isNotNull()
    kind = F.when(has("ref") & has("commits"), "push").when(has("ref_type") & has("master_branch"), "create").when(has("ref_type") & has("ref"), "delete").when(has("zen") & has("hook_id"), "ping")
    return rows.select("name", kind.alias("kind"), F.col("p.ref").alias("ref"), F.when(has("commits"), F.size("p.commits")).otherwise(0).alias("commits"))


def export_stream(stream: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends a stream's rows, transformed, to a table of Parquet files; available data are taken, then the query ends.  The checkpoint makes every row come once."""
    rows = transform(stream) if transform else stream
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
