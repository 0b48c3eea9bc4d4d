"""Streaming twins of the log roll-ups; each takes a streaming or a batch frame of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gantry.session import shared_folder

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Events and sum of values per window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first delivery of each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def answered(events: DataFrame, ask: str, answer: str, late: str = "1 hour", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """user_id, asked, answered: pairs an event of one type with the user's next one of another, by state per user.

    A question that nobody answers within keep_ms of event time leaves the state with the watermark.
    """

    def pair(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["user_id", "asked", "answered"])
            return
        waiting = state.get[0] if state.exists else -1
        rows, newest = [], 0
        everything = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in everything.itertuples():
            newest = max(newest, int(r.ts.timestamp() * 1000))
            if r.event_type == ask:
                waiting = r.event_id
            elif r.event_type == answer and waiting >= 0:
                rows.append((key[0], waiting, r.event_id))
                waiting = -1
        if waiting < 0:
            if state.exists:
                state.remove()
        else:
            state.update((int(waiting),))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(rows, columns=["user_id", "asked", "answered"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(pair, "user_id bigint, asked bigint, answered bigint", "waiting bigint", "append", GroupStateTimeout.EventTimeTimeout)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream of Parquet files."""
    return spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all its input, trigger by trigger, and gives what it wrote.

    Each batch goes to a folder of its own under the shared folder (the whole result replaces the last
    one in complete mode), so a repeated batch replaces itself and nothing passes through the driver.
    """
    base = f"{shared_folder(stream.sparkSession).rstrip('/')}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
