"""Structured Streaming over events: windowed counts with a watermark, and per-case prefixes in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tracequarry.model import EventLog, from_positions


def event_stream(spark: SparkSession, folder: str, file: str, schema: StructType) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def replay(log: EventLog, folder: str) -> None:
    """A log's events as files that a stream can read in order of time."""
    log.events.select("log", "case_id", "pos", "activity", "ts").repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(folder)


def windowed_counts(events: DataFrame, by: str, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(window_start, window_end, by, n): tumbling windows, or sliding ones with ``slide``; events later than ``late`` are dropped."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(frame.alias("w"), by).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def sessions(events: DataFrame, by: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(session_start, session_end, by, n): sessions that end after a gap without events."""
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def decayed_sums(events: DataFrame, by: str, scale: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, by, n, total, last_ts): per window of the length ``scale``, the weights exp((ts - window_start) / scale) summed, for decayed()."""
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    frame = F.window("ts", scale)
    weight = F.exp((F.unix_micros("ts") - F.unix_micros(frame["start"])) / (F.unix_micros(frame["end"]) - F.unix_micros(frame["start"])))
    rows = got.groupBy(frame.alias("w"), by).agg(F.count("*").alias("n"), F.sum(weight).alias("total"), F.max("ts").alias("last_ts"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total", "last_ts")


def decayed(sums: DataFrame, by: str) -> DataFrame:
    """(by, n, weight): events with weights that decay by e for each ``scale`` before the last event of all, from what decayed_sums() has kept.

    The kept sums are relative to their window, so that none overflows however long the stream runs.
    """
    end = sums.agg(F.max("last_ts").alias("end"))
    rows = sums.join(F.broadcast(end), how="left")  # one row
    scale = F.unix_micros("window_end") - F.unix_micros("window_start")
    return rows.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.col("total") * F.exp((F.unix_micros("window_start") - F.unix_micros("end")) / scale)).alias("weight"))


def case_prefixes(events: DataFrame, late: str = "1 day", idle_hours: int = 48, buckets: int = 2048) -> DataFrame:
    """(case_id, n_events, prefix) after each batch that has events of a case (case_id, event_id, activity, ts): its length and activities so far.

    A batch's events of a case are ordered by time and id. A case is forgotten when the watermark has passed its
    last event by ``idle_hours``. Cases share ``buckets`` rows of the state store, by hash: a call of Python costs
    milliseconds, and there is one per bucket, not per case. A bucket's row is written anew when a batch has events of it.
    Their number can't change while a checkpoint is used.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {case: rest for case, *rest in zip(*state.get, strict=True)} if state.exists else {}
        now, seen = state.getCurrentWatermarkMs(), {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
            for case, activity, us in zip(rows["case_id"].tolist(), rows["activity"].tolist(), rows["us"].fillna(0).tolist(), strict=True):
                activities, last = seen.get(case, ([], 0))
                activities.append(activity)
                seen[case] = activities, max(last, us)
        for case, (activities, us) in seen.items():
            n, prefix, until = held.get(case, (0, "", 0))
            held[case] = n + len(activities), ">".join(([prefix] if n else []) + activities), max(until, int(us) // 1000 + idle_hours * 3_600_000, now + 1)
        live = [(case, *rest) for case, rest in held.items() if rest[2] >= now]
        if live:
            state.update(tuple(map(list, zip(*live, strict=True))))
            state.setTimeoutTimestamp(min(until for *_, until in live))
        else:
            state.remove()
        if seen:
            yield pd.DataFrame([(case, *held[case][:2]) for case in seen], columns=["case_id", "n_events", "prefix"])

    timed = events.withWatermark("ts", late).select(F.col("case_id").cast("string").alias("case_id"), "event_id", "activity", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    keyed = timed.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets))).groupBy("bucket")
    held = "case_ids array<string>, n array<long>, prefixes array<string>, until array<long>"
    return keyed.applyInPandasWithState(step, "case_id string, n_events long, prefix string", held, "update", GroupStateTimeout.EventTimeTimeout)


def finished(stream: DataFrame, mode: str, folder: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream yields for the files that are there now: the last state of each key, or of all in mode ``complete``.

    Each batch is written to a folder of its own, again if it is retried, so that results of any size stay off the driver.
    """
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/results/{batch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    spark.createDataFrame([], schema).withColumn("batch", F.lit(0)).write.parquet(f"{folder}/results/none")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch long").option("recursiveFileLookup", True).parquet(f"{folder}/results")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in schema.names if c not in keys)), "batch").alias("r")).select(*keys, "r.*")


def written(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """As finished(), through Parquet files, for streams in append mode and results of any size."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
    return stream.sparkSession.read.parquet(folder)


def as_event_log(rows: DataFrame) -> EventLog:
    """Rows that a stream has written (log, case_id, pos, activity, ts) as an event log."""
    return from_positions(rows)
