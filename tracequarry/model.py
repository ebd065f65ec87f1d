"""The event-log model: flat events and one row per trace.

A log's events are rows ``(log, case_id, pos, activity, ts)`` with pos from 1 in a case. Traces are
rows of their own, so that a trace without events counts. Nothing is held as an array per case: a
trace's identity is its length and two combinations, by exclusive or, of hashes of (pos, activity), which
partial aggregation computes; a prefix's identity is the running ones. Together they have 128 bits, for
cases of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_hash(seed: int, pos: Column | str = "pos") -> Column:
    """The hash of an activity at its place."""
    return F.xxhash64(F.lit(seed), pos, "activity")


@dataclass(frozen=True)
class EventLog:
    """``events``: log, case_id, pos, activity, ts, h1, h2. ``traces``: log, case_id, n_events, v1, v2, first_activity, last_activity, seen.

    ``seen`` orders a log's traces: the first event's time, then where the trace stood in its file
    (null if it comes from a table), then the case.
    """

    events: DataFrame
    traces: DataFrame


def from_positions(events: DataFrame, empty: DataFrame | None = None) -> EventLog:
    """A log of rows (log, case_id, pos, activity, ts) and, if any, (log, case_id) of traces without events.

    An optional column ``place`` (array<long>) of both says where the trace stood in its file.
    """
    placed = lambda rows: F.col("place") if "place" in rows.columns else F.lit(None).cast("array<long>")
    events = events.select(placed(events).alias("place"), F.coalesce(F.col("log").cast("string"), F.lit("")).alias("log"), F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id"), F.col("pos").cast("long").alias("pos"), F.coalesce("activity", F.lit("")).alias("activity"), F.col("ts").cast("timestamp").alias("ts"))
    events = events.withColumns({"h1": step_hash(1), "h2": step_hash(2)})
    traces = events.groupBy("log", "case_id").agg(
        F.count("*").alias("n_events"), F.bit_xor("h1").alias("v1"), F.bit_xor("h2").alias("v2"),
        F.min_by("activity", "pos").alias("first_activity"), F.max_by("activity", "pos").alias("last_activity"), F.min("ts").alias("first_ts"), F.min("place").alias("place"),
    )
    if empty is not None:
        none = {"n_events": F.lit(0).cast("long"), "v1": F.lit(0).cast("long"), "v2": F.lit(0).cast("long"), "first_activity": F.lit(None).cast("string"), "last_activity": F.lit(None).cast("string"), "first_ts": F.lit(None).cast("timestamp")}
        traces = traces.unionByName(empty.select(F.coalesce(F.col("log").cast("string"), F.lit("")).alias("log"), F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id"), placed(empty).alias("place")).withColumns(none))
    traces = traces.withColumn("seen", F.struct("first_ts", "place", "case_id")).drop("first_ts", "place")
    return EventLog(events.drop("place"), traces)


def event_log(table: DataFrame, case: Column, activity: Column, order: list[Column], ts: Column, log: Column | str = "log") -> EventLog:
    """Any table as an event log: events of a case are ordered by ``order``.

    Rows need a total order per case for a stable result. Null activities are empty strings, null
    cases one case of their own.
    """
    log = F.lit(log) if isinstance(log, str) else log
    rows = table.select(log.cast("string").alias("log"), case.cast("string").alias("case_id"), activity.cast("string").alias("activity"), ts.cast("timestamp").alias("ts"), *(o.alias(f"__o{i}") for i, o in enumerate(order)))
    place = Window.partitionBy("log", "case_id").orderBy(*(f"__o{i}" for i in range(len(order))))
    return from_positions(rows.withColumn("pos", F.row_number().over(place)))


def variants(log: EventLog) -> DataFrame:
    """One row per (log, variant): n_events, v1, v2 and ``n`` traces; the empty trace is a variant."""
    return log.traces.groupBy("log", "n_events", "v1", "v2").agg(F.count("*").alias("n"))


def prefixes(log: EventLog) -> DataFrame:
    """The events with p1, p2 (identity of the prefix up to them) and q1, q2 (that of the prefix before)."""
    upto = Window.partitionBy("log", "case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.events.withColumns({"p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto)})
    return rows.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("h1")), "q2": F.col("p2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")


def tables(log: EventLog) -> dict[str, DataFrame]:
    """The log as plain tables, with a nested one: a row per trace with its events in order."""
    nested = log.events.groupBy("log", "case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "activity", "ts"))).alias("events"))
    return {"events": log.events.drop("h1", "h2"), "traces": log.traces.select("log", "case_id", "n_events", "seen.first_ts"), "nested": log.traces.select("log", "case_id").join(nested, ["log", "case_id"], "left")}
