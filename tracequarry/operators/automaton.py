"""Entropies over the extended prefix automaton, as one relational plan.

States are distinct non-empty prefixes. The first child of a state that isn't the root continues
its parent's partition; any other state opens one. Siblings are ordered by when they were first
seen, in the order of the log's traces. A partition is found from a state by
following the trace that first reached it, so that only those traces are walked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.model import EventLog, prefixes

STATE = ["log", "pos", "p1", "p2"]
#: The least weight of a partition under linear forgetting.
LEAST_WEIGHT = 1e-6


def states(log: EventLog) -> DataFrame:
    """One row per state: its events ``n``, their weights under linear and exponential forgetting, whether it opens a partition, and the case that first reached it."""
    span = log.events.groupBy("log").agg(F.min(F.unix_micros("ts")).alias("t0"), F.max(F.unix_micros("ts")).alias("t1"))
    age = F.when(F.col("t1") > F.col("t0"), (F.col("t1") - F.unix_micros("ts")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    first = log.traces.select("log", "case_id", "seen")
    rows = prefixes(log).join(first, ["log", "case_id"]).join(span, "log").withColumn("age", age)
    found = rows.groupBy(*STATE).agg(F.count("*").alias("n"), F.sum(1 - F.col("age")).alias("linear"), F.sum(F.exp(-F.col("age"))).alias("exponential"), F.min("seen").alias("seen"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    sibling = F.row_number().over(Window.partitionBy("log", "pos", "q1", "q2").orderBy("seen"))
    return found.withColumn("opens", (F.col("pos") == 1) | (sibling > 1)).select(*STATE, "n", "linear", "exponential", "opens", F.col("seen.case_id").alias("reached_by"))


def partitions(log: EventLog) -> DataFrame:
    """One row per partition: log, its opening state (pos, o1, o2), ``states``, ``events`` and the weights."""
    known = states(log)
    walked = known.select("log", F.col("reached_by").alias("case_id")).distinct()
    path = prefixes(log).select(*STATE, "case_id").join(walked, ["log", "case_id"], "left_semi").join(known, STATE)
    upto = Window.partitionBy("log", "case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.last(F.when(F.col("opens"), F.struct("pos", "p1", "p2")), ignorenulls=True).over(upto)
    own = path.withColumn("opening", opening).where("case_id = reached_by")
    return own.groupBy("log", "opening").agg(F.count("*").alias("states"), F.sum("n").alias("events"), F.sum("linear").alias("linear"), F.sum("exponential").alias("exponential")).select("log", F.col("opening.pos").alias("pos"), F.col("opening.p1").alias("o1"), F.col("opening.p2").alias("o2"), "states", "events", "linear", "exponential")


def automaton_entropies(log: EventLog) -> DataFrame:
    """The eight features; all sequence entropies are normalised by the unweighted events. 0 where undefined."""
    xlnx = lambda x: F.when(x > 0, x * F.log(F.when(x > 0, x))).otherwise(0.0)
    rows = partitions(log).select("log", "linear", *(F.col(c).cast("double").alias(c) for c in ("states", "events", "exponential")), F.greatest("linear", F.lit(LEAST_WEIGHT)).alias("floored"))
    sums = rows.groupBy("log").agg(*(F.sum(c).alias(c) for c in ("states", "events", "linear", "exponential")), *(F.sum(xlnx(F.col(c))).alias(f"{c}_parts") for c in ("states", "events", "floored", "exponential")))
    value = lambda whole, parts: xlnx(F.col(whole)) - F.col(f"{parts}_parts")
    names = {"epa_variant_entropy": ("states", "states", "states"), "epa_sequence_entropy": ("events", "events", "events"), "epa_sequence_entropy_linear_forgetting": ("linear", "floored", "events"), "epa_sequence_entropy_exponential_forgetting": ("exponential", "exponential", "events")}
    out = []
    for name, (whole, parts, by) in names.items():
        raw, scale = value(whole, parts), xlnx(F.col(by))
        out += [F.when(F.col(by) > 1, raw).otherwise(0.0).alias(name), F.when(scale > 0, raw / F.when(scale > 0, scale)).otherwise(0.0).alias(name.replace("epa_", "epa_normalized_"))]
    return sums.select("log", *out)
