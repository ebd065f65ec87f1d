"""Features from counts of traces, lengths, variants and activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.model import EventLog, variants
from tracequarry.operators.statistics import moments, ratio

TOP_SHARES = (1, 5, 10, 20, 50, 75)
BINS = 10


def simple_stats(log: EventLog) -> DataFrame:
    """n_traces, n_unique_traces, ratio_variants_per_number_of_traces."""
    found = variants(log).groupBy("log").agg(F.sum("n").alias("n_traces"), F.count("*").alias("n_unique_traces"))
    return found.withColumn("ratio_variants_per_number_of_traces", F.col("n_unique_traces") / F.col("n_traces"))


def lengths(log: EventLog) -> DataFrame:
    """One row per (log, trace length) with ``n`` traces."""
    return log.traces.groupBy("log", F.col("n_events").alias("length")).agg(F.count("*").alias("n"))


def trace_length(log: EventLog) -> DataFrame:
    """All features of trace lengths. Geometric and harmonic means are 0 if a trace is empty."""
    counted = lengths(log)
    n, x = F.col("n"), F.col("length").cast("double")
    ln = F.when(x > 0, F.log(x))
    total, events = F.sum("n"), F.sum(n * x)
    any_empty = F.min("length") == 0
    mean_ln = F.sum(n * ln) / total
    extra = counted.groupBy("log").agg(
        F.max_by("length", F.struct("n", -F.col("length"))).cast("double").alias("trace_len_mode"),
        F.when(any_empty, 0.0).otherwise(F.exp(mean_ln)).alias("trace_len_geometric_mean"),
        F.when(any_empty, 0.0).when(total > 1, F.exp(F.sqrt(F.greatest(F.sum(n * ln * ln) - total * mean_ln * mean_ln, F.lit(0.0)) / (total - 1)))).alias("trace_len_geometric_std"),
        F.when(any_empty, 0.0).otherwise(total / F.sum(F.when(x > 0, n / x))).alias("trace_len_harmonic_mean"),
        F.when(events > 0, F.log(F.when(events > 0, events)) - F.sum(n * x * F.coalesce(ln, F.lit(0.0))) / F.when(events > 0, events)).otherwise(0.0).alias("trace_len_entropy"),
    )
    plain = moments(counted, "length", "n").drop("total")
    plain = plain.withColumnsRenamed({c: f"trace_len_{c}" for c in plain.columns if c != "log"})
    plain = plain.withColumn("trace_len_coefficient_variation", ratio(F.col("trace_len_std"), F.col("trace_len_mean")))
    return plain.join(extra, "log").join(length_histogram(log), "log")


def length_histogram(log: EventLog) -> DataFrame:
    """trace_len_hist1 to hist10: densities over equal bins of [min, max], and their skewness and kurtosis.

    If all lengths are equal the range is that length plus and minus a half.
    """
    per = Window.partitionBy("log")
    low, high = F.min("length").over(per), F.max("length").over(per)
    rows = lengths(log).withColumns({"low": F.when(low == high, low - 0.5).otherwise(low.cast("double")), "width": F.when(low == high, 1.0).otherwise((high - low).cast("double")) / BINS, "all": F.sum("n").over(per)})
    place = F.least(F.floor((F.col("length") - F.col("low")) / F.col("width")), F.lit(BINS - 1))
    density = F.col("n") / (F.col("all") * F.col("width"))
    bins = rows.groupBy("log").agg(*(F.sum(F.when(place == i, density).otherwise(0.0)).alias(f"trace_len_hist{i + 1}") for i in range(BINS)))
    values = F.array(*(f"trace_len_hist{i + 1}" for i in range(BINS)))
    total = lambda k, m=0.0: F.aggregate(values, F.lit(0.0), lambda a, v: a + F.pow(v - m, F.lit(k))) / BINS
    mean = total(1)
    return bins.withColumns({
        "trace_len_skewness_hist": ratio(total(3, mean), F.pow(total(2, mean), F.lit(1.5))),
        "trace_len_kurtosis_hist": ratio(total(4, mean), F.pow(total(2, mean), F.lit(2))) - 3,
    })


def top_shares(log: EventLog) -> DataFrame:
    """ratio_top_p_variants: the share of traces in the floor(V * p / 100) most frequent variants.

    Variants of equal frequency are one row with a weight, so that ranking them needs no row per variant.
    """
    sizes = variants(log).groupBy("log", "n").agg(F.count("*").alias("v"))
    order = Window.partitionBy("log").orderBy(F.desc("n"))
    before = F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = Window.partitionBy("log")
    rows = sizes.withColumns({"before": before, "all": F.sum("v").over(per), "traces": F.sum(F.col("v") * F.col("n")).over(per)})
    within = lambda p: F.greatest(F.least(F.floor(F.col("all") * p / 100) - F.col("before"), F.col("v")), F.lit(0))
    return rows.groupBy("log").agg(*((F.sum(within(p) * F.col("n")) / F.max("traces")).alias(f"ratio_top_{p}_variants") for p in TOP_SHARES))


def trace_variant(log: EventLog) -> DataFrame:
    """Shares of the most frequent variants and moments of the variants' occurrences."""
    sizes = variants(log).groupBy("log", "n").agg(F.count("*").alias("v"))
    found = moments(sizes, "n", "v").select("log", *(F.col(c).alias(f"{c}_variant_occurrence") for c in ("mean", "std", "skewness", "kurtosis")), (F.col("max") / (F.col("mean") * F.col("total"))).alias("ratio_most_common_variant"))
    return found.join(top_shares(log), "log")


def activity_counts(log: EventLog, kind: str) -> DataFrame:
    """One row per (log, activity) with ``n``: all events, or the first or last events of traces."""
    if kind == "activities":
        return log.events.groupBy("log", "activity").agg(F.count("*").alias("n"))
    column = {"start_activities": "first_activity", "end_activities": "last_activity"}[kind]
    return log.traces.where("n_events > 0").groupBy("log", F.col(column).alias("activity")).agg(F.count("*").alias("n"))


def activity_stats(log: EventLog, kind: str) -> DataFrame:
    """The twelve features of one family of activities."""
    counted = activity_counts(log, kind)
    found = moments(counted, "n").drop("total").withColumnsRenamed({c: f"{kind}_{c}" for c in ("min", "max", "mean", "median", "std", "variance", "q1", "q3", "iqr", "skewness", "kurtosis")})
    return counted.groupBy("log").agg(F.count("*").alias(f"n_unique_{kind}")).join(found, "log")


def merged(parts: list[DataFrame], on: str = "log") -> DataFrame:
    """A full outer join of tables by their key."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), parts)
