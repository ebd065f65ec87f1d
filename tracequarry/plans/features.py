"""Feature tables: only the parts with requested features are planned, each grouped by log and joined by log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.registry import PARTS, resolve
from tracequarry.model import EventLog
from tracequarry.sources.files import cut


def feature_table(log: EventLog, names: list[str] | None = None) -> DataFrame:
    """One row per log with a double column per feature, for features, families or aliases; all by default."""
    wanted = resolve(names)
    if sum(any(f in wanted for f in part.features) for part in PARTS) > 1:
        log = EventLog(log.events, cut(log.traces))  # one row per case, made once for all parts
    table = log.traces.select("log").distinct()
    for part in PARTS:
        own = [f for f in part.features if f in wanted]
        if own:
            table = table.join(part.plan(log).select("log", *own), "log", "left")
    return table.select("log", *(F.col(f).cast("double").alias(f) for f in wanted))


def long_form(table: DataFrame, id_col: str = "log") -> DataFrame:
    """(log, feature, value) without null and NaN values."""
    columns = [c for c, kind in table.dtypes if c != id_col and kind in ("double", "float", "bigint", "int")]
    rows = table.select(F.col(id_col).alias("log"), *(F.col(c).cast("double").alias(c) for c in columns))
    if not columns:
        return rows.select("log", F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    return rows.unpivot(["log"], columns, "feature", "value").where("value is not null and not isnan(value)")


def wide_form(rows: DataFrame, features: list[str]) -> DataFrame:
    """The inverse of long_form() for the named features."""
    return rows.groupBy("log").pivot("feature", features).agg(F.first("value"))
