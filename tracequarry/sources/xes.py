"""XES logs: Spark's XML reader with an explicit schema, and a writer with the standard's header.

Strings are read as strings whatever they look like, and a trace with one attribute or event as a
list of one. A trace without events is a row with no events. Traces that don't parse land in
``_corrupt_record``; unreadable() lists them, and read_xes() warns of them.
"""

from __future__ import annotations

import warnings
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.model import EventLog, from_positions
from tracequarry.sources.files import file_title, list_files, write_named

_ATTRIBUTE = "array<struct<_key:string,_value:string>>"
SCHEMA = f"event array<struct<string:{_ATTRIBUTE},date:{_ATTRIBUTE}>>, string {_ATTRIBUTE}, date {_ATTRIBUTE}, _corrupt_record string"
#: The extensions and defaults that a log's header names.
EXTENSIONS = (("Concept", "concept", "http://www.xes-standard.org/concept.xesext"), ("Time", "time", "http://www.xes-standard.org/time.xesext"), ("Lifecycle", "lifecycle", "http://www.xes-standard.org/lifecycle.xesext"))
TRACE_DEFAULTS = (("concept:name", "__INVALID__"),)
EVENT_DEFAULTS = (("lifecycle:transition", "complete"), ("concept:name", "__INVALID__"), ("time:timestamp", "1970-01-01T01:00:00.000+01:00"))


def attribute(attributes: Column, key: str) -> Column:
    """The value of the first attribute with a key; null if there is none."""
    return F.get(F.filter(attributes, lambda a: a["_key"] == key), F.lit(0))["_value"]


def read_xes_rows(spark: SparkSession, path: str, ending: str = ".xes") -> DataFrame:
    """One row per trace: log (the file's name without its ending), case_id, events (in file order), attributes, place (in the file), _corrupt_record.

    A folder is read with all folders below it.
    """
    if not list_files(spark, path, ending, deep=True):
        raise FileNotFoundError(f"no {ending} files in {path}")
    rows = spark.read.schema(SCHEMA).option("rowTag", "trace").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", True).xml(path)
    log = file_title(ending)
    events = F.transform(F.coalesce("event", F.array().cast(f"array<struct<string:{_ATTRIBUTE},date:{_ATTRIBUTE}>>")), lambda e: F.struct(attribute(e["string"], "concept:name").alias("activity"), F.to_timestamp(attribute(e["date"], "time:timestamp")).alias("ts"), attribute(e["string"], "lifecycle:transition").alias("lifecycle")))
    return rows.select(log.alias("log"), attribute(F.col("string"), "concept:name").alias("case_id"), events.alias("events"), F.map_from_entries(F.transform(F.coalesce("string", F.array().cast(_ATTRIBUTE)), lambda a: F.struct(a["_key"], a["_value"]))).alias("attributes"), F.array("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"), "_corrupt_record")


def unreadable(rows: DataFrame) -> DataFrame:
    """(log, case_id, _corrupt_record) of traces that couldn't be read."""
    return rows.where("_corrupt_record is not null").select("log", "case_id", "_corrupt_record")


def read_xes(spark: SparkSession, path: str, ending: str = ".xes", warn: bool = True) -> EventLog:
    """A file or a folder of ``.xes`` files as an event log; each file is a log.

    Traces that can't be read are left out, with a warning that counts them per log; for it the files are
    read once more, which ``warn=False`` spares.
    """
    every = read_xes_rows(spark, path, ending)
    if warn and (lost := unreadable(every).groupBy("log").agg(F.count("case_id").alias("named"), F.count("*").alias("n")).orderBy("log").limit(20).collect()):
        warnings.warn("traces could not be read: " + ", ".join(f"{r.n} of {r.log}" for r in lost), stacklevel=2)
    rows = every.where("_corrupt_record is null")
    events = rows.select("log", "case_id", "place", F.posexplode("events").alias("at", "event"))
    return from_positions(
        events.select("log", "case_id", "place", (F.col("at") + 1).alias("pos"), F.col("event.activity").alias("activity"), F.col("event.ts").alias("ts")),
        rows.where(F.size("events") == 0).select("log", "case_id", "place"),
    )


def header() -> str:
    """What stands before a log's traces."""
    lines = ['<?xml version="1.0" ?>', '<log xmlns="http://www.xes-standard.org/" xes.version="1849-2016" xes.features="nested-attributes">']
    for scope, defaults in (("trace", TRACE_DEFAULTS), ("event", EVENT_DEFAULTS)):
        lines += [f'\t<global scope="{scope}">', *(f"\t\t<string key={quoteattr(k)} value={quoteattr(v)}/>" for k, v in defaults), "\t</global>"]
    lines += [f"\t<extension name={quoteattr(n)} prefix={quoteattr(p)} uri={quoteattr(u)}/>" for n, p, u in EXTENSIONS]
    return "\n".join(lines)


def escaped(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def trace_lines(log: EventLog) -> DataFrame:
    """(log, seen, line): each trace as XML, made on the executors."""
    tag = lambda kind, key, value: F.concat(F.lit(f'<{kind} key="{key}" value="'), escaped(value), F.lit('"/>'))
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = F.concat(F.lit("\t\t<event>"), tag("string", "concept:name", F.col("activity")), tag("string", "lifecycle:transition", F.lit("complete")), F.coalesce(tag("date", "time:timestamp", when), F.lit("")), F.lit("</event>\n"))
    events = log.events.select("log", "case_id", F.struct("pos", event.alias("x")).alias("e")).groupBy("log", "case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "").alias("events"))
    rows = log.traces.select("log", "case_id", "seen").join(events, ["log", "case_id"], "left")
    return rows.select("log", "seen", F.concat(F.lit("\t<trace>\n\t\t"), tag("string", "concept:name", F.col("case_id")), F.lit("\n"), F.coalesce("events", F.lit("")), F.lit("\t</trace>")).alias("line"))


def write_xes(log: EventLog, folder: str) -> None:
    """A file ``<log>.xes`` in the folder for each log.

    A log is one file, so one task writes it, streaming; logs are written side by side.
    """
    names = log.traces.select("log").distinct()
    edge = lambda place, text: names.select("log", F.lit(None).cast(log.traces.schema["seen"].dataType).alias("seen"), F.lit(text).alias("line"), F.lit(place).alias("place"))
    rows = trace_lines(log).withColumn("place", F.lit(1)).unionByName(edge(0, header())).unionByName(edge(2, "</log>"))
    write_named(rows.select(F.col("log").alias("name"), F.col("line").alias("value"), "place", "seen"), folder, ".xes", ["place", "seen"])


def trace_numbers(log: EventLog) -> DataFrame:
    """(log, case_id, trace_idx): traces numbered per log in order."""
    place = Window.partitionBy("log").orderBy("seen")
    return log.traces.select("log", "case_id", F.row_number().over(place).alias("trace_idx"))
