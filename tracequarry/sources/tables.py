"""Feature tables, targets and task sources: CSV and JSON files read with Spark, written per log or merged.

NaN and empty values become null. Short and older feature names are replaced by full ones.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.naming import abbreviated, abbreviation, full_names
from tracequarry.sources.files import list_files, write_named, write_single

ID_NAMES = ("log", "task")


def nan_to_null(table: DataFrame) -> DataFrame:
    kinds = dict(table.dtypes)
    return table.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in table.columns))


def id_column(table: DataFrame) -> str:
    """``log`` or ``task`` if there is one, else the first string column without nulls."""
    for name in ID_NAMES:
        if name in table.columns:
            return name
    texts = [c for c, kind in table.dtypes if kind == "string"]
    if texts:
        nulls = table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in texts)).first()
        for c in texts:
            if not nulls[c]:
                return c
    raise ValueError("no column names the logs")


def with_log(table: DataFrame) -> DataFrame:
    """The table with its id column named ``log`` and first."""
    name = id_column(table)
    rest = [c for c in table.columns if c != name]
    return table.select(F.col(name).cast("string").alias("log"), *rest)


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV file with a header; a byte-order mark in front of it is dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("nanValue", "NaN").option("quote", '"').option("escape", '"')
    table = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return nan_to_null(table.withColumnsRenamed({c: c.lstrip("﻿") for c in table.columns}))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature CSV as a table (log, features)."""
    return with_log(full_names(read_csv(spark, path)))


def read_feature_json(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON files as one table; keys that an object lacks are null.

    A file holds an object a line, or one object (or list of objects) over several lines.
    """
    files = list_files(spark, folder, ".json")
    if not files:
        raise FileNotFoundError(f"no JSON files in {folder}")
    lines = spark.read.text(files).where("trim(value) <> ''").select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"(?<=[:\s,\[])-?(NaN|Infinity)(?=[\s,}\]]|$)", "null").alias("value"))
    spread = {unquote(r.file) for r in lines.where(F.expr("try_parse_json(value)").isNull()).select("file").distinct().collect()}
    reader = lambda whole: spark.read.option("multiLine", whole).option("allowNonNumericNumbers", True).option("mode", "FAILFAST")
    groups = [(whole, [f for f in files if (unquote(f.rsplit("/", 1)[-1]) in spread) == whole]) for whole in (False, True)]
    parts = [nan_to_null(reader(whole).json(some)) for whole, some in groups if some]
    return with_log(full_names(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)))


def write_feature_csv(table: DataFrame, path: str) -> None:
    """One CSV file with a header: a feature table has one row per log."""
    write_single(table, path, "csv", header=True)


def write_feature_json(table: DataFrame, folder: str) -> None:
    """A file ``<log>.json`` per log with a JSON object a row."""
    write_named(table.select(F.col("log").alias("name"), F.to_json(F.struct("*")).alias("value")), folder, ".json", ["value"])


def merge_jsons(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The JSON files of a folder as one CSV file, whose header is the union of their keys."""
    table = read_feature_json(spark, folder)
    write_feature_csv(table, path)
    return table


def write_experiments(pairs: DataFrame, folder: str, values: list[float], results: str = "output") -> None:
    """For each pair of objectives (feat1, feat2): a CSV file of targets, all pairs of the values, and a pipeline configuration that asks for them.

    The files are named ``grid_2objectives_<short names>`` with the endings .csv and .json.
    """
    name = F.concat(F.lit("grid_2objectives_"), abbreviated(F.col("feat1")), F.lit("_"), abbreviated(F.col("feat2")))
    grid = [f"task_{k},{a},{b}" for k, (a, b) in enumerate(((a, b) for a in values for b in values), 1)]
    lines = F.concat(F.array(F.concat(F.lit("task,"), F.col("feat1"), F.lit(","), F.col("feat2"))), F.array(*map(F.lit, grid)))
    write_named(pairs.select(name.alias("name"), F.posexplode(lines).alias("place", "value")), folder, ".csv", ["place"])
    step = lambda kind, *fields: F.struct(F.lit(kind).alias("pipeline_step"), *fields)
    experiment = F.struct(F.concat(F.lit(f"{folder}/"), name, F.lit(".csv")).alias("input_path"), F.array("feat1", "feat2").alias("objectives"))
    out = F.concat(F.lit(f"{results}/"), name)
    made = F.to_json(F.struct(step("event_logs_generation", out.alias("output_path"), F.struct(experiment.alias("experiment")).alias("generator_params")).alias("s")))
    read = F.to_json(F.struct(step("feature_extraction", out.alias("input_path"), F.struct(F.array("feat1", "feat2").alias("feature_set")).alias("feature_params")).alias("s")))
    inner = lambda x: F.regexp_extract(x, r'^\{"s":(.*)\}$', 1)
    write_named(pairs.select(name.alias("name"), F.concat(F.lit("["), inner(made), F.lit(",\n"), inner(read), F.lit("]")).alias("value")), folder, ".json", [])


def read_family(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(feat1, feat2, file, log, v1, v2) of feature or target files; a path is a file, a folder or the start of files' names.

    A file with one feature besides ``log`` gives it as both; of more, the first two count.
    """
    files = []
    for path in paths:
        folder, start = path.rsplit("/", 1)
        files += [path] if path.endswith(".csv") else [f for f in list_files(spark, folder, ".csv") if f.rsplit("/", 1)[-1].startswith(start)] if start else list_files(spark, folder, ".csv")
    if not files:
        raise FileNotFoundError(f"no CSV files start with {paths}")
    parts = []
    for file in files:
        table = read_features(spark, file)
        found = sorted([c for c in table.columns if c not in ("log", "target_similarity")][:2])
        one, two = found[0], found[-1]
        parts.append(table.select(F.lit(one).alias("feat1"), F.lit(two).alias("feat2"), F.lit(file.rsplit("/", 1)[-1]).alias("file"), "log", F.col(one).cast("double").alias("v1"), F.col(two).cast("double").alias("v2")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_csvs(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The CSV files of a folder whose names start with a prefix, joined by ``log``; each keeps all its rows."""
    files = [f for f in list_files(spark, folder, ".csv") if f.rsplit("/", 1)[-1].startswith(prefix)]
    if not files:
        raise ValueError(f"no CSV files start with {prefix} in {folder}")
    return reduce(lambda a, b: a.join(b, "log", "full_outer"), (with_log(read_csv(spark, f)) for f in files))


def read_competitors(spark: SparkSession, folder: str, reference: str) -> dict[str, DataFrame]:
    """The CSV files whose names have the reference feature's abbreviation between underscores, by the other feature."""
    short, out = abbreviation([reference]), {}
    for path in list_files(spark, folder, ".csv"):
        if short in path.rsplit("/", 1)[-1][:-4].split("_"):
            table = read_features(spark, path)
            other = [c for c in table.columns if c not in ("log", reference)]
            if other:
                out[other[0]] = table
    return out


def tasks(spark: SparkSession, experiment: str | dict | list, reference: str | None = None) -> DataFrame | dict[str, DataFrame]:
    """The targets of an experiment: a CSV file, a folder of them, {input_path, objectives}, a list of rows or one row."""
    if isinstance(experiment, str):
        if experiment.endswith(".csv"):
            return read_features(spark, experiment)
        if reference:
            return read_competitors(spark, experiment, reference)
        raise ValueError(f"neither a CSV file nor, with a reference feature, a folder: {experiment}")
    if isinstance(experiment, dict) and "input_path" in experiment:
        table = read_features(spark, experiment["input_path"])
        return table.select("log", *experiment["objectives"]) if "objectives" in experiment else table
    rows = experiment if isinstance(experiment, list) else [experiment]
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"not an experiment: {experiment!r}")
    keys = list(dict.fromkeys(k for r in rows for k in r))
    kinds = ", ".join(f"`{k}` {'string' if any(isinstance(r.get(k), str) for r in rows) else 'double'}" for k in keys)
    table = spark.createDataFrame([tuple(r.get(k) if isinstance(r.get(k), str) or r.get(k) is None else float(r[k]) for k in keys) for r in rows], kinds)
    if not any(isinstance(r.get(k), str) for r in rows for k in keys):
        table = spark.createDataFrame([(str(i), *(None if r.get(k) is None else float(r[k]) for k in keys)) for i, r in enumerate(rows, 1)], f"log string, {kinds}")
    return with_log(full_names(table))
