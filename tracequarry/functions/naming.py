"""Names that configurations, files and tasks go by, as column expressions and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.registry import ALIASES


def abbreviated(key: Column) -> Column:
    """Of each part between underscores, the first character and all digits after it."""
    parts = F.transform(F.split(key, "_"), lambda t: F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1_000_000), "[^0-9]", "")))
    return F.array_join(parts, "")


def abbreviation(keys: list[str]) -> str:
    """Abbreviated keys joined by underscores."""
    return "_".join("".join(p[:1] + re.sub(r"[^0-9]", "", p[1:]) for p in k.split("_")) for k in keys)


def natural_key(text: Column) -> Column:
    """A sort key by which runs of digits, of any length, compare as numbers and letters without case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 10, "0"), digits(r))).otherwise(r))


def suffix_number(file: Column) -> Column:
    """The number between the last underscore and the file's ending."""
    return F.regexp_extract(file, r"_(\d+)\.[^_]*$", 1).try_cast("int")


def value_text(value: Column) -> Column:
    """A value rounded to four decimals, without its point."""
    return F.regexp_replace(F.round(value, 4).cast("string"), r"\.", "")


def output_location(targets: dict[str, float], root: str, identifier: str) -> str:
    """Where a task's results go: ``root/<n>_<keys>/<id>_<values>``, or ``root/<n>_features/<id>`` for more than seven keys."""
    keys = sorted(targets)
    if len(keys) > 7:
        return f"{root}/{len(keys)}_features/{identifier}"
    values = "_".join(str(round(targets[k], 4)) for k in keys).replace(".", "")
    return f"{root}/{len(keys)}_{abbreviation(keys)}/{identifier}_{values}"


def output_keys(rows: DataFrame, id_col: str, key_col: str, value_col: str) -> DataFrame:
    """(id, folder, name) of long rows (id, key, value): the relational form of output_location()."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("k"), F.col(value_col).alias("v"))))
    got = rows.groupBy(id_col).agg(pairs.alias("p"))
    many = F.size("p") > 7
    keys = F.array_join(F.transform("p", lambda x: abbreviated(x["k"])), "_")
    values = F.array_join(F.transform("p", lambda x: value_text(x["v"])), "_")
    n = F.size("p").cast("string")
    return got.select(id_col, F.when(many, F.concat(n, F.lit("_features"))).otherwise(F.concat(n, F.lit("_"), keys)).alias("folder"), F.when(many, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("_"), values)).alias("name"))


def full_names(table: DataFrame) -> DataFrame:
    """The table with short and older feature names replaced."""
    return table.withColumnsRenamed({c: ALIASES[c] for c in table.columns if c in ALIASES})


def wrapped(text: Column, width: int = 140) -> Column:
    """The text with a line break after every ``width`` characters."""
    return F.regexp_replace(text, f"(.{{{width}}})", "$1\n")
