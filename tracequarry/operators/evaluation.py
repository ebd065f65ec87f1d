"""Comparing generated with target features: joins, distances, grids, matrices and selections.

Feature tables are compared in long form (log, feature, value), where a feature that isn't an
objective of a log simply has no row. Wide tables have a column ``log``. Aggregations are partial
before they shuffle; a one-row side is the only thing joined without a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common(targets: DataFrame, achieved: DataFrame) -> DataFrame:
    """(log, feature, target, achieved) of the features that both long tables have for a log."""
    return targets.select("log", "feature", F.col("value").alias("target")).join(achieved.select("log", "feature", F.col("value").alias("achieved")), ["log", "feature"])


def target_similarity(targets: DataFrame, achieved: DataFrame) -> DataFrame:
    """(log, target_similarity): 1 / (1 + Euclidean distance over the common features), null for a target log without any."""
    off = F.col("target") - F.col("achieved")
    found = common(targets, achieved).groupBy("log").agg((1 / (1 + F.sqrt(F.sum(off * off)))).alias("target_similarity"))
    return targets.select("log").distinct().join(found, "log", "left")


def objective_errors(targets: DataFrame, achieved: DataFrame) -> DataFrame:
    """(log, feature, error): the absolute error of each objective."""
    return common(targets, achieved).select("log", "feature", F.abs(F.col("target") - F.col("achieved")).alias("error"))


def scalar_cost(errors: DataFrame) -> DataFrame:
    """(log, cost): all objectives with weight 1."""
    return errors.groupBy("log").agg(F.avg("error").alias("cost"))


def first_per_log(table: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each log."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy("log").orderBy(*order))).where("__n = 1").drop("__n")


def match_or_first(left: DataFrame, right: DataFrame, values: list[str], order: list[Column]) -> DataFrame:
    """Each row of left with the first match's values on ``log``; without a match, with those of right's very first row.

    ``order`` says what comes first in right. Matched values are named ``right_<value>``.
    """
    packed = F.struct(*(F.col(v).alias(f"right_{v}") for v in values))
    first = first_per_log(right, order).select("log", packed.alias("own"))
    top = right.orderBy(*order).limit(1).select(packed.alias("fallback"))
    rows = left.join(first, "log", "left").join(F.broadcast(top), how="left")  # the right side is one row
    got = F.coalesce("own", "fallback")
    return rows.select(*(left[c] for c in left.columns), *(got[f"right_{v}"].alias(f"right_{v}") for v in values))


def distances(generated: DataFrame, targets: DataFrame, features: list[str], order: list[Column]) -> DataFrame:
    """(log, x, y, distance): for two (or one) features, the distance of each generated row to its target, matched or first."""
    rows = match_or_first(generated, targets, features, order)
    square = reduce(lambda a, b: a + b, (F.pow(F.col(f) - F.col(f"right_{f}"), F.lit(2)) for f in features))
    return rows.select("log", *(F.col(f"right_{f}").alias(n) for f, n in zip(features, "xy", strict=False)), F.sqrt(square).alias("distance"))


def without_nulls(targets: DataFrame, generated: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the targets that lack one of the features, and without what was generated for them."""
    lacking = reduce(lambda a, b: a | b, (F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features))
    gone = targets.where(lacking).select("log").distinct()
    return targets.where(~lacking), generated.join(gone, "log", "left_anti")


def cumulated_distance(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sum of distances per group, and how many."""
    return rows.groupBy(*by).agg(F.sum("distance").alias("cumulated_distance"), F.count("*").alias("n"))


def distance_grid(rows: DataFrame, cells: int = 10) -> DataFrame:
    """(i, j, n, value): mean distance over a grid of the targets' range, sqrt(2) where a cell is empty.

    A step is a cell-th of the range, rounded to four decimals; a target's cell is its offset over
    the step, rounded half to even.
    """
    lows = rows.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.round((F.max("x") - F.min("x")) / cells, 4).alias("dx"), F.round((F.max("y") - F.min("y")) / cells, 4).alias("dy"))
    placed = rows.join(F.broadcast(lows), how="left")  # one row
    cell = lambda v, v0, d: F.when(F.col(d) > 0, F.bround((F.col(v) - F.col(v0)) / F.when(F.col(d) > 0, F.col(d)))).otherwise(0).cast("int")
    got = placed.select(cell("x", "x0", "dx").alias("i"), cell("y", "y0", "dy").alias("j"), "distance").groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("distance").alias("value"))
    full = rows.sparkSession.range((cells + 1) ** 2).select((F.col("id") % (cells + 1)).cast("int").alias("i"), F.floor(F.col("id") / (cells + 1)).cast("int").alias("j"))
    return full.join(got, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.sqrt(F.lit(2.0))).alias("value"))


def distinct_value_grid(rows: DataFrame, order: str) -> DataFrame:
    """(i, j, n, value): as distance_grid(), on the distinct target values, numbered by first appearance."""
    def numbered(c, name):
        first = rows.groupBy(c).agg(F.min(order).alias("first"))
        return first.select(c, (F.row_number().over(Window.orderBy("first")) - 1).alias(name))

    placed = rows.join(numbered("x", "i"), "x").join(numbered("y", "j"), "y")
    return placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("distance").alias("value"))


def pair_distances(targets: DataFrame, achieved: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feat1, feat2, log, distance) for each pair of features (feat1, feat2) and each log that has both."""
    both = common(targets, achieved).withColumn("square", F.pow(F.col("target") - F.col("achieved"), F.lit(2)))
    one = both.select("log", F.col("feature").alias("feat1"), F.col("square").alias("s1"))
    two = both.select("log", F.col("feature").alias("feat2"), F.col("square").alias("s2"))
    return pairs.join(one, "feat1").join(two, ["log", "feat2"]).select("feat1", "feat2", "log", F.sqrt(F.col("s1") + F.col("s2")).alias("distance"))


def distance_matrix(rows: DataFrame) -> DataFrame:
    """(feat1, feat2, value): the mean distance of each pair, in both directions."""
    mean = rows.groupBy("feat1", "feat2").agg(F.avg("distance").alias("value"))
    mirrored = mean.where("feat1 <> feat2").select(F.col("feat2").alias("feat1"), F.col("feat1").alias("feat2"), "value")
    return mean.unionByName(mirrored)


def selected(rows: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The instances closer than the threshold."""
    return rows.where(F.col("distance") < threshold)


def histogram(rows: DataFrame, column: str = "distance", bins: int = 30) -> DataFrame:
    """(bin, low, high, n) over equal bins of the column's range; the last is closed, empty bins have 0."""
    edge = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counted = rows.join(F.broadcast(edge), how="left").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    every = edge.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def outer_merge(tables: list[DataFrame]) -> DataFrame:
    """Tables joined by ``log``, each keeping all its rows."""
    return reduce(lambda a, b: a.join(b, "log", "full_outer"), tables)


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Tables on top of each other with a tag, in the first one's columns; columns that one lacks are null."""
    frames = [t.withColumn(tag, F.lit(k)) for k, t in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*frames[0].columns)


def box_statistics(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """What a box plot shows: n, low, q1, median, q3, high per group."""
    got = rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"))
    return got.select(*by, "n", *(F.col("p")[i].alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))))


def feature_ranges(rows: DataFrame) -> DataFrame:
    """(feature, n, low, high, mean) of a long table."""
    return rows.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def unit_range_features(rows: DataFrame) -> DataFrame:
    """The features whose values all lie in [0, 1]."""
    return feature_ranges(rows).where("low >= 0 and high <= 1").select("feature")


def numeric_part(table: DataFrame) -> DataFrame:
    """``log`` and the numeric columns."""
    return table.select("log", *(c for c, kind in table.dtypes if c != "log" and kind in ("double", "float", "bigint", "int", "smallint", "tinyint")))
