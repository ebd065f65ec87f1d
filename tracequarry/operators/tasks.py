"""Tables of tasks: which target values a generator is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.sources.files import cut


def objective_pairs(features: DataFrame) -> DataFrame:
    """(feat1, feat2): the unordered pairs of different features of a table (feature), a registry's size.

    The features come as one sorted array, whose later members follow each one.
    """
    every = features.agg(F.array_sort(F.collect_set("feature")).alias("f"))
    one = every.select(F.posexplode("f").alias("at", "feat1"), "f")
    return one.select("feat1", F.explode(F.slice("f", F.col("at") + 2, F.size("f"))).alias("feat2"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds task names, task_1 onwards, in the order.

    Rows are sorted in ranges, side by side; a range's first number is the size of those before it.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__own": own}))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = placed.groupBy("__part").agg(F.count("*").alias("__size")).select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn("task", F.concat(F.lit("task_"), (F.col("__start") + F.col("__own") + 1).cast("string"))).drop("__part", "__own", "__start")


def value_grid(spark: SparkSession, low: float = 0.0, high: float = 1.0, steps: int = 11) -> DataFrame:
    """(task, v1, v2): all pairs of evenly spaced values, row by row."""
    value = lambda k: F.round(low + k * (high - low) / max(steps - 1, 1), 10)
    cells = spark.range(steps * steps)
    return cells.select(F.concat(F.lit("task_"), (F.col("id") + 1).cast("string")).alias("task"), value(F.floor(F.col("id") / steps)).alias("v1"), value(F.col("id") % steps).alias("v2"))


def range_grid(rows: DataFrame, feat1: str, feat2: str) -> DataFrame:
    """(task, v1, v2): all pairs of the minimum, mean and maximum of two features of a long table."""
    points = rows.where(F.col("feature").isin(feat1, feat2)).groupBy().agg(*(f(F.when(F.col("feature") == n, F.col("value"))).alias(f"{k}{i}") for i, n in enumerate((feat1, feat2), 1) for k, f in (("a_", F.min), ("b_", F.avg), ("c_", F.max))))
    spread = points.select(F.explode(F.array(*(F.struct(F.lit(3 * i + j).alias("at"), F.col(f"{a}_1").alias("v1"), F.col(f"{b}_2").alias("v2")) for i, a in enumerate("abc") for j, b in enumerate("abc")))).alias("p"))
    return spread.select(F.concat(F.lit("task_"), (F.col("p.at") + 1).cast("string")).alias("task"), F.col("p.v1").alias("v1"), F.col("p.v2").alias("v2"))


def single_grid(spark: SparkSession, low: float = 0.0, high: float = 1.0, steps: int = 11) -> DataFrame:
    """(task, v1): evenly spaced values of one objective."""
    return spark.range(steps).select(F.concat(F.lit("task_"), (F.col("id") + 1).cast("string")).alias("task"), F.round(low + F.col("id") * (high - low) / max(steps - 1, 1), 10).alias("v1"))
