"""Statistics of a value per log, from a table of distinct values with their counts.

Moments are population moments, skewness and kurtosis biased, kurtosis in excess, quantiles linear.
A table of distinct values is small however many rows it was counted from, so that what follows the
first aggregation is cheap. Where the variance is zero, skewness and kurtosis are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def moments(counted: DataFrame, value: str, count: str | None = None, by: str = "log") -> DataFrame:
    """min, max, mean, median, std, variance, q1, q3, iqr, skewness, kurtosis and total per group.

    ``count`` names the column that says how often a value occurs; without it, once.
    """
    per = Window.partitionBy(by)
    c, x = (F.col(count) if count else F.lit(1)).cast("double"), F.col(value).cast("double")
    rows = counted.select(by, x.alias("x"), c.alias("c")).withColumn("mean", F.sum(F.col("c") * F.col("x")).over(per) / F.sum("c").over(per))
    away = F.col("x") - F.col("mean")
    power = lambda k: (F.sum(F.col("c") * F.pow(away, F.lit(k))) / F.sum("c")).alias(f"m{k}")
    frequency = F.col("c").cast("long")
    quantile = lambda p: F.percentile("x", F.lit(p), frequency)
    found = rows.groupBy(by).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.first("mean").alias("mean"), quantile(0.5).alias("median"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), power(2), power(3), power(4), F.sum("c").alias("total"))
    variance = F.col("m2")
    return found.select(
        by, "min", "max", "mean", "median", F.sqrt(variance).alias("std"), variance.alias("variance"), "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        ratio(F.col("m3"), F.pow(variance, F.lit(1.5))).alias("skewness"), (ratio(F.col("m4"), variance * variance) - 3).alias("kurtosis"), "total",
    )


def entropy(counted: DataFrame, count: str, by: list[str], base: float | None = 2.0) -> DataFrame:
    """``entropy`` of the distribution that a count column describes, per group; natural logarithm if base is None."""
    n = F.col(count).cast("double")
    total = F.sum(n)
    nats = F.log(total) - F.sum(n * F.log(n)) / total
    return counted.where(F.col(count) > 0).groupBy(*by).agg((nats if base is None else nats / F.log(F.lit(base))).alias("entropy"))
