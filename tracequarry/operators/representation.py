"""Representativeness of feature tables: imputation, scaling, principal components, hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_totals(table: DataFrame, totals: list) -> DataFrame:
    """Each row with aggregates of the whole table, which are one row."""
    return table.join(F.broadcast(table.agg(*totals)), how="left")


def impute_mean(table: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN replaced by the column's mean."""
    clean = table.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in table.columns))
    rows = _with_totals(clean, [F.avg(c).alias(f"__{c}") for c in columns])
    return rows.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in table.columns))


def standardize(table: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    rows = _with_totals(table, [f(c).alias(f"__{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = lambda c: F.when(F.col(f"__s{c}") > 0, (F.col(c) - F.col(f"__m{c}")) / F.when(F.col(f"__s{c}") > 0, F.col(f"__s{c}"))).otherwise(F.when(F.col(c).isNotNull(), 0.0))
    return rows.select(*(scaled(c).alias(c) if c in columns else F.col(c) for c in table.columns))


def l2_normalize(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each row divided by its Euclidean norm; a row of zeros stays."""
    norm = F.sqrt(sum((F.pow(F.col(c), F.lit(2)) for c in columns), F.lit(0.0)))
    rows = table.withColumn("__norm", norm)
    return rows.select(*(F.when(F.col("__norm") > 0, F.col(c) / F.when(F.col("__norm") > 0, F.col("__norm"))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def principal_components(table: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float], DataFrame]:
    """(log, pc1 .. pck), the explained share of variance per component, and (feature, pc1 .. pck) weights.

    Columns are centred first, which Spark's transform doesn't do. A component's sign is fixed by
    making its largest weight positive.
    """
    spark = table.sparkSession
    rows = _with_totals(table, [F.avg(c).alias(f"__{c}") for c in columns]).select("log", *((F.col(c) - F.col(f"__{c}")).alias(c) for c in columns))
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(rows)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    weights = model.pc.toArray()
    sign = np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(k)])
    out = model.transform(vectors).select("log", vector_to_array("p").alias("p")).select("log", *((F.col("p")[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)))
    named = spark.createDataFrame([(c, *map(float, w)) for c, w in zip(columns, weights * sign, strict=True)], "feature string, " + ", ".join(f"pc{i + 1} double" for i in range(k)))
    return out, [float(x) for x in model.explainedVariance.toArray()], named


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the lowest x."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def convex_hulls(points: DataFrame, by: str, x: str, y: str, parts: int = 64) -> DataFrame:
    """(by, corner, x, y): the hull of each group's points.

    Hulls of hashed parts of a group come first and the hull of their corners then, so that no task
    holds a whole group.
    """
    schema = f"{by} string, corner long, {x} double, {y} double"

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        h = hull(rows[[x, y]].to_numpy(float))
        return pd.DataFrame({by: rows[by].iloc[0], "corner": range(len(h)), x: h[:, 0], y: h[:, 1]})

    rows = points.select(F.col(by).cast("string").alias(by), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(f"`{x}` is not null and `{y}` is not null")
    some = rows.withColumn("__part", F.pmod(F.xxhash64(x, y), F.lit(parts))).groupBy(by, "__part").applyInPandas(corners, schema)
    return some.groupBy(by).applyInPandas(corners, schema)
