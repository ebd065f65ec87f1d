"""Exact top-k by inner product with vector-approximation files.

Vectors are integers, floor(scale * x). The approximation file is a table of its own: blocks of
vectors with one byte per component, the number of its cell, and the grid of the cells. A query's
product with the cells gives bounds of its scores from below and above. Of vectors that very many rows
share, only the rows that can be among a query's best are in it.

Queries are a table too, and are answered block by block; a block is all that the driver or a task
holds of them. The scan of the approximations keeps the vectors whose upper bound reaches the k-th
lower bound that a task has met; over all tasks, those that reach the k-th lower bound of all. Exact
vectors are then read by joins, in the order of the upper bounds: first k for each query, then, where
the k-th score is not certain yet, all those whose bound still reaches it.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id
or of another length than the query's. Ties go to the smaller id. Repeated rows are candidates each; a
query's own id is none; a query id that occurs more than once is one query, with the smallest of its
vectors. Scores beyond a long raise an error. Empty tables give an empty result. Other columns are not
read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm.common import cut, remove_folder, shared_folder

CELLS = "length int, ids binary, cells binary, low binary, width binary"
BOUNDS = "query_id long, vec_id long, low double, high double"
#: Vectors in a block of the approximation file.
BLOCK = 8192


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("x")).where("id is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(fine).select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def matrices(batch: pa.RecordBatch):
    """(ids, matrix) for each length of vector in a batch."""
    ids, lists = batch["id"].to_numpy(), batch["v"]
    lengths = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], flat[(ends[rows] - n)[:, None] + np.arange(n)]


def thinned(rows: DataFrame, k: int) -> DataFrame:
    """The rows that any query can have among its k best.

    Of equal vectors, only the k + 1 smallest ids can be (one may be the query's own), and of rows that
    repeat an id and its vector, k. So a vector that very many rows share costs a query no more than k + 1
    candidates; both limits are taken before rows move. Vectors are told apart by 128 bits of hashes.
    """
    name = [F.xxhash64(F.lit(seed), "v").alias(f"h{seed}") for seed in (0, 1)]
    hashed = rows.select("id", "v", *name)
    shared = cut(hashed.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") > k).select("h0", "h1"))
    if shared.isEmpty():
        return rows
    ids = hashed.join(shared, ["h0", "h1"], "left_semi").groupBy("h0", "h1", "id").agg(F.least(F.count("*"), F.lit(k)).alias("times"), F.first("v").alias("v"))
    least = ids.withColumn("place", F.row_number().over(Window.partitionBy("h0", "h1").orderBy("id"))).where(F.col("place") <= k + 1)
    few = cut(least.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy"))
    return hashed.join(shared, ["h0", "h1"], "left_anti").select("id", "v").unionByName(few)


def approximated(rows: DataFrame) -> DataFrame:
    """The approximation file: blocks of ids and cells, with the least value and the width of each component's cells."""

    def blocks(batches):
        held: dict[int, list] = {}

        def flush(length):
            parts = held.pop(length)
            ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)
            low = matrix.min(axis=0)
            width = np.maximum((matrix.max(axis=0) - low) / 256, 0.5)
            cell = np.minimum((matrix - low) // width, 255).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "cells": [cell.tobytes()], "low": [low.tobytes()], "width": [width.tobytes()]})

        for batch in batches:
            for ids, matrix in matrices(batch):
                length = matrix.shape[1]
                held.setdefault(length, []).append((ids, matrix))
                if sum(len(p[0]) for p in held[length]) >= BLOCK:
                    yield flush(length)
        for length in list(held):
            yield flush(length)

    return rows.mapInArrow(blocks, CELLS)


def bounded(queries: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of queries (rows) with the vectors in cells (columns).

    The product is taken in single precision over the cells' numbers; what it may be off by is added.
    """
    weights, size = queries * width, np.abs(queries) @ width
    middle = (queries @ low)[:, None] + (weights / 2).sum(axis=1)[:, None] + (weights.astype(np.float32) @ cell.astype(np.float32).T)
    slack = size / 2 + 1.0 + size * 256 * (len(low) + 2) * 2.0**-23 + (np.abs(queries) @ np.abs(low)) * 2.0**-40
    return middle - slack[:, None], middle + slack[:, None]


class Scan:
    """Scans blocks of the approximation file for a block of queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries.astype(float), k
        self.best = np.full((len(ids), k), -np.inf)  # the k highest lower bounds so far

    def candidates(self, ids: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray, rows: int = 128):
        """(query_id, vec_id, low, high) of the vectors that may be among the k best."""
        for at in range(0, len(self.ids), rows):
            mine = self.ids[at : at + rows]
            below, above = bounded(self.queries[at : at + rows], cell, low, width)
            own = mine[:, None] == ids[None]
            below[own] = above[own] = -np.inf
            k = min(self.k, len(ids))
            highest = np.partition(below, len(ids) - k, axis=1)[:, len(ids) - k :]
            self.best[at : at + rows] = np.sort(np.concatenate([self.best[at : at + rows], highest], axis=1), axis=1)[:, -self.k :]
            i, j = np.nonzero((above >= self.best[at : at + rows, :1]) & ~own)
            yield mine[i], ids[j], below[i, j], above[i, j]


def candidates(cells: DataFrame, ids: np.ndarray, vectors: list, k: int) -> tuple[DataFrame, object]:
    """The candidates (query_id, vec_id, low, high) of a block of queries, and the broadcast that holds the queries."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    shared = cells.sparkSession.sparkContext.broadcast({int(n): (ids[lengths == n], np.array([v for v in vectors if len(v) == n], np.int64)) for n in np.unique(lengths)})

    def scanned(batches):
        scans = {}
        for batch in batches:
            for row in batch.to_pylist():
                if (n := row["length"]) not in shared.value:
                    continue
                if n not in scans:
                    scans[n] = Scan(*shared.value[n], k)
                own = np.frombuffer(row["ids"], "<i8")
                for found in scans[n].candidates(own, np.frombuffer(row["cells"], np.uint8).reshape(len(own), n), np.frombuffer(row["low"]), np.frombuffer(row["width"])):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "low", "high"])

    return cells.mapInArrow(scanned, BOUNDS), shared


def survivors(found: DataFrame, k: int) -> DataFrame:
    """The candidates whose upper bound reaches the k-th lower bound of their query, with their place by upper bound."""
    each = Window.partitionBy("query_id")
    low = F.nth_value("low", k).over(each.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = found.withColumn("least", low).where("least is null or high >= least")
    return kept.select("query_id", "vec_id", "high", F.row_number().over(each.orderBy(F.desc("high"), "vec_id")).alias("place"))


def scored(wanted: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of pairs of ids, from the exact vectors; a row for each row of a repeated id."""
    pairs = wanted.select("query_id", "vec_id").distinct()
    asked = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    read = asked.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").where(F.size("q") == F.size("v"))
    return read.select("query_id", "vec_id", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id is divisible by ``every``.

    At most ``block`` queries are collected and broadcast at once; the results of a block are written to
    the shared folder before the next one is read.
    """
    spark, rows = vectors.sparkSession, integer_vectors(vectors, id_col, vector_col, scale)
    queries = cut(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    rows = thinned(rows, k)
    cells = cut(approximated(rows))
    n = max(1, -(-queries.count() // max(1, block // 2)))
    part = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n))
    while n > 1 and queries.groupBy(part).count().agg(F.max("count")).first()[0] > block:
        n *= 2
        part = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n))
    folder = f"{shared_folder(spark)}/top-k-{uuid.uuid4().hex}"
    kept = None
    for b in range(n):
        own = queries if n == 1 else queries.where(part == b)
        table = own.toArrow()
        found, shared = candidates(cells, table["id"].to_numpy(), table["v"].to_pylist(), k)
        kept = survivors(found, k)
        if n > 1:
            kept.write.mode("append").parquet(folder)
            shared.destroy()
    kept = cut(kept if n == 1 else spark.read.parquet(folder))
    if n > 1:
        remove_folder(spark, folder)
    first = cut(scored(kept.where(F.col("place") <= k), queries, rows))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = kept.where(F.col("place") > k).join(kth, "query_id").where("kth is null or high >= kth")
    # a vector of the first k may be repeated: its other rows were read with it
    rest = rest.join(first.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_anti")
    ranked = first.unionByName(scored(rest, queries, rows)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL; products of integers are exact in doubles here.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select * from (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s) where rank <= 10
"""
