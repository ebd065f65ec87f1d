"""Entropies of traces, prefixes and blocks, in bits.

``flattened`` counts each variant once. The complexity is sequential and runs per log in Python, over one
case per variant and the order of traces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.model import EventLog, prefixes, step_hash, variants
from tracequarry.operators.counts import merged
from tracequarry.operators.statistics import entropy
from tracequarry.sources.files import cut

BLOCKS = (1, 3, 5)
NEIGHBOURS = (3, 5, 7)


def trace_entropy(log: EventLog) -> DataFrame:
    """eventropy_trace: entropy of the variants' distribution."""
    return entropy(variants(log), "n", ["log"]).withColumnRenamed("entropy", "eventropy_trace")


def prefix_entropy(log: EventLog) -> DataFrame:
    """eventropy_prefix over all non-empty prefixes, and flattened over those of each variant once."""
    one = log.traces.groupBy("log", "n_events", "v1", "v2").agg(F.min("case_id").alias("case_id"))
    rows = prefixes(log).join(one.select("log", "case_id", F.lit(1).alias("first")), ["log", "case_id"], "left")
    states = rows.groupBy("log", "pos", "p1", "p2").agg(F.count("*").alias("n"), F.count("first").alias("v"))
    both = entropy(states, "n", ["log"]).withColumnRenamed("entropy", "eventropy_prefix")
    return both.join(entropy(states, "v", ["log"]).withColumnRenamed("entropy", "eventropy_prefix_flattened"), "log")


def block_entropy(log: EventLog, most: int = max(BLOCKS)) -> DataFrame:
    """(log, k, entropy): entropy of the k-grams inside traces, for k up to ``most``.

    The last k activities of each event are lagged columns, so that a k-gram is an exact key.
    """
    order = Window.partitionBy("log", "case_id").orderBy("pos")
    last = [F.col("activity")] + [F.lag("activity", i).over(order) for i in range(1, most)]
    rows = log.events.select("log", "pos", F.array(*last).alias("last"))
    grams = rows.select("log", F.explode(F.sequence(F.lit(1), F.least(F.col("pos"), F.lit(most)).cast("int"))).alias("k"), "last").select("log", "k", F.slice("last", 1, F.col("k")).alias("gram"))
    return entropy(grams.groupBy("log", "k", "gram").agg(F.count("*").alias("n")), "n", ["log", "k"])


def block_features(log: EventLog) -> DataFrame:
    """eventropy_k_block_ratio_k = H_k / k and eventropy_k_block_diff_k = H_k - H_(k-1), with H_0 = 0; 0 where no k-gram is."""
    h = block_entropy(log)
    at = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("entropy"))), F.lit(0.0))
    return h.groupBy("log").agg(*(f for k in BLOCKS for f in ((at(k) / k).alias(f"eventropy_k_block_ratio_{k}"), (at(k) - (at(k - 1) if k > 1 else 0.0)).alias(f"eventropy_k_block_diff_{k}"))))


def sequences(log: EventLog) -> DataFrame:
    """One row per non-empty variant: its key, its activities as an array and its frequency ``n``."""
    one = log.traces.where("n_events > 0").groupBy("log", "n_events", "v1", "v2").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    one = one.select("log", "n_events", "v1", "v2", "n", F.col("seen.case_id").alias("case_id"))
    acts = log.events.join(one, ["log", "case_id"]).groupBy("log", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda s: s["activity"]).alias("activities"), *(F.first(c).alias(c) for c in ("n_events", "v1", "v2", "n")))
    return acts


def global_block_entropy(log: EventLog) -> DataFrame:
    """eventropy_global_block over all contiguous blocks of all traces, and flattened over those of each variant once."""
    one = log.traces.where("n_events > 0").groupBy("log", "n_events", "v1", "v2").agg(F.count("*").alias("n"), F.min("case_id").alias("case_id"))
    rows = log.events.select("log", "case_id", "pos", "activity").join(one.select("log", "case_id", "n"), ["log", "case_id"])
    # an event is the k-th of one block for each place that a block can start at; a block is the combined hashes up to it
    steps = rows.select("log", "case_id", "n", "activity", F.explode(F.sequence(F.lit(1).cast("long"), "pos")).alias("start"), "pos").withColumn("size", F.col("pos") - F.col("start") + 1)
    upto = Window.partitionBy("log", "case_id", "start").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    blocks = steps.select("log", "n", "size", *(F.bit_xor(step_hash(k, "size")).over(upto).alias(f"b{k}") for k in (1, 2)))
    counted = blocks.groupBy("log", "size", "b1", "b2").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    every = entropy(counted, "n", ["log"]).withColumnRenamed("entropy", "eventropy_global_block")
    return every.join(entropy(counted, "v", ["log"]).withColumnRenamed("entropy", "eventropy_global_block_flattened"), "log")


def phrases(symbols: Iterable) -> int:
    """The number of phrases of a Lempel-Ziv (1978) parsing."""
    nodes, at, count = {}, 0, 0
    for s in symbols:
        nxt = nodes.get((at, s))
        if nxt is None:
            count += 1
            nodes[at, s] = count
            at = 0
        else:
            at = nxt
    return count + (at != 0)


def lempel_ziv(log: EventLog) -> DataFrame:
    """eventropy_lempel_ziv: phrases * log2(symbols) / symbols of the log's traces in order of appearance, one after another; flattened with each variant once.

    The parsing reads a log's events one after another: a log's variants come together in one task,
    with its traces as ordered keys of variants.
    """

    def parse(variants: pd.DataFrame, traces: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(zip(variants["n_events"], variants["v1"], variants["v2"], strict=True), variants["activities"], strict=True))
        traces = traces.sort_values("turn")
        keys = list(zip(traces["n_events"], traces["v1"], traces["v2"], strict=True))
        out = {"log": [variants["log"].iloc[0]]}
        for name, order in (("eventropy_lempel_ziv", keys), ("eventropy_lempel_ziv_flattened", dict.fromkeys(keys))):
            size = sum(int(n) for n, _, _ in order)
            out[name] = [phrases(a for key in order for a in texts[key]) * math.log2(size) / size if size > 1 else 0.0]
        return pd.DataFrame(out)

    variants = sequences(log).select("log", "n_events", "v1", "v2", "activities")
    traces = log.traces.where("n_events > 0").withColumn("turn", F.row_number().over(Window.partitionBy("log").orderBy("seen"))).select(F.col("log").alias("of"), "n_events", "v1", "v2", "turn")
    return variants.groupBy("log").cogroup(traces.groupBy("of")).applyInPandas(parse, "log string, eventropy_lempel_ziv double, eventropy_lempel_ziv_flattened double")


def lettered(log: EventLog) -> DataFrame:
    """One row per non-empty variant: log, n_events, v1, v2, its frequency ``n`` and its activities as ``letters``, one character each."""
    one = log.traces.where("n_events > 0").groupBy("log", "n_events", "v1", "v2").agg(F.count("*").alias("n"), F.min("case_id").alias("case_id"))
    letter = F.decode(F.unhex(F.lpad(F.hex(F.row_number().over(Window.partitionBy("log").orderBy("activity")) + 0xFFFF), 8, "0")), "UTF-32")
    alphabet = log.events.select("log", "activity").distinct().withColumn("letter", letter)  # a log's different activities
    rows = log.events.select("log", "case_id", "pos", "activity").join(one.select("log", "case_id"), ["log", "case_id"]).join(alphabet, ["log", "activity"])
    texts = rows.groupBy("log", "case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("letters"))
    return one.join(texts, ["log", "case_id"]).drop("case_id")


def nearest_neighbours(log: EventLog, bound: int = 4) -> DataFrame:
    """eventropy_knn_k: the mean over traces of log2(N * d / k + 1), with d the edit distance to the k-th nearest other trace.

    A variant's copies are at distance 0. Variants meet those whose length differs by at most a bound on
    the distance; those that don't have enough neighbours within it go on with a bound four times as large.
    """
    most, key = max(NEIGHBOURS), ["log", "n_events", "v1", "v2"]
    variants = cut(lettered(log))
    longest = variants.agg(F.max("n_events")).first()[0] or 0
    others = variants.select("log", F.col("n_events").alias("size"), F.col("letters").alias("other"), F.col("n").alias("m"), F.col("v1").alias("o1"), F.col("v2").alias("o2"))

    def kth(k):
        step = lambda a, x: F.struct((a["upto"] + x["m"]).alias("upto"), F.when(a["d"].isNull() & (a["upto"] + x["m"] >= k), x["d"]).otherwise(a["d"]).alias("d"))
        return F.aggregate("found", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("d")), step)["d"].alias(f"d{k}")

    own = F.array(F.struct(F.lit(0).alias("d"), (F.col("n") - 1).alias("m")))
    settled, pending = [variants.where(F.col("n") > most).select("log", "n", *(F.lit(0).alias(f"d{k}") for k in NEIGHBOURS))], variants.where(F.col("n") <= most)
    while True:
        probes = pending.withColumn("off", F.explode(F.sequence(F.lit(-bound), F.lit(bound)))).withColumn("size", F.col("n_events") + F.col("off"))
        met = probes.join(others, ["log", "size"]).where("off <> 0 or v1 <> o1 or v2 <> o2").withColumn("d", F.levenshtein("letters", "other", bound)).where("d >= 0")
        near = met.groupBy(*key, "d").agg(F.sum("m").alias("m")).groupBy(*key).agg(F.collect_list(F.struct("d", "m")).alias("near"))
        judged = pending.join(near, key, "left").withColumn("found", F.array_sort(F.concat(own, F.coalesce("near", F.array().cast("array<struct<d:int,m:bigint>>")))))
        judged = cut(judged.select(*key, "n", "letters", *map(kth, NEIGHBOURS)))
        if bound >= longest:
            settled.append(judged.select("log", "n", *(f"d{k}" for k in NEIGHBOURS)))
            break
        enough = F.col(f"d{most}").isNotNull()
        settled.append(judged.where(enough).select("log", "n", *(f"d{k}" for k in NEIGHBOURS)))
        pending, bound = judged.where(~enough).select(*key, "n", "letters"), bound * 4
        if pending.isEmpty():
            break
    rows = reduce(lambda a, b: a.unionByName(b), settled)
    total = variants.groupBy("log").agg(F.sum("n").alias("total"))
    value = lambda k: F.coalesce(F.sum(F.col("n") * F.log2(F.col("total") * F.col(f"d{k}") / k + 1)), F.lit(0.0)) / F.max("total")
    return rows.join(total, "log").groupBy("log").agg(*(value(k).alias(f"eventropy_knn_{k}") for k in NEIGHBOURS))


def eventropies(log: EventLog) -> DataFrame:
    """All sixteen features."""
    return merged([trace_entropy(log), prefix_entropy(log), block_features(log), global_block_entropy(log), lempel_ziv(log), nearest_neighbours(log)])
