"""Generating event logs for target features: configuration space, process trees, play-out, search.

A trial is a configuration with a seed. Trees and traces are pure functions of (configuration, seed,
trace number), so that a task run again, or another partitioning, gives the same log. All trials of
a round are one event log, evaluated by the same plans as any other, and serve all tasks. The search
draws a Latin hypercube, then samples in boxes around each task's best trials, which shrink round by
round. It gives what the features need, not the same incumbents as other optimisers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.model import EventLog, from_positions
from tracequarry.plans.features import feature_table, long_form
from tracequarry.sources.files import cut

#: The space used when an experiment gives none.
DEFAULT_SPACE = {
    "mode": [5, 40], "sequence": [0.01, 1], "choice": [0.01, 1], "parallel": [0.01, 1], "loop": [0.01, 1], "silent": [0.01, 1],
    "lt_dependency": [0.01, 1], "num_traces": [100, 1001], "duplicate": [0], "or": [0],
}
WHOLE = ("mode", "num_traces")
OPERATORS = ("sequence", "choice", "parallel", "loop", "or")
CONFIG_SCHEMA = "trial string, seed long, " + ", ".join(f"`{p}` {'int' if p in WHOLE else 'double'}" for p in DEFAULT_SPACE)
STEP_SECONDS = 1000


def config_space(space: dict | None = None) -> list[tuple[str, float, float, bool, bool]]:
    """(param, lo, hi, is_int, is_const) of each parameter; those not given are constant at their default's start."""
    given = space or DEFAULT_SPACE
    out = []
    for name, default in DEFAULT_SPACE.items():
        bounds = given.get(name, default[:1])
        out.append((name, float(bounds[0]), float(bounds[-1]), name in WHOLE, len(bounds) == 1 or bounds[0] == bounds[-1]))
    return out


def space_table(spark: SparkSession, space: dict | None = None) -> DataFrame:
    return spark.createDataFrame(config_space(space), "param string, lo double, hi double, is_int boolean, is_const boolean")


def drawn(space: list[tuple], n: int, rng: random.Random) -> list[dict]:
    """n configurations as a Latin hypercube: each parameter's range is cut into n strata, each used once."""
    columns = {}
    for name, lo, hi, whole, _ in space:
        strata = [(i + rng.random()) / n for i in range(n)]
        rng.shuffle(strata)
        columns[name] = [int(lo + s * (hi - lo + 1)) if whole else lo + s * (hi - lo) for s in strata]
        if whole:
            columns[name] = [min(v, int(hi)) for v in columns[name]]
    return [{name: columns[name][i] for name in columns} for i in range(n)]


def around(space: list[tuple], best: dict, width: float, n: int, rng: random.Random) -> list[dict]:
    """n configurations in a box around one, clipped to the space."""
    boxes = []
    for name, lo, hi, whole, const in space:
        half = (hi - lo) * width / 2
        boxes.append((name, max(lo, best[name] - half), min(hi, best[name] + half), whole, const))
    return drawn(boxes, n, rng)


@dataclass
class Node:
    """A process tree: an operator over children, or a leaf with a label (None: silent)."""

    op: str | None = None
    label: str | None = None
    children: list[Node] = field(default_factory=list)


def label_of(i: int) -> str:
    """a .. z, aa, ab, ..."""
    out = ""
    while True:
        out = chr(97 + i % 26) + out
        i = i // 26 - 1
        if i < 0:
            return out


def process_tree(config: dict, seed: int) -> Node:
    """A random tree with ``mode`` visible activities; operators are drawn by their probabilities.

    ``silent`` is the chance of a silent branch in a choice or loop, ``duplicate`` that of a label
    used again. ``lt_dependency`` is the chance that a nested choice repeats the branch that the
    choice above it took.
    """
    rng = random.Random(f"tree-{seed}")
    weights = [max(0.0, float(config[o])) for o in OPERATORS]
    if not any(weights):
        weights[0] = 1.0
    labels: list[str] = []

    def leaf() -> Node:
        if labels and rng.random() < float(config["duplicate"]):
            return Node(label=rng.choice(labels))
        labels.append(label_of(len(labels)))
        return Node(label=labels[-1])

    def grow(n: int) -> Node:
        if n <= 1:
            return leaf()
        op = rng.choices(OPERATORS, weights)[0]
        left = rng.randint(1, n - 1)
        node = Node(op=op, children=[grow(left), grow(n - left)])
        if op == "choice" and rng.random() < float(config["silent"]):
            node.children.append(Node())
        if op == "loop" and rng.random() < float(config["silent"]):
            node.children = [Node(op="sequence", children=node.children), Node()]
        return node

    return grow(max(1, int(config["mode"])))


def adjacency(tree: Node) -> list[tuple[int, int | None, int, str | None, str | None]]:
    """(id, parent, pos, op, label) of the nodes, from the root."""
    out, queue = [], [(tree, None, 0)]
    while queue:
        node, parent, pos = queue.pop(0)
        out.append((len(out), parent, pos, node.op, node.label))
        queue += [(c, out[-1][0], i) for i, c in enumerate(node.children)]
    return out


def played(tree: Node, rng: random.Random, dependency: float = 0.0, again: float = 0.5) -> list[str]:
    """One trace of a tree."""

    def interleaved(parts: list[list[str]]) -> list[str]:
        turns = [i for i, p in enumerate(parts) for _ in p]
        rng.shuffle(turns)
        steps = [iter(p) for p in parts]
        return [next(steps[i]) for i in turns]

    def run(node: Node, branch: int | None) -> list[str]:
        if node.op is None:
            return [node.label] if node.label is not None else []
        kids = node.children
        if node.op == "sequence":
            return [a for c in kids for a in run(c, branch)]
        if node.op == "choice":
            k = branch if branch is not None and branch < len(kids) and rng.random() < dependency else rng.randrange(len(kids))
            return run(kids[k], k)
        if node.op == "parallel":
            return interleaved([run(c, branch) for c in kids])
        if node.op == "or":
            chosen = [c for c in kids if rng.random() < 0.5] or [rng.choice(kids)]
            return interleaved([run(c, branch) for c in chosen])
        out = run(kids[0], branch)
        while rng.random() < again:
            out += run(kids[1], branch) + run(kids[0], branch)
        return out

    return run(tree, None)


def play_out(trials: DataFrame, traces_per_task: int = 1000) -> EventLog:
    """The trials (CONFIG_SCHEMA) as an event log whose logs are the trials.

    A trial's traces are dealt out in ranges, so that a large trial isn't one task; event j of each
    trace happens j times STEP_SECONDS after the epoch.
    """
    last = F.floor((F.greatest(F.col("num_traces"), F.lit(1)) - 1) / traces_per_task).cast("int")
    shares = trials.withColumn("share", F.explode(F.sequence(F.lit(0), last)))
    shares = shares.repartition(F.xxhash64("trial", "share"))

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch.to_dict("records"):
                tree, rows = process_tree(c, c["seed"]), []
                for t in range(c["share"] * traces_per_task, min((c["share"] + 1) * traces_per_task, c["num_traces"])):
                    acts = played(tree, random.Random(f"trace-{c['seed']}-{t}"), float(c["lt_dependency"]))
                    rows += [(c["trial"], str(t), t, j, a) for j, a in enumerate(acts, 1)] or [(c["trial"], str(t), t, 0, None)]
                yield pd.DataFrame(rows, columns=["log", "case_id", "t", "pos", "activity"])

    rows = shares.mapInPandas(traces, "log string, case_id string, t long, pos long, activity string").withColumn("place", F.array("t"))
    events = rows.where("pos > 0").withColumn("ts", F.timestamp_seconds(F.col("pos") * STEP_SECONDS))
    return from_positions(events, rows.where("pos = 0"))


#: Fixed value: what configurations call the play-out of process trees; and a plain name for it.
METHODS = ("PTLG", "play_out")


def simulated(trials: DataFrame, method: str = METHODS[0]) -> EventLog:
    if method not in METHODS:
        raise NotImplementedError(f"simulation method {method}")
    return play_out(trials)


def trial_table(spark: SparkSession, configs: list[dict], seed: int, name: str = "trial") -> DataFrame:
    rows = [(f"{name}_{i}", seed, *(int(c[p]) if p in WHOLE else float(c[p]) for p in DEFAULT_SPACE)) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def costs(targets: DataFrame, achieved: DataFrame) -> DataFrame:
    """(log, trial, cost, target_similarity) of each task and each trial with one of its features.

    Both are long tables; they meet on the feature, with the targets of the tasks broadcast if Spark
    finds them small.
    """
    off = F.col("t.value") - F.col("a.value")
    met = targets.alias("t").join(achieved.select(F.col("log").alias("trial"), "feature", "value").alias("a"), F.col("t.feature") == F.col("a.feature"))
    return met.groupBy(F.col("t.log").alias("log"), "trial").agg(F.avg(F.abs(off)).alias("cost"), (1 / (1 + F.sqrt(F.sum(off * off)))).alias("target_similarity"))


def surrogate(x: np.ndarray, y: np.ndarray):
    """A Gaussian-process regression: a function from rows of x to the mean of y's columns and a standard deviation, in units of y's."""
    centre, spread = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-9)
    apart = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=-1)
    scale = max(float(np.median(apart(x, x))), 1e-9)
    kernel = lambda a, b: np.exp(-apart(a, b) / scale)
    inverse = np.linalg.inv(kernel(x, x) + 0.05 * np.eye(len(x)))
    weights = inverse @ ((y - centre) / spread)

    def predict(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = kernel(at, x)
        return centre + spread * (k @ weights), np.sqrt(np.maximum(1 - ((k @ inverse) * k).sum(axis=1), 0))[:, None] * spread

    return predict


def proposed(bounds: list[tuple], tried: list[tuple[dict, dict]], tasks: list[dict], features: list[str], n: int, rng: random.Random, boldness: float = 0.5) -> list[dict]:
    """n configurations whose predicted features come closest to some task's targets, in turn; what is uncertain counts as closer."""
    free = [b for b in bounds if not b[4] and b[2] > b[1]]
    scaled = lambda configs: np.array([[(c[name] - lo) / (hi - lo) for name, lo, hi, _, _ in free] for c in configs], float).reshape(len(configs), -1)
    known = [(c, f) for c, f in tried if all(f.get(k) is not None for k in features)]
    if len(known) < 3 or not free or not tasks:
        return drawn(bounds, n, rng)
    candidates = drawn(bounds, 1024, rng)
    for task in tasks:
        wanted = {k: v for k, v in task.items() if v is not None}
        best = min(known, key=lambda t: sum(abs(t[1][k] - v) for k, v in wanted.items()))[0]
        candidates += around(bounds, best, 0.25, 64, rng)
    mean, doubt = surrogate(scaled([c for c, _ in known]), np.array([[f[k] for k in features] for _, f in known], float))(scaled(candidates))
    ranked = []
    for task in tasks:
        at = [features.index(k) for k, v in task.items() if v is not None]
        goal = np.array([task[features[k]] for k in at], float)
        ranked.append(np.argsort(np.maximum(np.abs(mean[:, at] - goal) - boldness * doubt[:, at], 0).mean(axis=1) + 1e-6 * np.abs(mean[:, at] - goal).mean(axis=1), kind="stable"))
    order = dict.fromkeys(int(r[k]) for k in range(min(n, len(candidates))) for r in ranked)
    return [candidates[i] for i in list(order)[:n]]


def search(spark: SparkSession, targets: DataFrame, space: dict | None = None, n_trials: int = 50, rounds: int = 3, seed: int = 10, method: str = METHODS[0], most_tasks: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(log, trial, cost, target_similarity) of the best trial of each task, and the trials' configurations.

    Bayesian optimisation in rounds: a Latin hypercube first, then configurations that a Gaussian process
    over all trials so far expects to come close to the tasks. All trials of a round are evaluated at once.
    ``targets`` is a wide table of tasks. What comes to the driver is the features of ``n_trials`` trials
    and, as goals of the proposals, at most ``most_tasks`` tasks; all tasks are compared with all trials.
    """
    from functools import reduce

    bounds, rng = config_space(space), random.Random(seed)
    features = [c for c in targets.columns if c != "log"]
    wanted = cut(long_form(targets))
    goals = [r.asDict() for r in targets.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features)).orderBy(F.xxhash64(*features), *features).limit(most_tasks).collect()]
    per_round = max(1, n_trials // rounds)
    known: dict[str, dict] = {}
    tried: list[tuple[dict, dict]] = []
    found: list[DataFrame] = []
    for r in range(rounds):
        configs = proposed(bounds, tried, goals, features, per_round, rng) if r else drawn(bounds, per_round, rng)
        names = {f"r{r}_{i}": c for i, c in enumerate(configs)}
        known |= names
        achieved = cut(feature_table(simulated(trial_table(spark, configs, seed, f"r{r}"), method), features))
        tried += [(names[row["log"]], row.asDict()) for row in achieved.orderBy("log").collect()]
        found.append(costs(wanted, long_form(achieved)))
    every = reduce(lambda a, b: a.unionByName(b), found)
    best = every.groupBy("log").agg(F.min_by(F.struct("trial", "cost", "target_similarity"), F.struct("cost", "trial")).alias("b")).select("log", "b.*")
    rows = [(t, seed, *(int(c[p]) if p in WHOLE else float(c[p]) for p in DEFAULT_SPACE)) for t, c in known.items()]
    return best, spark.createDataFrame(rows, CONFIG_SCHEMA)


def generate(spark: SparkSession, targets: DataFrame, **options) -> tuple[EventLog, DataFrame]:
    """The event logs of the best trials, named by task, and (log, trial, cost, target_similarity, configuration)."""
    best, configs = search(spark, targets, **options)
    chosen = cut(best.join(configs, "trial"))
    log = play_out(chosen.drop("trial", "cost", "target_similarity").withColumnRenamed("log", "trial").select(*(c.name for c in spark.createDataFrame([], CONFIG_SCHEMA).schema)))
    return log, chosen
