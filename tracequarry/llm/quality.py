"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are binned. Shallow trees are boosted cyclically, one feature after another, on
the gradient of the logistic loss; their sum per feature is a lookup table over its bins. Then the
pairs of features that explain most of what is left get tables of their own the same way. A score
is the logistic function of the vectorised sum of the tables at a document's bins.

The fit uses at most ``max_rows`` labelled ids, those of smallest hash, a bounded sample on the driver;
of rows that repeat such an id, the one of smallest text hash teaches, and of conflicting labels of an
id the greatest. Scoring covers every whole text. Null and empty texts are scored like any other, with
zero features. Labels that are null, or whose id is null or has no document, teach nothing; with no
label at all every score is 0.5, with one class the smoothed share. Repeated rows are scored each.
Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import id_and_text, slices, texts_as_bytes

FEATURES = ("log_bytes", "letters", "capitals", "digits", "spaces", "breaks", "stops", "shouts", "bars", "symbols", "word_length", "stutter", "distinct", "top_word", "repeated_lines", "repeated_threes", "bare_words", "sentence_words")
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 symbol, 1 letter, 2 capital, 3 digit, 4 space, 5 line break, 6 stop, 7 shout, 8 bar, 9 control
for _bytes, _k in ((range(0x61, 0x7B), 1), (range(0x80, 0x100), 1), (range(0x41, 0x5B), 2), (range(0x30, 0x3A), 3), (b" \t", 4), (b"\n\r", 5), (b".,;:?'\"-()", 6), (b"!", 7), (b"|", 8), ([*range(9), *range(11, 13), *range(14, 32), 127], 9)):
    _CLASS[list(_bytes)] = _k


def features_of(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=10) / n
    words = text.split()
    w = max(1, len(words))
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    threes = set(zip(words, words[1:], words[2:], strict=False))
    lonely = sum(c for x, c in times.items() if not x[-1:].isalnum() and x[-1] < 128)
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    return [
        float(np.log1p(n)), *(float(kinds[k]) for k in (1, 2, 3, 4, 5, 6, 7, 8, 0)), n / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, len(times) / w, max(times.values(), default=0) / w,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(threes) / max(1, len(words) - 2) if len(words) > 2 else 0.0, lonely / w, w / (stops + 1),
    ]


class Model:
    """Bin edges and lookup tables; ``tables`` for one feature, ``pairs`` for two."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.coarse: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def raw(self, bins: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(bins[0]), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            out += table[b]
        for (i, j), table in self.pairs.items():
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def gain(g, h, ridge):
    return g * g / (h + ridge)


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain of the best split of a row of bins, and its place."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    value = gain(gl, hl, ridge) + gain(g.sum() - gl, h.sum() - hl, ridge) - gain(g.sum(), h.sum(), ridge)
    k = int(np.argmax(value))
    return float(value[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A step per bin: the bins are split greedily into at most ``leaves`` ranges."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        value, cut, k = max((*best_cut(g[a:b], h[a:b], ridge), k) for k, (a, b) in enumerate(parts))
        if value <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and steps of a tree that splits a grid by rows and each side by columns."""
    best, step = 0.0, np.zeros_like(g)
    whole = gain(g.sum(), h.sum(), ridge)
    for cut in range(1, len(g)):
        sides = [(slice(0, cut), g[:cut].sum(axis=0), h[:cut].sum(axis=0)), (slice(cut, None), g[cut:].sum(axis=0), h[cut:].sum(axis=0))]
        cuts = [best_cut(a, b, ridge) for _, a, b in sides]
        value = sum(c[0] + gain(a.sum(), b.sum(), ridge) for c, (_, a, b) in zip(cuts, sides, strict=True)) - whole
        if value > best:
            best, step = value, np.zeros_like(g)
            for (_, at), (rows, a, b) in zip(cuts, sides, strict=True):
                for cols in (slice(0, at), slice(at, None)):
                    if len(a[cols]):
                        step[rows, cols] = -a[cols].sum() / (b[cols].sum() + ridge)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 8, pair_rounds: int = 40, grid: int = 8, ridge: float = 1.0) -> Model:
    """Cyclic boosting of one-feature trees, then of the pairs with most gain."""
    share = (y.sum() + 1) / (len(y) + 2)
    columns = x.T if len(x) else np.zeros((len(FEATURES), 0))
    model = Model([np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in columns], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    raw = model.raw(at)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[k])
            step = rate * shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n), ridge)
            model.tables[k] += step
            raw += step[b]
    model.coarse = [(np.arange(len(t)) * grid // len(t)) for t in model.tables]
    rough = [c[b] for c, b in zip(model.coarse, at, strict=True)]
    sums = lambda i, j, v: np.bincount(rough[i] * grid + rough[j], v, grid * grid).reshape(grid, grid)
    g, h = slopes()
    ranked = sorted(combinations(range(len(at)), 2), key=lambda p: -pair_tree(sums(*p, g), sums(*p, h), ridge)[0])[:pairs]
    model.pairs = {p: np.zeros((grid, grid)) for p in ranked}
    for _ in range(pair_rounds):
        for i, j in ranked:
            g, h = slopes()
            step = rate * pair_tree(sums(i, j, g), sums(i, j, h), ridge)[1]
            model.pairs[i, j] += step
            raw += step[rough[i], rough[j]]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def with_features(rows: DataFrame) -> DataFrame:
    def made(batches):
        for batch in slices(batches):
            x = [features_of(t) for t in texts_as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return rows.mapInArrow(made, "id long, x array<double>")


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> Model:
    """A model of the labelled rows that aren't held out, at most max_rows of them."""
    known = labels.select(labels[label_id].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(remainder(F.col("id")) != 1).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(sample.select("id")), "id", "left_semi")
    rows = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.md5("text"))).alias("text"))
    found = with_features(rows).join(F.broadcast(sample), "id").select("id", "x", "y").orderBy("id").collect()
    return fit(np.array([r.x for r in found], float).reshape(-1, len(FEATURES)), np.array([r.y for r in found], float))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in slices(batches):
            x = np.array([features_of(t) for t in texts_as_bytes(batch["text"])], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold; no row moves between tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features_of((t or "").encode()) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(shared.value.score(x))

    return docs.where(score(docs[text_col].cast("string")) >= threshold)
