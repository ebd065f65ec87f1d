"""Suffix-array dedup of byte strings, by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts in a document of smaller id is
removed, judged on the input. Candidate windows meet by the exchange of ``repeats``. Whole copies
are known by their hash before, and only one of them sends windows. In a bucket, suffixes are sorted by a mergesort whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes, in logarithmic steps; neighbours that extend over the
whole window are then compared byte by byte, so that a collision of hashes decides nothing.

Null texts are empty. Rows with a null id are returned whole and remove nothing, since nothing says
whose id is smaller. Rows with the same id never remove each other's bytes. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import BYTE_VALUES, U64, Chunk, id_and_text, powers, ranges
from tracequarry.llm.repeats import Contexts, Repeats, full

#: Contexts of one key that are sorted together: about 1 MB of text and 200,000 suffixes.
HOT_CONTEXTS = 16_384
SCHEMA = "doc_id long, n_bytes long, spans array<long>, kept binary"


class Suffixes:
    """Prefix hashes of a buffer of short strings, and the comparisons they allow."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        local = ranges(np.zeros(len(lengths), np.int64), lengths)
        self.data, self.local = data, local
        self.sums = np.zeros(len(data) + 1, U64)
        most = int(lengths.max(initial=0)) + 1
        np.cumsum(BYTE_VALUES[data] * powers(most)[local], dtype=U64, out=self.sums[1:])
        self.scale = powers(most)  # multiplies the hash that starts earlier up to the later start

    def equal(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """Whether n bytes from x and y have equal hashes."""
        a, b = self.local[x], self.local[y]
        hx, hy = self.sums[x + n] - self.sums[x], self.sums[y + n] - self.sums[y]
        return hx * self.scale[np.maximum(b - a, 0)] == hy * self.scale[np.maximum(a - b, 0)]

    def extension(self, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
        """The common extension of the suffixes at x and y, up to limit bytes, by binary search."""
        out = np.zeros(len(x), np.int64)
        step = 1 << (limit.bit_length() - 1)
        while step:
            rows = np.flatnonzero(out + step <= limit)
            rows = rows[self.equal(x[rows] + out[rows], y[rows] + out[rows], step)]
            out[rows] += step
            step >>= 1
        return out

    def below(self, x: np.ndarray, y: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at x sorts before that at y; where or_equal, also if they are equal."""
        n = self.extension(x, y, limit)
        ends = n == limit
        at = np.where(ends, 0, n)
        return np.where(ends, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, at: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
        """The suffixes at ``at`` sorted within each group (given in order of groups): a bottom-up mergesort of all groups at once."""
        order = at.copy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[edges, len(group)])
        first, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
        rank = np.arange(len(at)) - first
        width = 1
        while width < sizes.max(initial=0):
            rows = np.flatnonzero(size > width)
            base = first[rows] + rank[rows] // (2 * width) * (2 * width)
            left = rank[rows] // width % 2 == 0
            end = first[rows] + size[rows]
            other = np.where(left, np.minimum(base + width, end), base)
            lo, hi = other.copy(), np.where(left, np.minimum(base + 2 * width, end), base + width)
            own = order[rows]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.below(order[mid], own[open_], limit, ~left[open_])
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            start = np.where(left, base, base + width)
            order[base + (rows - start) + (lo - other)] = own
            width *= 2
        return order

    def classes(self, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffixes, and for each whether it equals the one before it over limit bytes, byte by byte."""
        order = self.sort(at, group, limit)
        same = np.zeros(len(order), bool)
        rows = np.flatnonzero(group[1:] == group[:-1]) + 1
        rows = rows[self.extension(order[rows - 1], order[rows], limit) == limit]
        x, y, good = order[rows - 1], order[rows], np.ones(len(rows), bool)
        for k in range(limit):  # collisions end here
            good &= self.data[x + k] == self.data[y + k]
        same[rows[good]] = True
        return order, same


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and group numbers in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.cumsum(new)


def least_of_class(suffixes: Suffixes, at: np.ndarray, group: np.ndarray, limit: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, the least owner of those equal to it, and the class number."""
    order, same = suffixes.classes(at, group, limit)
    back = np.argsort(at, kind="stable")
    rows = back[np.searchsorted(at, order, sorter=back)]  # starts are distinct
    number = np.cumsum(~same) - 1
    least = np.minimum.reduceat(owner[rows], np.flatnonzero(~same))[number]
    out, classes = np.empty_like(owner), np.empty_like(number)
    out[rows], classes[rows] = least, number
    return out, classes


def decide(length, key, anchor, count, least, places, lengths, data):
    """Masks of windows that start in a document of smaller id, for the places in the least document and in others."""
    suffixes, begin = Suffixes(data, lengths), np.cumsum(lengths) - lengths
    lowest, numbers = np.empty_like(least), np.empty(len(least), np.int64)
    used = 0
    for n in np.unique(lengths):  # whole contexts first: equal ones are one
        rows = np.flatnonzero(lengths == n)
        order, group = grouped(key[rows], anchor[rows])
        rows = rows[order]
        lowest[rows], classes = least_of_class(suffixes, begin[rows], group, int(n), least[rows])
        numbers[rows] = classes + used
        used += int(classes.max(initial=-1)) + 1
    everything = full(count)
    copies = least > lowest
    # one context stands for each class; its windows meet those of other contexts with the same key
    firsts = np.flatnonzero(~copies)
    _, at = np.unique(numbers[firsts], return_index=True)
    firsts = firsts[at]
    _, which, many = np.unique(key[firsts], return_inverse=True, return_counts=True)
    firsts = firsts[many[which] > 1]
    own = np.zeros(len(key), U64)
    if len(firsts):
        windows = ranges(begin[firsts], count[firsts])
        step = ranges(np.zeros(len(firsts), np.int64), count[firsts])
        source = np.repeat(firsts, count[firsts])
        order, group = grouped(key[source], step - anchor[source])
        windows, step, source = windows[order], step[order], source[order]
        twins = np.bincount(group)[group] > 1
        windows, step, source, group = windows[twins], step[twins], source[twins], group[twins]
        if len(windows):
            low, _ = least_of_class(suffixes, windows, group, length, least[source])
            hit = low < least[source]
            masks = np.zeros(used, U64)
            np.bitwise_or.at(masks, numbers[source[hit]], U64(1) << step[hit].astype(U64))
            own = masks[numbers]
    return np.where(copies, everything, own), everything


def byte_symbols(chunk: Chunk):
    return chunk.bytes, chunk.ends, None


def byte_spans(contexts: Contexts, _):
    return contexts.start, contexts.start + contexts.count + contexts.length - 1


def runs(covered: np.ndarray) -> np.ndarray:
    """[first, end) of each run of true entries, flattened."""
    return np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))


def removed(chunk: Chunk, ends: np.ndarray, _, covered: np.ndarray) -> pa.Table:
    spans, kept = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        part = covered[a:b]
        spans.append(runs(part).tolist() if part.any() else [])
        kept.append((chunk.bytes[a:b][~part] if spans[-1] else chunk.bytes[a:b]).tobytes())
    return pa.table({"doc_id": chunk.column, "n_bytes": pa.array(np.diff(ends), pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, [first, end) flattened), kept (the other bytes) of every row."""
    rows = id_and_text(docs, id_col, text_col)
    return Repeats(length, max(1, length // 2 - 1), byte_symbols, byte_spans, lambda x, y: False, True, decide, removed, SCHEMA, hot_contexts).run(rows, chunk_bytes)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, for strings of 50 bytes; texts are read as hex digits, in pieces that overlap.
SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
t as (select r, doc_id, n, base, substring(h, 2 * base + 1, 2 * 305) as t from (select r, doc_id, n, h, unnest(range(0, n - 49, 256)) as base from d where doc_id is not null and n >= 50)),
w as (select r, doc_id, base + o as i, substring(t, 2 * o + 1, 100) as s from (select r, doc_id, base, t, unnest(range(0, least(256, n - 49 - base))) as o from t)),
m as (select s, min(doc_id) as least from w group by s having min(doc_id) < max(doc_id)),
g as (select r, i, lag(i) over (partition by r order by i) as before from w join m using (s) where least < doc_id),
s as (select r, min(i) as a, max(i) + 50 as b from (select r, i, sum(case when before + 50 >= i then 0 else 1 end) over (partition by r order by i) as k from g) group by r, k),
e as (select s.r, a, b, coalesce(lag(b) over (partition by s.r order by a), 0) as start, substring(h, 2 * coalesce(lag(b) over (partition by s.r order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by s.r order by a), 0))) as kept from s join d using (r)),
k as (select r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(kept, '' order by a) as kept, max(b) as stop from e group by r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(case when k.r is null then h else kept || substring(h, 2 * stop + 1) end)) as kept_sha256
from d left join k using (r)
"""


def brute_force(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple]:
    """The digest rows from a map of every window to its least document; for tests."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    least: dict[bytes, int] = {}
    for d, t in texts:
        for k in range(len(t) - length + 1 if d is not None else 0):
            w = t[k : k + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1 if d is not None else 0):
            if least[t[k : k + length]] < d:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), len(runs(gone)) // 2, hashlib.sha256(kept).hexdigest()))
    return out
