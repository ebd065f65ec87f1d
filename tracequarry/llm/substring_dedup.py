"""Substring dedup with suffix automata of reference shards.

Every word covered by a window of ``length`` consecutive words that also starts anywhere else is
removed, judged on the input. Candidate windows meet by the exchange of ``repeats``; a bucket is a
reference shard. A suffix automaton of the shard's contexts holds, per state, how often its strings
occur. Contexts are streamed through it for matching statistics: where the matched length reaches
the threshold, the state that holds the last ``length`` words tells whether the window occurs
again, and maximal runs of such windows are removed. A shard's automaton is built in pieces of keys,
so that its memory is bounded.

Null texts have no words. Rows with a null id keep it. Repeated rows are copies of each other, so
their windows recur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import U64, Chunk, id_and_text, word_hashes, word_spans
from tracequarry.llm.repeats import Contexts, Repeats
from tracequarry.llm.suffix_dedup import runs

SCHEMA = "doc_id long, n_words long, spans array<long>, kept string"
#: Words in one automaton, more only if the contexts of one key have more.
AUTOMATON_WORDS = 100_000
#: Contexts of one key that share an automaton: about as many words.
HOT_CONTEXTS = 2048


class Automaton:
    """A suffix automaton of weighted strings of symbols; strings are kept apart by starting anew at the root."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def add(self, symbols: list, weight: int) -> None:
        nexts, link, length, weights = self.next, self.link, self.length, self.weight
        last = 0
        for c in symbols:
            q = nexts[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                weights[last] += weight
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            weights.append(weight)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.weight.append(0)
        link[q] = new
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = link[p]
        return new

    def count(self) -> None:
        """Carries the weight of each state to its suffixes."""
        weight, link = self.weight, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if link[s] > 0:
                weight[link[s]] += weight[s]

    def recurring(self, symbols: list, least: int) -> int:
        """A mask of the windows of ``least`` symbols that occur with weight 2 or more."""
        nexts, link, length, weight = self.next, self.link, self.length, self.weight
        state = matched = mask = 0
        for end, c in enumerate(symbols, 1 - least):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            if c in nexts[state]:
                state, matched = nexts[state][c], matched + 1
            if matched >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    matched = length[state]
                if weight[state] > 1:
                    mask |= 1 << end
        return mask


def decide(length, key, anchor, count, least, places, lengths, data):
    """Masks of windows that occur more than once, equal for all places of a context."""
    ends, raw = np.cumsum(lengths), data.tobytes()
    own = np.zeros(len(key), U64)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True]).tolist()
    first, last, times, order = (ends - lengths).tolist(), ends.tolist(), places.tolist(), order.tolist()
    shard: list[tuple[int, list[bytes]]] = []

    def settle():
        automaton = Automaton()
        for i, words in shard:
            automaton.add(words, times[i])
        automaton.count()
        for i, words in shard:
            own[i] = automaton.recurring(words, length)
        shard.clear()

    size = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1 or times[order[a]] > 1:  # a context that is alone has no window twice: its windows start at different places of one anchor
            for i in order[a:b]:
                shard.append((i, raw[first[i] : last[i]].split()))
                size += len(shard[-1][1])
            if size > AUTOMATON_WORDS:
                settle()
                size = 0
    settle()
    return own, own


def word_symbols(chunk: Chunk):
    starts, stops, ends = word_spans(chunk.bytes, chunk.ends)
    return word_hashes(chunk.bytes, starts, stops), ends, (starts, stops)


def word_byte_spans(contexts: Contexts, extra):
    starts, stops = extra
    return starts[contexts.start], stops[contexts.start + contexts.count + contexts.length - 2]


def removed(chunk: Chunk, ends: np.ndarray, extra, covered: np.ndarray) -> pa.Table:
    texts = chunk.bytes
    spans, kept = [], []
    for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        words = texts[chunk.ends[d] : chunk.ends[d + 1]].tobytes().split()
        part = covered[a:b]
        spans.append(runs(part).tolist() if part.any() else [])
        kept.append(b" ".join(w for w, gone in zip(words, part.tolist(), strict=True) if not gone) if spans[-1] else b" ".join(words))
    return pa.table({"doc_id": chunk.column, "n_words": pa.array(np.diff(ends), pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, spans (removed ranges of words, [first, end) flattened), kept (the other words, joined by a space) of every row."""
    rows = id_and_text(docs, id_col, text_col)
    return Repeats(length, max(1, (length + 1) // 3), word_symbols, word_byte_spans, lambda x, y: x.split() == y.split(), False, decide, removed, SCHEMA, hot_contexts).run(rows, chunk_bytes)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    pairs = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    gone = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, for windows of 35 words.
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select r, i, array_to_string(w[i:i + 34], ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from d)),
c as (select s from x group by s having count(*) > 1),
p as (select distinct r, unnest(range(i, i + 35)) as k from x join c using (s)),
k as (select d.r, d.k, d.word, p.k is null as kept from (select r, unnest(w) as word, generate_subscripts(w, 1) as k from d) d left join p on p.r = d.r and p.k = d.k)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join (select r, count_if(not kept) as n, string_agg(word, ' ' order by k) filter (where kept) as t from k group by r) g on g.r = d.r
"""


def brute_force(docs: list[tuple[int, str | None]], length: int = 35) -> list[tuple]:
    """The digest rows from a count of every window; for tests."""
    import re

    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    times = Counter(tuple(w[k : k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = []
    for d, w in texts:
        gone = set()
        for k in range(len(w) - length + 1):
            if times[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
