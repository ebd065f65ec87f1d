"""Where fixed-length windows of symbols recur across a corpus: the exchange that op 2 and op 6 share.

A window of L symbols is anchored at its least k-gram hash, which depends on the window alone, so
that equal windows have equal anchors at equal places. Consecutive windows with one anchor form a
context. Three rounds over chunks of documents:

1. Each chunk sends its distinct anchor keys; the buckets of keys answer which occur in more chunks.
2. Each chunk sends the distinct contexts of shared keys to the keys' buckets, where an operator's
   own method decides which windows recur. Keys with very many contexts are split: there each window is
   a context of its own and goes where its own hash says, so that no group grows with the
   corpus; equal contexts are merged before they are sent, compared byte by byte.
3. Each chunk applies the answers to its whole texts.

A row is a packed array of what one chunk sends to one bucket. A key names its bucket by a hash of its
own, since keys are minima and so small numbers. Buckets are as many as their memory asks for, and some
at least, so that rows grow in proportion to the corpus until buckets do, and never beyond one per context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import BYTE_VALUES, U64, Chunk, chunked, cut, deltas, gram_hashes, pack, powers, prefix_sums, ranges, scramble, sliding_min, text_bytes, undeltas, unpack

BLOB = "chunk long, bucket long, data binary"
#: Text whose keys, or contexts, one bucket holds on average; and buckets there are at least.
KEY_BUCKET, CONTEXT_BUCKET, LEAST_BUCKETS = 32 << 20, 8 << 20, 64
#: Windows of a context, which a mask of 64 bits can tell apart.
MOST_WINDOWS = 63
#: Contexts that are judged together, more only if one key has more.
PIECE = 4096


def hashed(values: np.ndarray) -> np.ndarray:
    """Symbols as random values: bytes by a table, anything else is hashed already."""
    return BYTE_VALUES[values] if values.dtype == np.uint8 else values


class Contexts:
    """Runs of windows with one anchor: first window, number of windows, anchor's place, key, content hash."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, length: int, k: int, block: int = 1 << 16):
        n = len(values) - length + 1
        found = [[] for _ in range(5)]
        for at in range(0, n, block):
            self._block(values, ends, at, min(at + block, n), length, k, found)
        kinds = (np.int64, np.int64, np.int64, U64, U64)
        self.start, self.count, self.anchor, self.key, self.content = (np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, kinds, strict=True))
        self.length = length

    @staticmethod
    def _block(values, ends, at, stop, length, k, found) -> None:
        inner = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, stop - 1 + length)]
        crossing = np.zeros(stop - at + 1, np.int32)  # windows that hold a document's end
        np.add.at(crossing, np.maximum(inner - length + 1 - at, 0), 1)
        np.add.at(crossing, np.minimum(inner - at, stop - at), -1)
        ok = np.cumsum(crossing[:-1]) == 0
        if not ok.any():
            return
        part = hashed(values[at : stop - 1 + length])
        sums = prefix_sums(part)
        inverse = powers(len(part) + 1, inverse=True)
        grams = scramble((sums[k:] - sums[:-k]) * inverse[: len(part) - k + 1])
        mask = U64((1 << 20) - 1)
        least = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=U64), length - k + 1)
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(ok & np.r_[True, (place[1:] != place[:-1]) | ~ok[:-1]])
        if not len(first):
            return
        change = np.flatnonzero(np.r_[(place[1:] != place[:-1]) | (ok[1:] != ok[:-1]), True])
        last = change[np.searchsorted(change, first)]
        if (pieces := (last - first) // MOST_WINDOWS + 1).max() > 1:
            first, last = np.repeat(first, pieces) + ranges(np.zeros(len(pieces), np.int64), pieces) * MOST_WINDOWS, np.repeat(last, pieces)
            last = np.minimum(last, first + MOST_WINDOWS - 1)
        count = last - first + 1
        end = last + length
        content = scramble((sums[end] - sums[first]) * inverse[first])
        for f, x in zip(found, (at + first, count, place[first] - first, grams[place[first]], content), strict=True):
            f.append(x)

    def take(self, rows: np.ndarray) -> "Contexts":
        out = object.__new__(Contexts)
        out.length = self.length
        for name in ("start", "count", "anchor", "key", "content"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def by_window(self, rows: np.ndarray, values: np.ndarray) -> "Contexts":
        """The contexts of the rows as one context per window, keyed by the window's own hash."""
        out = object.__new__(Contexts)
        out.length = self.length
        out.start = ranges(self.start[rows], self.count[rows])
        out.count, out.anchor = np.ones(len(out.start), np.int64), np.zeros(len(out.start), np.int64)
        out.content = np.zeros(len(out.start), U64)
        for at in range(0, len(out.start), 1 << 16):  # starts ascend; each piece hashes what it spans
            piece = out.start[at : at + (1 << 16)]
            for lo, hi in _stretches(piece, self.length):
                a, b = piece[lo], piece[hi - 1] + self.length
                out.content[at + lo : at + hi] = gram_hashes(hashed(values[a:b]), self.length)[piece[lo:hi] - a]
        out.key = scramble(out.content ^ U64(0x5851F42D4C957F2D))
        return out


def _stretches(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of ascending starts whose windows lie close together."""
    cuts = np.flatnonzero(np.diff(starts) > 64 * length) + 1
    edges = np.r_[0, cuts, len(starts)]
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each evenly spread key: equal ranges, so that sorted keys of a bucket lie together."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def spread_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, whatever the keys' distribution."""
    return buckets_of(scramble(keys ^ U64(0x2545F4914F6CDD1D)), buckets)


def bucket_count(total_bytes: int, bytes_each: int) -> int:
    return max(LEAST_BUCKETS, -(-total_bytes // bytes_each))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, rows) of a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = np.r_[0, cuts, len(bucket)] if len(bucket) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


def chunk_number(key) -> int:
    return key[0].as_py()


class Repeats:
    """The three rounds, for an operator that says what symbols are and which windows recur.

    A key with ``hot_contexts`` contexts in the corpus is split by window: what a decision needs
    for so many contexts bounds a task's memory.

    ``symbols(chunk)`` gives (values, ends of documents in symbols, anything ``context_spans`` needs);
    ``context_spans`` where the contexts' bytes start and end; ``same`` whether two contexts' bytes, if
    they differ, hold the same symbols.
    """

    def __init__(self, length: int, k: int, symbols: Callable, context_spans: Callable, same: Callable, across: bool, decide: Callable, apply: Callable, schema: str, hot_contexts: int):
        self.length, self.k, self.symbols, self.context_spans, self.same, self.across = length, k, symbols, context_spans, same, across
        self.decide, self.apply, self.schema, self.hot_contexts = decide, apply, schema, hot_contexts

    def keys(self, contexts: Contexts, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether each recurs within the chunk (in two documents, or at all if not ``across``), and their contexts there."""
        order = np.lexsort((owner, contexts.key)) if self.across else np.argsort(contexts.key)
        key, own = contexts.key[order], owner[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(key)] - 1 if len(starts) else starts
        return key[starts], (own[starts] != own[stops]) if self.across else stops > starts, stops - starts + 1

    def run(self, rows: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
        total = text_bytes(rows)
        rows, _ = chunked(rows, total, chunk_bytes)
        small, large = bucket_count(total, KEY_BUCKET), bucket_count(total, CONTEXT_BUCKET)

        copies = self.copies(rows) if self.across else None

        def prepare(table, notes):
            chunk = Chunk(table)
            values, ends, extra = self.symbols(chunk)
            contexts = Contexts(values, ends, self.length, self.k)
            owner = np.searchsorted(ends[1:], contexts.start, side="right")
            if self.across and (idle := self.copied(chunk, notes) | ~chunk.named).any():
                kept = np.flatnonzero(~idle[owner])
                contexts, owner = contexts.take(kept), owner[kept]
            return chunk, values, ends, extra, contexts, owner

        def ask(key, table, notes=None):
            _, _, _, _, contexts, owner = prepare(table, notes)
            keys, _, times = self.keys(contexts, owner)
            bucket = spread_buckets(keys, small)
            order = np.argsort(bucket, kind="stable")
            keys, times = keys[order], np.minimum(times[order], 65_535).astype(np.uint16)
            return blobs([(chunk_number(key), b, pack(deltas(keys[s]), times[s])) for b, s in by_bucket(bucket[order])])

        def answer(table):
            chunks, bucket = table["chunk"].to_pylist(), table["bucket"][0].as_py()
            parts = [unpack(d) for d in table["data"].to_pylist()]
            asked = [undeltas(p[0]) for p in parts]
            keys, at, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
            total = np.bincount(at, np.concatenate([p[1] for p in parts]))
            flags = np.where(total >= self.hot_contexts, 2, np.where(counts > 1, 1, 0)).astype(np.uint8)
            return blobs([(c, bucket, pack(flags[np.searchsorted(keys, a)])) for c, a in zip(chunks, asked, strict=True)])

        def send(key, table, answers):
            number = chunk_number(key)
            chunk, values, ends, extra, contexts, owner = prepare(table, answers)
            keys, local, _ = self.keys(contexts, owner)
            answers = answers.filter(pc.greater_equal(answers["bucket"], 0))
            order = np.argsort(answers["bucket"].to_numpy()) if answers.num_rows else []
            data = answers["data"]
            flags = np.zeros(len(keys), np.uint8)
            if len(order):
                flags[np.argsort(spread_buckets(keys, small), kind="stable")] = np.concatenate([unpack(data[int(i)].as_py())[0] for i in order])
            flag = np.maximum(flags, local)[np.searchsorted(keys, contexts.key)] if len(keys) else np.zeros(0, np.uint8)
            plain, hot = contexts.take(np.flatnonzero(flag == 1)), contexts.by_window(np.flatnonzero(flag == 2), values)
            out = []
            for c in (plain, hot):
                if len(c.start):
                    out += self.parcels(number, chunk, c, np.searchsorted(ends[1:], c.start, side="right"), values, extra, large)
            return blobs(out)

        def judge(table):
            return blobs(self.judged(table))

        def finish(key, table, answers):
            chunk = Chunk(table)
            values, ends, extra = self.symbols(chunk)
            found = [unpack(d) for d in answers.filter(pc.greater_equal(answers["bucket"], 0))["data"].to_pylist()]
            cover = np.zeros(len(values) + 1, np.int32)
            for start, mask in found:
                for j in range(int(mask.max(initial=0)).bit_length()):
                    at = start[(mask >> U64(j) & U64(1)).astype(bool)].astype(np.int64) + j
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + self.length, -1)
            for d in np.flatnonzero(self.copied(chunk, answers)):
                if ends[d + 1] - ends[d] >= self.length:
                    cover[ends[d]] += 1
                    cover[ends[d + 1]] -= 1
            np.cumsum(cover, out=cover)
            return self.apply(chunk, ends, extra, cover[:-1] > 0)

        by_chunk = lambda df: df.groupBy("chunk")
        noted = lambda df: df.unionByName(copies) if self.across else df
        asked = by_chunk(rows).cogroup(by_chunk(copies)).applyInArrow(lambda key, t, c: ask(key, t, c), BLOB) if self.across else by_chunk(rows).applyInArrow(lambda key, t: ask(key, t), BLOB)
        answered = asked.groupBy("bucket").applyInArrow(answer, BLOB)
        sent = by_chunk(rows).cogroup(by_chunk(noted(answered))).applyInArrow(send, BLOB)
        judged = sent.groupBy("bucket").applyInArrow(judge, BLOB)
        return by_chunk(rows).cogroup(by_chunk(noted(judged))).applyInArrow(finish, self.schema)

    @staticmethod
    def copies(rows: DataFrame) -> DataFrame:
        """(chunk, bucket -1, data: the text's hash) of the rows whose whole text is also that of a smaller id.

        Exact copies need no windows: all of theirs start in a smaller id. Only ids and hashes move.
        """
        texts = rows.select("chunk", "id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
        # cut, so that both sides of the join are plain shuffles, which Spark splits where one text is very frequent
        first = cut(texts.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("sha", "least"))
        found = texts.join(first, "sha").where("id > least")
        return found.select((F.col("chunk") + 0).alias("chunk"), F.lit(-1).cast("long").alias("bucket"), F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.col("sha")).alias("data"))

    @staticmethod
    def copied(chunk: Chunk, notes: pa.Table | None) -> np.ndarray:
        """Which documents of the chunk are noted as copies."""
        out = np.zeros(len(chunk.ids), bool)
        if notes is not None and (told := set(notes.filter(pc.less(notes["bucket"], 0))["data"].to_pylist())):
            known = {t[:8] for t in told}
            for d, (i, named) in enumerate(zip(chunk.ids.tolist(), chunk.named.tolist(), strict=True)):
                name = (i & (1 << 64) - 1).to_bytes(8, "big")
                if named and name in known:
                    out[d] = name + hashlib.sha256(chunk.bytes[chunk.ends[d] : chunk.ends[d + 1]]).digest() in told
        return out

    def parcels(self, number: int, chunk: Chunk, c: Contexts, owner: np.ndarray, values: np.ndarray, extra, buckets: int) -> list[tuple[int, int, bytes]]:
        """The distinct contexts with their places, packed for each bucket."""
        bucket = spread_buckets(c.key, buckets)
        order = np.lexsort((owner, c.anchor, c.count, c.content, c.key, bucket))
        c, owner, bucket = c.take(order), owner[order], bucket[order]
        same = (c.key[1:] == c.key[:-1]) & (c.content[1:] == c.content[:-1]) & (c.count[1:] == c.count[:-1]) & (c.anchor[1:] == c.anchor[:-1])
        begin, end = self.context_spans(c, extra)
        raw = chunk.bytes.tobytes()
        for i in np.flatnonzero(same).tolist():  # equal hashes are not enough
            x, y = raw[begin[i] : end[i]], raw[begin[i + 1] : end[i + 1]]
            if x != y and not self.same(x, y):
                same[i] = False
        first = np.flatnonzero(np.r_[True, ~same])
        places = np.diff(np.r_[first, len(c.start)])
        one, begin, lengths = c.take(first), begin[first], (end - begin)[first]
        place_at = np.r_[first, len(c.start)]
        least = chunk.ids[owner[first]]
        own = (chunk.ids[owner] == np.repeat(least, places)).astype(np.uint8)
        out = []
        for b, s in by_bucket(bucket[first]):
            p, data = slice(place_at[s.start], place_at[s.stop]), chunk.bytes[ranges(begin[s], lengths[s])]
            out.append((number, b, pack(deltas(one.key[s]), one.anchor[s].astype(np.uint16), one.count[s].astype(np.uint8), least[s], places[s].astype(np.uint32), lengths[s].astype(np.uint32), c.start[p].astype(np.uint32), own[p], data)))
        return out

    def judged(self, table: pa.Table) -> list[tuple[int, int, bytes]]:
        chunks, bucket = table["chunk"].to_numpy(), table["bucket"][0].as_py()
        parts = [unpack(d) for d in table["data"].to_pylist()]
        join = lambda k, f=lambda x: x: np.concatenate([f(p[k]) for p in parts])
        key, anchor, count, least = join(0, undeltas), join(1).astype(np.int64), join(2).astype(np.int64), join(3)
        places, lengths, start, own, data = join(4).astype(np.int64), join(5).astype(np.int64), join(6), join(7).astype(bool), join(8)
        begin, order = np.cumsum(lengths) - lengths, np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        mask_own, mask_other = np.zeros(len(key), U64), np.zeros(len(key), U64)
        at = 0
        while at < len(order):  # some keys at a time, which bounds what the decision needs
            stop = edges[min(np.searchsorted(edges, at + PIECE), len(edges) - 1)]
            r = order[at:stop]
            mask_own[r], mask_other[r] = self.decide(self.length, key[r], anchor[r], count[r], least[r], places[r], lengths[r], data[ranges(begin[r], lengths[r])])
            at = stop
        chunk = np.repeat(np.repeat(chunks, [len(p[0]) for p in parts]), places)
        mask = np.where(own, np.repeat(mask_own, places), np.repeat(mask_other, places))
        keep = np.flatnonzero(mask)
        keep = keep[np.argsort(chunk[keep], kind="stable")]
        return [(c, bucket, pack(start[keep[s]], mask[keep[s]])) for c, s in by_bucket(chunk[keep])]


def full(count: np.ndarray) -> np.ndarray:
    """A mask of all windows of each context."""
    return (U64(1) << count.astype(U64)) - U64(1)
