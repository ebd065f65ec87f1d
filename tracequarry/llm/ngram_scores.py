"""Language-model scores by stupid backoff over relational n-gram counts.

The counts of all n-grams up to ``order`` are tables partitioned by the n-gram's hash. Chunks of
documents explode their texts into n-grams and join the tables: each chunk sends its distinct keys
with its own counts to the keys' buckets, where they are summed over the corpus, and gets the sums
back in the order it asked. An n-gram of two or more words is in the model from ``min_count`` on; of
longer ones, only those are asked whose parts are in the model, since no other can be. A word's
score is the n-gram's count over its context's, or ``backoff`` times the score of the next shorter
n-gram, and at last its share of all words. Logarithms are summed per document.

Keys are 64-bit hashes of words' hashes. Null texts have no words and a null score. Rows with a null
id keep it; repeated rows count each. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import U64, Chunk, chunked, cut, deltas, gram_hashes, id_and_text, pack, scramble, text_bytes, undeltas, unpack, word_hashes, word_spans
from tracequarry.llm.repeats import BLOB, blobs, bucket_count, buckets_of, by_bucket, chunk_number

ROUND = 1 << 40
#: Text whose n-grams of a round one bucket holds on average.
BUCKET = 16 << 20


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among the sorted distinct keys, which hold all of them.

    Keys are evenly spread, so that a table of their first bits leads to the place or a few before it: a fraction of a binary search's cost.
    """
    shift = U64(64 - max(1, len(keys).bit_length()))
    first = np.zeros((1 << 64 - int(shift)) + 1, np.int64)
    np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=len(first) - 1), out=first[1:])
    at = first[(wanted >> shift).astype(np.int64)]
    left = np.flatnonzero(keys[at] != wanted) if len(wanted) else at
    while len(left):
        at[left] += 1
        left = left[keys[at[left]] != wanted[left]]
    return at


class Exploded:
    """A chunk's n-grams: keys by order, with the places where an n-gram fits into its document."""

    def __init__(self, table: pa.Table, order: int, min_count: int):
        self.chunk = Chunk(table)
        starts, stops, self.ends = word_spans(self.chunk.bytes, self.chunk.ends)
        self.words, self.order, self.min_count = word_hashes(self.chunk.bytes, starts, stops), order, min_count
        begin = np.repeat(self.ends[:-1], np.diff(self.ends))
        self.place = np.arange(len(self.words)) - begin  # within the document

    def keys(self, n: int) -> np.ndarray:
        """The key of the n-gram that ends at each word; meaningless where it doesn't fit."""
        out = np.zeros(len(self.words), U64)
        if len(self.words) >= n:
            out[n - 1 :] = scramble(gram_hashes(self.words, n) ^ U64(n))
        return out

    def known(self, n: int, count: np.ndarray) -> np.ndarray:
        """Whether the n-gram that ends at each word is in the model, by the counts asked for."""
        return (self.place >= n - 1) & (count >= (self.min_count if n > 1 else 1))

    def counts(self, answers: list[tuple[int, bytes]], rounds: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray] | None]:
        """The corpus counts of orders that ``rounds`` rounds have asked, and the distinct keys of the next one with the chunk's own counts."""
        counts: list[np.ndarray] = []
        answers = sorted(answers)
        for r in range(rounds + 1):
            if r == max(1, self.order - 1):  # nothing more to ask
                return counts, None
            if r == 0:
                asked = [(1, np.ones(len(self.words), bool))] + [(2, self.place >= 1)] * (self.order > 1)
            else:
                n, was = r + 2, self.known(r + 1, counts[r])
                asked = [(n, was & np.r_[False, was[:-1]] & (self.place >= n - 1))]
            parts = [(self.keys(n), fits) for n, fits in asked]
            keys, own = np.unique(np.concatenate([k[fits] for k, fits in parts]), return_counts=True)
            if r == rounds:
                return counts, (keys, own)
            got = [unpack(d)[0] for b, d in answers if b // ROUND == r]
            total = np.concatenate(got) if got else np.zeros(0, np.int64)
            for k, fits in parts:
                c = np.zeros(len(self.words), np.int64)
                c[fits] = total[places(keys, k[fits])]
                counts.append(c)
        raise AssertionError


def ngram_scores(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_known (words whose longest n-gram is in the model) and score (mean natural logarithm per word) of every row."""
    rows, rounds = id_and_text(docs, id_col, text_col), max(1, order - 1)
    total = text_bytes(rows)
    rows, _ = chunked(rows, total, chunk_bytes)
    buckets = bucket_count(total, BUCKET)
    by_chunk = lambda df: df.groupBy("chunk")
    pairs = lambda t: list(zip(t["bucket"].to_pylist(), t["data"].to_pylist(), strict=True))

    def ask(key, table, answers, r):
        _, (keys, own) = Exploded(table, order, min_count).counts(answers, r)
        return blobs([(chunk_number(key), r * ROUND + b, pack(deltas(keys[s]), own[s].astype(np.uint32))) for b, s in by_bucket(buckets_of(keys, buckets))])

    def asking(r):
        return lambda key, table, answers: ask(key, table, pairs(answers), r)

    def answer(table):
        asked = [unpack(d) for d in table["data"].to_pylist()]
        keys = [undeltas(a[0]) for a in asked]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([a[1] for a in asked])).astype(np.int64)
        bucket, out, done = table["bucket"][0].as_py(), [], 0
        for c, k in zip(table["chunk"].to_pylist(), keys, strict=True):
            out.append((c, bucket, pack(total[at[done : done + len(k)]])))
            done += len(k)
        return blobs(out)

    def score(key, table, answers):
        x = Exploded(table, order, min_count)
        counts, _ = x.counts(pairs(answers), rounds)
        log = np.log(np.maximum(counts[0], 1))
        shares, longest = np.ones(len(log)), x.place >= 0
        for n in range(2, order + 1):
            fits, known = x.place >= n - 1, x.known(n, counts[n - 1])
            context = np.r_[1, counts[n - 2][:-1]] if len(log) else log
            log = np.where(known, np.log(np.maximum(counts[n - 1], 1)) - np.log(np.maximum(context, 1)), np.where(fits, log + math.log(backoff), log))
            shares = np.where(known, 0, shares)  # words that got as far as their share of all words
            longest = np.where(fits, known, longest)
        sums = [np.add.reduceat(np.r_[v, 0.0], np.minimum(x.ends[:-1], len(v))) * (np.diff(x.ends) > 0) if len(x.chunk.ids) else v for v in (log, shares, longest.astype(float))]
        return pa.table({"doc_id": x.chunk.column, "n_words": pa.array(np.diff(x.ends), pa.int64()), "log": pa.array(sums[0], pa.float64()), "shares": pa.array(sums[1].astype(np.int64), pa.int64()), "n_known": pa.array(sums[2].astype(np.int64), pa.int64())})

    answered = by_chunk(rows).applyInArrow(lambda key, t: ask(key, t, [], 0), BLOB).groupBy("bucket").applyInArrow(answer, BLOB)
    for r in range(1, rounds):
        asked = by_chunk(rows).cogroup(by_chunk(answered)).applyInArrow(asking(r), BLOB)
        answered = answered.unionByName(asked.groupBy("bucket").applyInArrow(answer, BLOB))
    scored = cut(by_chunk(rows).cogroup(by_chunk(answered)).applyInArrow(score, "doc_id long, n_words long, log double, shares long, n_known long"))
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    return scored.select("doc_id", "n_words", "n_known", F.when(F.col("n_words") > 0, (F.col("log") - F.col("shares") * math.log(words)) / F.col("n_words")).alias("score"))


def digest(found: DataFrame) -> DataFrame:
    """Scores rounded to six decimals, since sums of logarithms depend on their order."""
    return found.withColumn("score", F.round("score", 6))


#: The same in DuckDB's SQL, for three orders.
SQL = r"""
with words as (
    select doc_id, i, w, lag(w) over d as w1, lag(w, 2) over d as w2
    from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i
          from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents))
    window d as (partition by doc_id order by i)
),
total as (select count(*) as t from words),
c1 as (select w, count(*) as n from words group by w),
c2 as (select w1, w, count(*) as n from words where w1 is not null group by w1, w),
c3 as (select w2, w1, w, count(*) as n from words where w2 is not null group by w2, w1, w),
scored as (
    select words.doc_id,
        case when c3.n >= 2 then ln(c3.n) - ln(ctx3.n)
             else (case when words.w2 is not null then ln(0.4) else 0 end)
                + (case when c2.n >= 2 then ln(c2.n) - ln(ctx2.n)
                        else (case when words.w1 is not null then ln(0.4) else 0 end) + ln(c1.n) - ln(total.t) end) end as s,
        case when words.w2 is not null then c3.n >= 2 when words.w1 is not null then c2.n >= 2 else true end as known
    from words cross join total
    join c1 on c1.w = words.w
    left join c2 on c2.w1 = words.w1 and c2.w = words.w
    left join c1 as ctx2 on ctx2.w = words.w1
    left join c3 on c3.w2 = words.w2 and c3.w1 = words.w1 and c3.w = words.w
    left join c2 as ctx3 on ctx3.w1 = words.w2 and ctx3.w = words.w1
)
select d.doc_id, count(s.s)::bigint as n_words, coalesce(sum(case when s.known then 1 else 0 end), 0)::bigint as n_known, round(avg(s.s), 6) as score
from documents d left join scored s on s.doc_id = d.doc_id
group by d.doc_id
"""
