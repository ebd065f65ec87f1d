"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive words of each benchmark item; an item of fewer
words is one pattern. Patterns of equal length share tables: the shift of a block of two words says
how far the search may jump, the bucket of a suffix block holds the patterns that may end there, and
a direct comparison confirms them. A document word inside any occurrence is hit.

Null texts have no words. Empty tables give an empty result (documents) or no hits (benchmark).
Items with a null id are ignored; documents with a null id keep it. Repeated rows count each; an
item id that occurs twice is listed once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import id_and_text, shared_folder, slices, texts_as_bytes

#: Lower-cases A-Z and turns every ASCII byte outside 0-9 and a-z into a space; other bytes are parts of words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Tables:
    """Wu-Manber tables of patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift, self.buckets = {}, {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(pattern[-self.block :], []).append((pattern, items))

    def find(self, words: list[bytes]):
        """(first word, items) of each occurrence, in order."""
        m, shift, far, buckets = self.length, self.shift, self.far, self.buckets
        at, n = m - 1, len(words)
        if self.block == 1:
            for at, word in enumerate(words):
                for _, items in buckets.get((word,), ()):
                    yield at, items
            return
        while at < n:
            block = (words[at - 1], words[at])
            jump = shift.get(block, far)
            if jump:
                at += jump
                continue
            first = at - m + 1
            for pattern, items in buckets[block]:
                if words[first] == pattern[0] and tuple(words[first : at + 1]) == pattern:
                    yield first, items
            at += 1


def build(items: list[tuple[int, bytes]], width: int) -> list[Tables]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            m = min(width, len(words))
            for at in range(len(words) - m + 1):
                found = by_length.setdefault(m, {}).setdefault(tuple(words[at : at + m]), [])
                if item not in found:
                    found.append(item)
    return [Tables(p, m) for m, p in sorted(by_length.items())]


def search(tables: list[Tables], words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """The hit words as disjoint ranges, and the items with an occurrence."""
    spans, items = [], set()
    for t in tables:
        for first, ids in t.find(words):
            items.update(ids)
            spans.append((first, first + t.length))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


def shards(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int):
    """How many shards of about max_bytes of text the items make, and what reads one; a shard is all that is read and broadcast at once."""
    rows = id_and_text(benchmark, item_col, text_col).where("id is not null and text is not null")
    size = int(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    n = max(1, -(-size // max_bytes))
    part = lambda k: rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
    return n, lambda k: [(r.id, r.text.encode()) for r in part(k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", max_shard_bytes: int = 16 << 20) -> DataFrame:
    """For each document row: doc_id, n_words, spans (of hit words, [first, end) pairs flattened) and items (sorted ids).

    The benchmark is read in shards whose texts have at most about max_shard_bytes, a checked bound;
    each is broadcast. With more than one shard, the documents are searched once per shard, one shard
    after another; its hits are written to the shared folder before the next is read, and the hits of a
    row are merged by its id and its text's hash.
    """
    return found_rows(docs, benchmark, width, item_col, item_text, id_col, text_col, max_shard_bytes).drop("row")


def found_rows(docs: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text: str, id_col: str, text_col: str, max_shard_bytes: int) -> DataFrame:
    """The rows of matches(); with more than one shard also ``row``, the MD5 of the text."""
    spark, rows = docs.sparkSession, id_and_text(docs, id_col, text_col)
    n, load = shards(benchmark, item_col, item_text, max_shard_bytes)

    def over(shared):
        held = []

        def found(batches):
            if not held:
                held.append(build(shared.value, width))
            for batch in slices(batches):
                words = [words_of(t) for t in texts_as_bytes(batch["text"])]
                results = [search(held[0], w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], *([batch["row"]] if n > 1 else []), pa.array([len(w) for w in words], pa.int64()), pa.array([[x for s in r[0] for x in s] for r in results], pa.list_(pa.int64())), pa.array([sorted(r[1]) for r in results], pa.list_(pa.int64()))],
                    ["doc_id", *(["row"] if n > 1 else []), "n_words", "spans", "items"],
                )

        source = rows if n == 1 else rows.withColumn("row", F.unhex(F.md5(F.col("text").cast("binary"))))
        return source.mapInArrow(found, "doc_id long, " + "row binary, " * (n > 1) + "n_words long, spans array<long>, items array<long>")

    if n == 1:
        return over(spark.sparkContext.broadcast(load(0)))
    folder = f"{shared_folder(spark)}/decontamination-{uuid.uuid4().hex}"
    for k in range(n):
        shared = spark.sparkContext.broadcast(load(k))
        part = over(shared)
        (part if k == 0 else part.where("size(items) > 0")).withColumn("shard", F.lit(k)).write.mode("append").parquet(folder)
        shared.destroy()
    every = spark.read.parquet(folder)

    def merged(batches):
        for batch in slices(batches):
            spans = []
            for found in batch["spans"].to_pylist():
                out: list[int] = []
                for a, b in sorted(pair for one in found for pair in zip(one[::2], one[1::2], strict=True)):
                    if out and a <= out[-1]:
                        out[-1] = max(b, out[-1])
                    else:
                        out += [a, b]
                spans.append(out)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["n_words"], pa.array(spans, pa.list_(pa.int64())), batch["items"], batch["times"]], ["doc_id", "row", "n_words", "spans", "items", "times"])

    # equal rows have equal hits in each shard: the sets of a row are of its own text, whatever its copies are
    hits = every.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("shard") == 0).alias("times"))
    joined = hits.mapInArrow(merged, "doc_id long, row binary, n_words long, spans array<long>, items array<long>, times long")
    return joined.select("doc_id", "row", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (n_hit > 0 and 20 * n_hit >= n_words) to the rows of matches()."""
    hit = F.coalesce(F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of judged rows."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, item_col: str = "item_id", item_text: str = "text", text_col: str = "text", max_shard_bytes: int = 16 << 20) -> DataFrame:
    """The rows, with all their columns, that aren't contaminated.

    With one shard of the benchmark no row moves between tasks; with more, the hashes of contaminated texts
    are joined.
    """
    spark = docs.sparkSession
    n, load = shards(benchmark, item_col, item_text, max_shard_bytes)
    if n > 1:
        named = docs.select(F.lit(0).alias("id"), docs[text_col].alias("text"))
        bad = judged(found_rows(named, benchmark, width, item_col, item_text, "id", "text", max_shard_bytes)).where("contaminated").select("row").distinct()
        return docs.join(bad, F.unhex(F.md5(docs[text_col].cast("string").cast("binary"))) == bad["row"], "left_anti")
    shared, held = spark.sparkContext.broadcast(load(0)), []

    @F.pandas_udf("boolean")
    def fine(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(build(shared.value, width))
        out = []
        for t in texts:
            words = words_of((t or "").encode())
            hit = sum(b - a for a, b in search(held[0], words)[0])
            out.append(not (hit and 20 * hit >= len(words)))
        return pd.Series(out, dtype=bool)

    return docs.where(fine(docs[text_col].cast("string")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in DuckDB's SQL, for windows of 13 words.
SQL = f"""
with b as (select item_id, w, least(13, len(w)) as m from (select item_id, {_WORDS} as w from benchmark where item_id is not null) where len(w) > 0),
iw as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as s from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from b)),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
dw as (select r, m, i, array_to_string(w[i:i + m - 1], ' ') as s from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d cross join (select distinct m from iw))),
h as (select r, i, dw.m, item_id from dw join iw using (m, s)),
n as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + m)) as k from h) group by r),
t as (select r, list_sort(list_distinct(list(item_id::varchar))) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join n using (r) left join t using (r)
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 13) -> list[tuple]:
    """The digest rows, by comparing every window at every place; for tests."""
    import re

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc, text in docs:
        words, hit, found = low(text), set(), set()
        for item, t in items:
            w = low(t)
            m = min(width, len(w))
            for a in range(len(w) - m + 1 if w else 0):
                for b in range(len(words) - m + 1):
                    if words[b : b + m] == w[a : a + m]:
                        hit.update(range(b, b + m))
                        found.add(item)
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
