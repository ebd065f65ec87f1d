"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming checks, components.

A fingerprint has 64 bits; each is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles, repeats included. Two fingerprints that differ in at most ``distance`` bits
agree in at least ``blocks - distance`` of the blocks that the bits are split into, so that every
close pair meets under some choice of that many blocks. Distinct fingerprints meet there, never
documents: copies cost nothing. A choice that very many fingerprints share is split by the same rule
over the bits it leaves free, so that no group holds more than a few thousand. Each meeting is
verified bit by bit and gives a spanning star of the linked fingerprints instead of all pairs;
components follow by contraction, one shuffle a round.

``similar`` links texts by similarity, for which 64 bits are too few: its fingerprints have as many
words of 64 bits, with other hashes each, as it takes for close pairs to share a block, and pairs are
verified over 512 bits.

Null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a
shingle hash the whole sequence. Rows with a null id keep it, and never name a component. Repeated
rows are returned each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm.common import U64, cut, id_and_text, scramble, slices, texts_as_bytes

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, U64)
    one, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter((one(g, seed) for g in grams), U64, n)


#: Fingerprints under one key that are compared with each other; under a block, four times as many before it is salted.
GROUP = 4096
#: Bytes of a long fingerprint that verify a pair.
CHECK = 64


def fingerprint_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The words of a fingerprint; those after the first see the hashes scrambled anew."""
    out = np.zeros(words, np.int64)
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            part = scramble(part ^ U64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if w else part
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""

    def made(batches):
        for batch in slices(batches):
            fps = [int(fingerprint_of(shingle_hashes(t, size, seed))[0]) for t in texts_as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fps, pa.int64())], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(made, "id long, fp long")


def masks(blocks: int, kept: int, bits: int = 64) -> list[int]:
    """A mask for each choice of kept blocks; block sizes differ by one at most."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), kept)]


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that the edges reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def stars(key: np.ndarray, node: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, smallest member) that span the nodes linked under an equal key; ``bits`` holds each node's words."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    found_i, found_j, pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(i, j):
        nonlocal pending
        found_i.append(i)
        found_j.append(j)
        pending += len(i)
        if pending > 2_000_000:  # keep only a spanning star of what was found so far
            squeeze()

    def squeeze():
        nonlocal pending
        label = components(len(bits), np.concatenate(found_i), np.concatenate(found_j))
        moved = np.flatnonzero(label != np.arange(len(bits)))
        found_i[:], found_j[:], pending = [moved], [label[moved]], 0

    differing = lambda x, y: np.bitwise_count(bits[x] ^ bits[y]).sum(axis=-1, dtype=np.int64)
    small = sizes[np.repeat(np.arange(len(sizes)), sizes)] <= 64
    for step in range(1, int(min(64, sizes.max(initial=0)))):
        i = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        if not len(i):
            break
        i = i[differing(node[i], node[i + step]) <= distance]
        add(node[i], node[i + step])
    for s, g in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        block = max(1, (1 << 19) // g)
        for at in range(s, s + g, block):
            rows = np.arange(at, min(at + block, s + g))
            i, j = np.nonzero(differing(node[rows][:, None], node[None, at : s + g]) <= distance)
            keep = rows[i] < at + j
            add(node[rows[i][keep]], node[at + j[keep]])
    squeeze()
    return found_i[0], found_j[0]


def starred(rows: DataFrame, count: int, distance: int, kind: str, per_bucket: int = 200_000) -> DataFrame:
    """(a, b): spanning stars of the fingerprints fp that are linked under an equal ``key``, by buckets of keys."""
    rows = rows.select("fp", "key", F.pmod("key", F.lit(max(1, -(-count // per_bucket)))).alias("bucket"))

    def linked(table: pa.Table) -> pa.Table:
        found = table["fp"].combine_chunks().dictionary_encode()
        nodes, node = found.dictionary, found.indices.to_numpy().astype(np.int64)
        raw = nodes.to_numpy() if kind == "long" else np.frombuffer(b"".join(nodes.to_pylist()), np.int64)
        a, b = stars(table["key"].to_numpy(), node, raw.view(U64).reshape(len(nodes), -1), distance)
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

    return rows.groupBy("bucket").applyInArrow(linked, f"a {kind}, b {kind}")


def frequent(rows: DataFrame, most: int) -> DataFrame | None:
    """(key, n) of the keys that more than ``most`` rows have; None if there are none."""
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
    return None if hot.isEmpty() else hot


def links(distinct: DataFrame, count: int, distance: int, blocks: int, most: int = GROUP) -> DataFrame:
    """(a, b): spanning stars of the fingerprints fp that differ in at most ``distance`` bits.

    The fingerprints of a frequent key agree in its blocks, so that their other bits are split into
    ``2 * distance + 2`` blocks of which ``distance + 2`` agree: there, few bits are left to differ.
    """
    chosen = masks(blocks, blocks - distance)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masked = F.array(*(F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for k, m in enumerate(chosen)))
    rows = distinct.select("fp", F.explode(masked).alias("x")).select("fp", "x.k", "x.key")
    if (hot := frequent(rows, most)) is None:
        return starred(rows, count * len(chosen), distance, "long")
    finer = []
    for m in chosen:
        free, parts = [b for b in range(64) if not m >> b & 1], 2 * distance + 2
        finer.append([signed(m | sum(1 << b for p in some for b in free[p::parts])) for some in combinations(range(parts), distance + 2)])
    of_mask = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in finer)), F.col("k") + 1)
    keys = F.transform(of_mask, lambda m: F.xxhash64(F.lit(-1), F.col("k"), m, F.col("fp").bitwiseAND(m)))
    marked = rows.join(hot, "key", "left")
    split = marked.where("n is not null").select("fp", F.explode(keys).alias("key"))
    return starred(marked.where("n is null").select("fp", "key").unionByName(split), count * len(chosen), distance, "long")


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); equal roots for connected nodes.

    Each round, every node points to the neighbour with the least hash, or itself, pointers are
    followed once more, and edges are drawn anew between what they point to. Hashes have no order
    along a chain, so that the edges left shrink by a factor each round, whatever the ids.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        up = both.groupBy("node").agg(F.min(ranked("other")).alias("low")).select("node", F.least(ranked("node"), "low")["n"].alias("up"))
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = cut(up.join(far, "up").select("node", F.col("far").alias("root")))
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        to = lambda x: step.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        drawn = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = cut(drawn.where("a <> b").distinct())
    return labels


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, distance: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id that links reach."""
    rows = cut(fingerprints(docs, size, seed, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = contracted(links(distinct, distinct.count(), distance, blocks))
    if labels is None:
        return rows.join(distinct, "fp").select(F.col("id").alias("doc_id"), "fp", F.col("least").alias("component_id"))
    rooted = cut(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of texts differ whose shingles have a Jaccard similarity: the angle between them."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(count: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bytes of a block and words of a fingerprint, for a number of texts.

    Blocks are as wide as it takes for unrelated texts to share one rarely, and as many as it takes for
    a pair of exactly that similarity to share one with the probability ``recall``.
    """
    width = 2
    while count >> 8 * width > GROUP:
        width += 1
    shared = (1 - differing_share(similarity)) ** (8 * width)
    return width, max(CHECK, math.ceil(math.log(1 - recall) / math.log1p(-shared)) * width) // 8 + 1


def across(rows: DataFrame, labels: DataFrame | None, distance: int, most: int) -> DataFrame:
    """(a, b): roots that link fingerprints fp of different roots under an equal ``key``, for keys that very many share.

    A key's rows are dealt into parts of some ``most`` rows, and every two parts meet in a group of their own. A root
    of more than ``most`` rows has parts of its own, which do not meet each other; a key of one root has no groups.
    """
    if labels is None:
        rooted = cut(rows.select("fp", "key", F.col("fp").alias("root")).distinct())
    else:
        rooted = cut(rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "key", F.coalesce("root", "fp").alias("root")).distinct())
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = cut(sizes.join(sizes.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1"), "key", "left_semi"))
    own = F.when(F.col("n") > most, F.col("root")).alias("unit")
    units = sizes.groupBy("key", own).agg((F.floor(F.sum("n") / most) + 1).alias("parts"))
    of_key = Window.partitionBy("key")
    units = units.withColumn("total", F.sum("parts").over(of_key)).withColumn("first", F.sum("parts").over(of_key.orderBy("unit")) - F.col("parts"))
    units = cut(units.select("key", "unit", F.struct("parts", "total", "first").alias("u")))  # one for every ``most`` rows, and one a key
    large = units.where("unit is not null").select("key", F.col("unit").alias("root"), F.col("u").alias("large"))
    rest = units.where("unit is null").select("key", F.col("u").alias("rest"))
    dealt = rooted.join(F.broadcast(large), ["key", "root"], "left").join(F.broadcast(rest), "key", "left")
    dealt = dealt.withColumn("u", F.coalesce("large", "rest")).where("u is not null").withColumn("part", F.col("u.first") + F.pmod(F.xxhash64("fp", "key"), "u.parts"))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("u.total") - 1), lambda q: F.col("large").isNull() | (q < F.col("u.first")) | (q >= F.col("u.first") + F.col("u.parts")))
    dealt = dealt.select("fp", "root", "key", "part", F.explode(met).alias("other"))
    dealt = dealt.select("fp", "root", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).alias("upper"))

    def linked(table: pa.Table) -> pa.Table:
        found = table["root"].combine_chunks().dictionary_encode()
        roots, root = found.dictionary, found.indices.to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(table["fp"].to_pylist()), U64).reshape(table.num_rows, -1)
        upper = table["upper"].to_numpy()
        one = table["low"][0] == table["high"][0]  # a part meets itself
        x, y = (np.arange(len(bits)),) * 2 if one else (np.flatnonzero(~upper), np.flatnonzero(upper))
        a = b = np.zeros(0, np.int64)
        step = max(1, (1 << 19) // max(1, len(y)))
        for at in range(0, len(x), step):
            some = x[at : at + step]
            i, j = np.nonzero((np.bitwise_count(bits[some][:, None] ^ bits[y][None]).sum(axis=-1, dtype=np.int64) <= distance) & (root[some][:, None] != root[y][None]))
            if len(i):  # only a spanning star of what was found so far
                label = components(len(roots), np.r_[a, root[some][i]], np.r_[b, root[y][j]])
                a = np.flatnonzero(label != np.arange(len(label)))
                b = label[a]
        return pa.table({"a": roots.take(pa.array(a)), "b": roots.take(pa.array(b))})

    return dealt.groupBy("key", "low", "high").applyInArrow(linked, "a binary, b binary")


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.95, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 4 * GROUP) -> DataFrame:
    """(id, digest, root) of every row: the MD5 of its text, and a fingerprint that is the same for texts that links connect.

    Linked are texts that share a block and differ, over 512 bits, in at most one standard deviation
    more bits than texts of that similarity are expected to. Keys that more than ``most`` fingerprints
    share are salted first, which connects dense groups; what these links leave apart under such a key
    is then compared in full by ``across``, so that every pair that shares a block is judged or connected.
    """
    source = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    width, words = layout(docs.count(), similarity, recall)
    share = differing_share(similarity)
    distance = int(8 * CHECK * share + math.sqrt(8 * CHECK * share * (1 - share)))

    def made(batches):
        for batch in slices(batches):
            fps = [fingerprint_of(shingle_hashes(t, size, seed), words).tobytes() for t in texts_as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["digest"], pa.array(fps, pa.binary())], ["id", "digest", "long"])

    rows = cut(source.mapInArrow(made, "id long, digest binary, long binary")).withColumn("fp", F.substring("long", 1, CHECK))
    distinct = rows.select("fp", "long").distinct()
    blocks = 8 * words // width
    keyed = cut(distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("long", width * k + 1, width)) for k in range(blocks)))).alias("key")))
    salted = keyed
    if (hot := frequent(keyed, most)) is not None:
        salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("fp", "key"), F.floor(F.col("n") / most) + 1))
        salted = keyed.join(hot, "key", "left").select("fp", F.when(salt.isNull(), F.col("key")).otherwise(F.xxhash64("key", salt)).alias("key"))
    labels = contracted(starred(salted, keyed.count(), distance, "binary"))
    if hot is not None:
        more = cut(across(keyed.join(hot, "key", "left_semi"), labels, distance, most))
        if not more.isEmpty():
            labels = contracted(more if labels is None else more.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rows = rows.select("id", "digest", "fp")
    return rows.withColumnRenamed("fp", "root") if labels is None else rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("id", "digest", F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 400_000, **parameters) -> DataFrame:
    """One row, with all its columns, of each group of ``similar`` texts: that with the smallest id, then text hash.

    Rows are told apart by id and text, so that an id may occur on different texts; a null id comes
    after all others. Of rows with equal id and text, one stays. The keys of the rows that go are
    broadcast if they are few (a checked bound), else joined.
    """
    found = cut(similar(docs, id_col=id_col, text_col=text_col, **parameters))
    order = F.struct(F.col("id").isNull().alias("n"), "id", "digest")
    keys = cut(found.groupBy("root", "id", "digest").agg(F.count("*").alias("times")))
    first = keys.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.id").alias("first_id"), F.col("first.digest").alias("first_digest"), F.lit(True).alias("first"))
    # by row, not by root: a root may hold a third of all rows
    judged = keys.join(first, keys["id"].eqNullSafe(first["first_id"]) & keys["digest"].eqNullSafe(first["first_digest"]), "left")
    judged = cut(judged.select("id", "digest", "times", F.coalesce("first", F.lit(False)).alias("stays")))
    gone, repeated = (judged.where(which).select("id", "digest") for which in ("not stays", "stays and times > 1"))
    key = (docs[id_col].cast("long"), F.unhex(F.md5(docs[text_col].cast("string").cast("binary"))))

    def joined(rows, named, how):
        named = F.broadcast(named) if named.count() <= broadcast_rows else named
        return rows.join(named, key[0].eqNullSafe(named["id"]) & key[1].eqNullSafe(named["digest"]), how)

    kept = joined(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    every = F.struct("*")
    one = joined(kept, repeated, "left_semi").groupBy(*(k.alias(f"k{i}") for i, k in enumerate(key))).agg(F.min_by(every, F.xxhash64(every)).alias("row"))
    return joined(kept, repeated, "left_anti").unionByName(one.select("row.*"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
