"""Operators against brute force, exact round trips or held-out accuracy; nulls, ties, repeats, empty and long texts, clashing columns."""

import base64
import bz2
import gzip
import random
import time
import urllib.parse
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracequarry.llm import decontamination, ngram_scores, packing, quality, queries, secrets, simhash, substring_dedup, suffix_dedup, token_counts, topk
from tracequarry.llm.common import pack, ranges, sliding_min, unpack, word_hashes
from tracequarry.llm.repeats import Contexts, spread_buckets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, id string, bucket double, fp string, row int, spans string, x int"


def frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "c", "i", None, "f", 1, None, 7) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, words, vocabulary=400):
    return " ".join("".join(chr(97 + (k * 7 + j * 3) % 26) for j in range(2 + k % 7)) for k in (int(rng.random() ** 2 * vocabulary) for _ in range(words)))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, repeats within a text, odd characters, null and empty ones."""
    rng = random.Random(5)
    passage, line = prose(rng, 60), "all rights reserved by whoever wrote this very common line of text here."
    texts = [None, "", "one", "Ünïcode ça 日本語 " * 12, "a" * 300, " \t\n "]
    for k in range(40):
        text = prose(rng, rng.randint(5, 250))
        if k % 4 == 0:
            text += " " + passage + " " + prose(rng, 20)
        if k % 3 == 0:
            text = line + "\n" + text
        if k % 10 == 0:
            text = text + " " + text
        texts.append(text)
    texts += [texts[10], texts[10], texts[12] + " end", texts[13].replace(" ", "  ", 3), prose(rng, 20_000)]
    return texts


def rows(table):
    return sorted(map(tuple, table.collect()), key=repr)


def test_helpers():
    a, b = np.array([3, 1 << 60, 5], np.uint64), np.array([], np.uint8)
    x, y, z = unpack(pack(a, b, np.array([7, 9], np.uint32)))
    assert x.tolist() == a.tolist() and len(y) == 0 and z.tolist() == [7, 9]
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    v = np.array([4, 2, 7, 1, 9, 3], np.uint64)
    assert all(sliding_min(v, w).tolist() == [int(v[i : i + w].min()) for i in range(7 - w)] for w in range(1, 7))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*corpus, "a<|endoftext|>b <|endoftext|>", "it's  I'll\n\n 12  x", "ab" * 5000]
    got = token_counts.token_counts(frame(spark, texts, [None, *range(1, len(texts))]), path).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in got] == want and got[0].doc_id is None
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 1024 for n in want]


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(4 << 20, 64), (20_000, 2), (20_000, 64)])
def test_suffix_dedup(spark, corpus, chunk_bytes, hot):
    ids = [7 * k % 101 for k in range(len(corpus))]
    found = suffix_dedup.suffix_dedup(frame(spark, corpus, ids), hot_contexts=hot, chunk_bytes=chunk_bytes)
    assert rows(suffix_dedup.digest(found)) == sorted(suffix_dedup.brute_force(list(zip(ids, corpus, strict=True))), key=repr)


def test_suffix_dedup_of_repeated_and_nameless_rows(spark):
    text = "x" * 20 + "".join(map(chr, range(65, 120)))
    got = suffix_dedup.suffix_dedup(frame(spark, [text, text, text, text[:49], text, text], [3, 3, None, 9, 0, None])).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.kept)) for r in got] == [(None, 75), (None, 75), (0, 75), (3, 0), (3, 0), (9, 49)]


@pytest.mark.parametrize("length", [5, 122, 150, 200, 300])
def test_suffix_dedup_of_other_lengths(spark, corpus, length):
    ids = [7 * k % 101 for k in range(len(corpus))]
    found = suffix_dedup.suffix_dedup(frame(spark, corpus, ids), length=length, chunk_bytes=60_000)
    assert rows(suffix_dedup.digest(found)) == sorted(suffix_dedup.brute_force(list(zip(ids, corpus, strict=True)), length), key=repr)


def thue_morse(n, a, b):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_words_that_collide_in_polynomials(spark):
    """Thue-Morse words of 1,024 letters have equal polynomials modulo 2**64."""
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    around = " ".join(f"w{k}" for k in range(34))
    texts = [f"{x} {around}", f"{y} {around}", f"{around} {x}", f"{around} {x}"]
    ids = [1, 2, 3, 4]
    got = substring_dedup.digest(substring_dedup.substring_dedup(frame(spark, texts, ids)))
    want = substring_dedup.brute_force(list(zip(ids, texts, strict=True)))
    assert rows(got) == sorted(want, key=repr) and [w[2] for w in want] == [0, 0, 35, 35]
    known = {r.doc_id: r.n_known for r in ngram_scores.ngram_scores(frame(spark, [f"{x} one", f"{y} one"], [1, 2])).collect()}
    assert known == {1: 1, 2: 1}
    data = np.frombuffer((x + y).encode(), np.uint8)
    hashes = word_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert hashes[0] != hashes[1]


def test_large_ids_beside_a_null_one(spark):
    """Ids beyond 2**53 stay what they are."""
    big = [(1 << 60) + 1, None, -(1 << 62) - 1, None]
    texts = ["a b c d", "a b c d", "x y", None]
    docs = frame(spark, texts, big)
    every = (
        ngram_scores.ngram_scores(docs), substring_dedup.substring_dedup(docs), suffix_dedup.suffix_dedup(docs), simhash.near_duplicates(docs), secrets.secret_scan(docs),
        token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
    )
    for found in every:
        assert sorted({r.doc_id for r in found.collect()}, key=repr) == sorted(set(big), key=repr)


def test_buckets_are_even():
    rng = random.Random(2)
    text = np.frombuffer(prose(rng, 60_000, 5000).encode(), np.uint8)
    contexts = Contexts(text, np.array([0, len(text)]), 50, 24)
    sizes = np.bincount(spread_buckets(np.unique(contexts.key), 64), minlength=64)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def test_sort_by_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    lengths = np.full(100, 40)
    suffixes = suffix_dedup.Suffixes(data, lengths)
    at = (ranges(np.arange(100) * 40, np.full(100, 20))).astype(np.int64)
    group = np.repeat(np.arange(4), 500)
    order, same = suffixes.classes(at, group, 20)
    text = data.tobytes()
    for g in range(4):
        got = [text[i : i + 20] for i in order[group == g]]
        assert got == sorted(text[i : i + 20] for i in at[group == g])
        assert same[group == g].tolist() == [k > 0 and got[k] == got[k - 1] for k in range(500)]


def test_collisions_of_hashes_decide_nothing(monkeypatch):
    data = np.frombuffer(b"abcabdabc", np.uint8)
    suffixes = suffix_dedup.Suffixes(data, np.array([3, 3, 3]))
    monkeypatch.setattr(suffixes, "equal", lambda x, y, n: np.ones(len(x), bool))  # every hash collides
    _, same = suffixes.classes(np.array([0, 3]), np.array([0, 0]), 3)
    assert not same.any()


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(8 << 20, 64), (20_000, 2), (20_000, 64)])
def test_substring_dedup(spark, corpus, chunk_bytes, hot):
    ids = [None, *range(1, len(corpus))]
    found = substring_dedup.substring_dedup(frame(spark, corpus, ids), hot_contexts=hot, chunk_bytes=chunk_bytes)
    assert rows(substring_dedup.digest(found)) == sorted(substring_dedup.brute_force(list(zip(ids, corpus, strict=True))), key=repr)


def test_automaton_counts():
    rng = random.Random(3)
    strings = [[rng.randrange(2) for _ in range(rng.randint(4, 12))] for _ in range(30)]
    automaton = substring_dedup.Automaton()
    for s in strings:
        automaton.add(s, 1)
    automaton.count()
    times = {}
    for s in strings:
        for k in range(len(s) - 3):
            times[tuple(s[k : k + 4])] = times.get(tuple(s[k : k + 4]), 0) + 1
    for s in strings:
        assert automaton.recurring(s, 4) == sum((times[tuple(s[k : k + 4])] > 1) << k for k in range(len(s) - 3))


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 20_000])
def test_ngram_scores(spark, corpus, chunk_bytes, tmp_path):
    import duckdb

    frame(spark, corpus).write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {r[0]: r for r in duck.sql(ngram_scores.SQL).fetchall()}
    got = ngram_scores.ngram_scores(frame(spark, corpus), chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_known) == want[r.doc_id][1:3]
        assert r.score == (None if want[r.doc_id][3] is None else pytest.approx(want[r.doc_id][3], abs=2e-6))


def test_ngram_scores_of_other_orders(spark):
    got = {r.doc_id: r for r in ngram_scores.ngram_scores(frame(spark, ["a b", "a b", "a c"], [1, 2, 3]), order=1).collect()}
    assert got[3].score == pytest.approx((np.log(3 / 6) + np.log(1 / 6)) / 2)
    got = {r.doc_id: r for r in ngram_scores.ngram_scores(frame(spark, ["a b", "a b", "a c"], [1, 2, 3]), order=2).collect()}
    assert got[1].score == pytest.approx((np.log(3 / 6) + np.log(2 / 3)) / 2)
    assert got[3].score == pytest.approx((np.log(3 / 6) + np.log(0.4 * 1 / 6)) / 2)


def test_quality(spark, sf_dir):
    """Held-out accuracy, on rows that the model has not seen."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    found = queries.op4_quality(spark, sf_dir).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in found.doc_id]).all()
    got = found.merge(labels.toPandas(), on="doc_id")
    unseen = got[got.held_out]
    assert len(unseen) > 30 and (unseen.predicted == unseen.quality).mean() > 0.9


def test_quality_scores_are_sums_of_looked_up_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.trained(docs, labels)
    texts = [(None, None), *((r.doc_id, r.text) for r in docs.limit(150).collect())]
    got = {r.doc_id: r for r in quality.scores(frame(spark, [t for _, t in texts], [i for i, _ in texts]), model).collect()}
    assert model.pairs and all(i < j for i, j in model.pairs)
    for i, t in texts:
        x, total = quality.features_of((t or "").encode()), model.base
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        for table, b in zip(model.tables, bins, strict=True):
            total += table[b]
        for (p, q), table in model.pairs.items():
            total += table[model.coarse[p][bins[p]]][model.coarse[q][bins[q]]]
        score = 1 / (1 + np.exp(-total))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.5)
    kept = quality.accepted(frame(spark, [t for _, t in texts], [i for i, _ in texts]), model).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted((i for i, r in got.items() if r.predicted), key=repr)


def test_quality_of_repeated_rows_and_labels(spark, corpus):
    """Conflicting labels of an id count as 1; copies of a labelled row teach like one."""
    labels = [(k, k % 2) for k in range(20)]
    twice = spark.createDataFrame([*labels, *labels, *((k, 0) for k in range(1, 20, 2))], "doc_id long, quality int")
    docs = frame(spark, corpus[:20])
    one = quality.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    for model in (quality.trained(docs, twice), quality.trained(docs.union(docs).union(docs), twice)):
        assert all((a == b).all() for a, b in zip(model.tables, one.tables, strict=True)) and model.base == one.base


def test_quality_learns_additive_and_paired_effects():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20)
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_quality_without_labels(spark, corpus):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, corpus, [None, *range(1, len(corpus))])
    got = quality.scores(docs, quality.trained(docs, none)).collect()
    assert len(got) == len(corpus) and {r.score for r in got} == {0.5} and not got[0].held_out
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert quality.scores(docs, quality.trained(docs, one)).first().score > 0.5


def unpacked(spark, docs, capacity=4096, **options):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, capacity=capacity, **options).collect()


@pytest.mark.parametrize(("capacity", "sequences"), [(4096, 256), (64, 4)])
def test_packing(spark, corpus, capacity, sequences):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*corpus, "<|endoftext|>x İstanbul ǅ ΑΣ", "A\x85b c \x1c d"]
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    got = unpacked(spark, frame(spark, texts).repartition(3), capacity, sequences=sequences)
    sizes, places = {}, {}
    for r in got:
        ids = np.array(want[r.doc_id], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        places.setdefault(r.doc_id, []).append((r.start, r.length))
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, p in places.items():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) == len(want[d])
    assert len(places) == len(texts)
    for s in sizes.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total == capacity or total < capacity and total & (total - 1) == 0


def test_packing_of_repeated_and_nameless_rows(spark):
    """Each row is packed; rows with a null or repeated id too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(frame(spark, ["a b c", "a b c", "x", None, "x"], [1, 1, None, None, 1]), path).collect()
    assert sorted(((r.doc_id, r.start, r.length == r.doc_tokens) for r in got), key=repr) == sorted([(1, 0, True)] * 3 + [(None, 0, True)] * 2, key=repr)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] for a, b in zip(places, places[1:], strict=False) if a[0] == b[0])


def test_packing_balances_costs():
    packer = packing.Packer(0, 100, 4, 1.0, 1.0)
    for k, n in enumerate([60, 60, 40, 40, 30, 30, 30, 30, 20, 20, 20, 20]):
        packer.add(k, np.arange(n, dtype="<u4"))
    got = packer.pack()
    cost = {}
    for _, _, n, _, _, s, _ in got:
        cost[s] = cost.get(s, 0) + n + n * n
    assert not packer.waiting and max(cost.values()) < 2 * min(cost.values())


def test_secrets_in_layers():
    secret = 'password = "abcdefghijkl"'
    start = "see "
    for wrap in (
        lambda t: urllib.parse.quote(t), lambda t: urllib.parse.quote(urllib.parse.quote(t)), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t),
        lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode())).decode(), lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
        lambda t: base64.b64encode(zlib.compress(gzip.compress(t.encode()))).decode(), lambda t: urllib.parse.quote(base64.b64encode(f"x {base64.b64encode(zlib.compress(t.encode())).decode()} y".encode()).decode()),
    ):
        text = start + wrap(secret) + " end"
        base, every = secrets.spans(text)
        assert every, text
        assert set(base) <= set(every) and all(len(start) <= a < b <= len(text) - 4 for a, _, b in every)
        assert "abcdefghijkl" not in secrets.redact(text) and wrap(secret)[-12:] not in secrets.redact(text).replace("%22", "")
    assert secrets.spans(secret)[0] == [(0, 0, 24)]


def test_secrets_with_a_plain_key_and_an_escaped_value():
    value = "s3cretvalue/0123"
    for wrap in (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"%{ord(c):02X}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: urllib.parse.quote(t, safe="").replace("%", "%25"), lambda t: f"\\x73%33{t[2:]}"):
        for before, after in (('{"password": "', '", "user": "x"}'), ("see\nsecret: ", " end"), ("token = ", "")):
            text = before + wrap(value) + after
            key = before.index(next(w for w in ("password", "secret", "token") if w in before))
            assert any(a == key and b == len(before + wrap(value)) and k == 0 for a, k, b in secrets.spans(text)[1]), text
            assert wrap(value)[-4:] not in secrets.redact(text)
    assert secrets.redact("secret: ab%2Fcdefghijklmnop end") == "[SECRET] end"
    assert secrets.redact("&#115;ecret : abcdefghijklmnop end") == "[SECRET] end"


def test_secrets_in_compressed_and_mixed_bytes():
    secret, rng = b'password = "abcdefghijkl"', random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(60))
    encoded = {
        "url": lambda b: urllib.parse.quote(b), "form": lambda b: urllib.parse.quote_plus(b), "url, all": lambda b: "".join(f"%{x:02x}" for x in b), "x": lambda b: "".join(f"\\x{x:02x}" for x in b), "repr": lambda b: repr(b),
        "u": lambda b: "".join(f"\\u{x:04x}" for x in b), "base64": lambda b: base64.b64encode(b).decode(), "characters": lambda b: b.decode("latin-1"), "url of x": lambda b: urllib.parse.quote("".join(f"\\x{x:02x}" for x in b)),
    }
    zstd = secrets.zstandard.compress
    for squeeze in (gzip.compress, zlib.compress, bz2.compress, secrets.lzma.compress, zstd, lambda b: gzip.compress(b[:13]) + gzip.compress(b[13:]), lambda b: bz2.compress(b[:13]) + bz2.compress(b[13:]), lambda b: zstd(b[:13]) + zstd(b[13:]), lambda b: b"head\x00" + zlib.compress(noise + gzip.compress(b)) + b"\xff tail"):
        for name, encode in encoded.items():
            text = f"see {encode(squeeze(secret + noise))} end"
            assert any(k == 0 and 4 <= a < b <= len(text) - 4 for a, k, b in secrets.spans(text)[1]), (name, text)
    for raw in (secret + b"\x00", b"\xff\xfe\x07" + secret + b" \xe9", noise + secret + noise):
        assert "[SECRET]" in secrets.redact(f"see {base64.b64encode(raw).decode()} end")
    cut = gzip.compress(secret + bytes(rng.randrange(256) for _ in range(9000)))[:-3000]
    assert "[SECRET]" in secrets.redact(base64.b64encode(cut).decode())
    lines = base64.encodebytes(gzip.compress(bytes(rng.randrange(256) for _ in range(300)) + secret)).decode()
    assert lines.count("\n") > 3 and "[SECRET]" in secrets.redact(f"-----BEGIN-----\n{lines}-----END-----\n")
    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        assert "[SECRET]" in secrets.redact(base64.b64encode(secret.decode().encode(code)).decode())


def test_secrets_in_large_streams():
    """Contents beyond any window are scanned to their end, streams inside them too."""
    secret = b'password = "abcdefghijkl"'
    filler = b"lorem ipsum dolor sit amet " * 400_000  # 10.8 MB
    large = bytes(68 << 20)
    inner = gzip.compress(b"x" * 100 + secret)
    for content in (filler + secret, large + secret, filler + b"\x00" + inner + b"\x00" + filler, gzip.compress(filler + secret, 0), zlib.compress(gzip.compress(large + b" " + secret))):
        text = base64.b64encode(gzip.compress(content)).decode()
        assert secrets.redact(f"see {text} end") == "see [SECRET] end"
    assert secrets.spans(base64.b64encode(gzip.compress(filler)).decode())[1] == []
    assert max(len(w) for _, w, _ in secrets.Source(gzip.compress(filler)).windows()) <= 2 * secrets.WINDOW
    deep = secret
    for _ in range(100):
        deep = gzip.compress(deep)
    assert "[SECRET]" in secrets.redact(base64.b64encode(deep).decode())


def naive_secrets(text):
    """The base spans, character by character."""
    value, plain = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), {chr(c): chr(c + 32) for c in range(65, 91)}
    low, found = "".join(plain.get(c, c) for c in text), []

    def run(at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assign(at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                k = at + len(name)
                k = run(k + (text[k : k + 1] in ("'", '"')), " ")
                if text[k : k + 1] in (":", "="):
                    k = run(k + 1, " ")
                    k += text[k : k + 1] in ("'", '"')
                    if (end := run(k, value)) > k:
                        return end, end - k >= 12
        return None

    def access(at):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        return (end, end - at >= 18) if text.startswith("AKIA", at) and end > at + 4 else None

    def digits(at):
        end = run(at, set("0123456789abcdef"))
        return (end, end - at >= 16) if end > at else None

    for kind, match in enumerate((assign, access, digits)):
        at = 0
        while at < len(text):
            if (hit := match(at)) is None:
                at += 1
            else:
                found += [(at, kind, hit[0])] * hit[1]
                at = hit[0]
    return sorted(found)


def test_base_spans_against_a_naive_scan(spark, sf_dir):
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    bits = ["password", "Token", "api_key", "AKIA", "=", ":", " ", '"', "'", "abcdef0123456789", "ABCDEFGHIJKLMNOP", "x.y/z-", "é", "\n", "secret", "0"]
    texts = [(t or "") for _, t in docs] + ["".join(rng.choice(bits) for _ in range(30)) for _ in range(3000)]
    want = {}
    for k, t in enumerate(texts):
        base, every = secrets.spans(t)
        want[k] = naive_secrets(t)
        assert base == want[k] and set(base) <= set(every)
    assert sum(map(len, want.values())) > 500
    got = {r.doc_id: r for r in queries.op7_secret_scans(spark, sf_dir).collect()}
    for k, (d, _) in enumerate(docs):
        listed = ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in want[k])
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(x[1] == kind for x in want[k]) for kind in range(3))
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))


def test_secret_rules():
    kinds = lambda t: [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.spans(t)[0]]
    assert kinds("AKIA" + "A" * 14) == [("access", "AKIA" + "A" * 14)] and kinds("AKIA" + "A" * 13) == []
    assert kinds("0123456789abcdef0123456789ABCDEF") == [("hex", "0123456789abcdef0123456789")]
    assert kinds("secret=token:abcdefghijklmnop") == []  # the first match takes the second's name
    assert kinds("API_Key: 'abcdefghijkl'") == [("assign", "API_Key: 'abcdefghijkl")] and kinds("paſsword=abcdefghijkl") == []


def test_secrets_end_on_cycles_and_odd_input():
    for text in ("%25" * 300, "\\u005cu0041" * 50, "QUJD" * 200, "%ZZ %", "&#99999999; &#xD800;", "\\ud83d\\ude00" * 3, "=" * 50, "A" * 100_000):
        secrets.spans(text)


def test_secret_scan(spark, corpus):
    texts = [*corpus, "token=abcdefghijklmnop 0123456789abcdef", "日本 secret: abcdefghijkl"]
    got = secrets.secret_scan(frame(spark, texts, [None, *range(1, len(texts))])).collect()
    assert len(got) == len(texts) and (got[-2].n_assign, got[-2].n_hex, got[-1].spans) == (1, 1, "assign:3:23")
    assert got[1].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize("shard", [16 << 20, 700])
def test_decontamination(spark, corpus, shard):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate((20, 13, 12, 1, 3, 40, 0, 30))] + [(10, None), (11, "Ça VA, bien"), (5, "again " + prose(rng, 14)), (None, "one")]
    texts = [*corpus, items[0][1].upper() + "!", "x " + items[5][1] + " y " + items[7][1][:90], prose(rng, 300) + " " + items[2][1], "ça va bien", items[5][1] + " " + items[5][1]]
    ids = [None, *range(1, len(texts))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, spans int")
    found = decontamination.matches(frame(spark, texts, ids), bench, max_shard_bytes=shard)
    want = decontamination.brute_force(list(zip(ids, texts, strict=True)), [x for x in items if x[0] is not None])
    assert rows(decontamination.digest(found)) == sorted(want, key=repr)
    assert sum(w[-1] for w in want) > 3
    copies = decontamination.matches(frame(spark, [*texts, texts[-1], texts[-1]], [*ids, ids[-1], 7000]), bench, max_shard_bytes=shard)
    assert copies.count() == len(texts) + 2 and len(set(map(str, copies.where(F.col("doc_id").isin(ids[-1], 7000)).select("spans", "items").collect()))) == 1
    kept = decontamination.clean(frame(spark, texts, ids).withColumn("row", F.lit(1)), bench, max_shard_bytes=shard).withColumn("row", F.lit(1).cast("int"))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[-1]), key=repr) and kept.columns == frame(spark, ["x"]).columns


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.normal(size=8) / 3).astype(float).tolist()) for i in range(1000)]
    vectors += [(1000 + i, vectors[i % 7][1]) for i in range(40)]  # ties
    odd = [(200, None), (2000, [float("nan")] * 8), (2100, [None] * 8), (2200, [1.0] * 3), (None, [1.0] * 8), (2300, []), (2400, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors if i != 200] + [(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, score int").repartition(4)
    good = [(i, v) for i, v in vectors if i != 200]
    matrix, ids = np.floor(1024 * np.array([v for _, v in good])).astype(int), np.array([i for i, _ in good])
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        scores = matrix @ matrix[q]
        best = [j for j in np.lexsort((ids, -scores)) if j != q][:10]
        want += [(int(ids[q]), rank, int(ids[j]), int(scores[j])) for rank, j in enumerate(best, 1)]
    got = [tuple(r) for r in topk.top_k(table, block=block).collect() if r.query_id != 2200]
    assert sorted(got) == sorted(want)


def test_bounds_hold_and_spare_exact_vectors(spark):
    rng = np.random.default_rng(5)
    for scale in (1, 300, 1 << 20):
        matrix = np.floor(rng.normal(size=(500, 24)) * scale)
        low = matrix.min(axis=0)
        width = np.maximum((matrix.max(axis=0) - low) / 256, 0.5)
        below, above = topk.bounded(matrix[:20], np.minimum((matrix - low) // width, 255).astype(np.uint8), low, width)
        exact = matrix[:20] @ matrix.T
        assert (below <= exact).all() and (exact <= above).all()
    vectors = rng.normal(size=(20_000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    rows = topk.integer_vectors(table, "vec_id", "embedding", 1024)
    asked = rows.where("id % 500 = 0").toArrow()
    found, _ = topk.candidates(topk.approximated(rows), asked["id"].to_numpy(), asked["v"].to_pylist(), 10)
    assert 40 * 10 <= topk.survivors(found, 10).count() < 0.005 * 40 * 20_000  # of all pairs, the exact vectors read


def test_top_k_of_vectors_that_many_rows_share(spark):
    """No copy counts that can't be among the best, and none that can is lost."""
    rng = np.random.default_rng(6)
    loose = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(1, 300)]
    common = [float(x) for x in (9, 9, 9, -9, 9, 9)]
    copies = [(i, common) for i in range(290, 900)] + [(300, common)] * 15 + [(296, common)] * 12 + [(297, common)] * 3 + [(100, loose[3][1])] * 14
    rows = loose + copies
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    few = topk.thinned(topk.integer_vectors(table, "vec_id", "embedding", 1), 10)
    assert few.where(F.col("v") == F.array(*map(F.lit, map(int, common)))).count() == 8 + 10 + 10 + 4  # ids 290 to 300, three of them repeated
    want, first = [], {}
    for i, v in rows:
        if i % 100 == 0:
            first[i] = min(first.get(i, v), v)
    for q, v in first.items():
        found = sorted((-int(np.dot(v, x)), j) for j, x in rows if j != q)[:10]
        want += [(q, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in topk.top_k(table, scale=1).collect()) == sorted(want)


def test_top_k_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(table).orderBy("rank").collect()] == [(0, 1, 1, 512 * 1024), (0, 2, 2, 512 * 1024)]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash(spark, corpus):
    ids = [3 * k % 103 for k in range(len(corpus))]
    texts = [*corpus, corpus[20].upper(), None]
    ids += [500, None]
    got = simhash.digest(simhash.near_duplicates(frame(spark, texts, ids))).collect()
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    label = simhash.components(len(texts), i, j)
    least = {c: min(d for d, x in zip(ids, label, strict=True) if x == c and d is not None) for c in set(label.tolist())}
    want = sorted(((d, f"{int(p):016x}", least[c]) for d, p, c in zip(ids, prints, label.tolist(), strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def edited(rng, text, edits):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"edit{rng.random()}"
    return " ".join(words)


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("most", [16_384, 5])
def test_similar_texts(spark, most):
    """Pairs of a similarity of 0.8 or more become one, unlike texts stay apart."""
    rng = random.Random(11)
    texts = [prose(rng, 300, 20_000) for _ in range(150)]
    copies = [edited(rng, t, 1 + k % 7) for k, t in enumerate(texts[:100])]
    close = [k for k, c in enumerate(copies) if jaccard(c, texts[k]) >= 0.8]
    assert 80 < len(close)
    found = {r.id: r.root for r in simhash.similar(frame(spark, texts + copies), most=most).collect()}
    assert sum(found[k] == found[150 + k] for k in close) >= 0.9 * len(close)
    assert len({bytes(found[k]) for k in range(150)}) == 150


def test_places_of_keys():
    """As a binary search, in less time."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 1000, 400_000):
        keys = np.unique(np.r_[rng.integers(0, 1 << 64, n, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)[: n - 1]])
        wanted = rng.choice(keys, 3 * n)
        assert (ngram_scores.places(keys, wanted) == np.searchsorted(keys, wanted)).all()
    close = np.arange(50, dtype=np.uint64)
    assert ngram_scores.places(close, close[::-1]).tolist() == list(range(50))[::-1]
    assert len(ngram_scores.places(keys[:0], keys[:0])) == 0

    def seconds(way):
        spent = []
        for _ in range(3):
            began = time.process_time()
            way(keys, wanted)
            spent.append(time.process_time() - began)
        return min(spent)

    assert seconds(ngram_scores.places) < seconds(np.searchsorted)


@pytest.mark.parametrize("most", [1, 6])
def test_similar_texts_under_frequent_keys(spark, most):
    """Groups don't depend on how many fingerprints share a key: pairs under frequent keys are compared in full."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(12):  # families of texts with similarities around the least that links
        base = [rng.choice(words) for _ in range(150)]
        for k in range(8):
            text = list(base)
            for i in rng.sample(range(150), 1 + k % 3):
                text[i] = rng.choice(words)
            texts.append(" ".join(text))
    groups = lambda most: sorted(map(sorted, _by_root(simhash.similar(frame(spark, texts), most=most))))
    assert groups(most) == groups(16_384)
    # no pair linked before: every link of the exact way, against all pairs
    fps = [i.to_bytes(64, "little") for i in (0, 1, 3, 7, 1 << 100, (1 << 40) - 1, (1 << 41) - 1, (1 << 300) - 1)]
    rows = spark.createDataFrame([(f, k) for k in (1, 2) for f in fps], "fp binary, key long")
    link = lambda found, nodes: simhash.components(len(nodes), np.array([nodes.index(bytes(r.a)) for r in found], int), np.array([nodes.index(bytes(r.b)) for r in found], int)).tolist()
    pairs = [Row(a=a, b=b) for a, b in combinations(fps, 2) if (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() <= 2]
    assert link(simhash.across(rows, None, 2, most).collect(), fps) == link(pairs, fps) == [0, 0, 0, 0, 0, 5, 5, 7]
    labels = spark.createDataFrame([(f, fps[0]) for f in fps[:4]], "node binary, root binary")
    found = link(simhash.across(rows, labels, 2, most).collect(), fps)
    assert found == [0, 1, 2, 3, 0, 5, 5, 7]
    assert simhash.across(rows.where(F.col("fp").isin(fps[:4])), labels, 2, most).count() == 0


def _by_root(found):
    groups = {}
    for r in found.collect():
        groups.setdefault(bytes(r.root), []).append(r.id)
    return groups.values()


def test_representatives_are_rows(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 80, 20_000) for _ in range(3))
    kept = lambda texts, ids: sorted(((r.doc_id, r.text) for r in simhash.representatives(frame(spark, texts, ids).withColumn("__id", F.lit(1)).withColumn("digest", F.lit(2))).collect()), key=repr)
    assert kept([a, b, c], [3, 3, 5]) == sorted([(3, a), (3, b), (5, c)])
    assert kept([a, a, b], [3, 5, 5]) == sorted([(3, a), (5, b)])
    assert kept([a, a, a, b, b], [4, 4, 7, 2, 2]) == sorted([(4, a), (2, b)])
    assert kept([a, a, b, None, "", " "], [None, 9, None, 5, 6, None]) == sorted([(9, a), (None, b), (5, None)], key=repr)
    assert kept([], []) == []
    docs = frame(spark, [a] * 2, [1, 1]).withColumn("x", F.monotonically_increasing_id())
    assert simhash.representatives(docs).columns == docs.columns and simhash.representatives(docs).count() == 1
    assert simhash.representatives(frame(spark, [a, a, b], [3, 5, 5]), broadcast_rows=0).count() == 2


def test_layout_keeps_its_recall():
    assert simhash.layout(1000, 0.8, 0.9)[0] == 2
    for n in (1000, 1 << 28, 1 << 36):
        width, words = simhash.layout(n, 0.8, 0.9)
        assert n / 256**width <= 4097 and 1 - (1 - (1 - simhash.differing_share(0.8)) ** (8 * width)) ** (8 * words // width) >= 0.9


def test_links_under_frequent_keys(spark):
    """Splitting a frequent key finer loses no link."""
    rng = np.random.default_rng(7)
    near = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 600).astype(np.uint64))
    fps = np.unique(np.r_[near, rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    distinct = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    want = simhash.components(len(fps), i, j)
    for most in (4096, 20):
        labels = {r.node: r.root for r in simhash.contracted(simhash.links(distinct, len(fps), 3, 6, most)).collect()}
        got = [labels.get(f, f) for f in fps.view(np.int64).tolist()]
        assert len(set(zip(got, want.tolist(), strict=True))) == len(set(got)) == len(set(want.tolist()))


@pytest.mark.parametrize("size", [50, 5000])
def test_links_in_large_groups(size):
    rng = np.random.default_rng(6)
    near = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 40, size).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, size).astype(np.uint64))
    spread = rng.integers(0, 1 << 32, size, dtype=np.uint64) | np.uint64(0xABCDEF) << np.uint64(40)
    fps = np.unique(np.r_[near, spread])
    order = np.sort(fps.view(np.int64))
    a, b = simhash.stars(np.zeros(len(order), np.int64), np.arange(len(order)), order.view(np.uint64)[:, None], 3)
    got = simhash.components(len(order), a, b)
    pairs = [np.nonzero(np.bitwise_count(order[k : k + 500].view(np.uint64)[:, None] ^ order.view(np.uint64)[None]) <= 3) for k in range(0, len(order), 500)]
    want = simhash.components(len(order), np.concatenate([p[0] + 500 * k for k, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs]))
    assert got.tolist() == want.tolist()


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.contracted(edges).collect()}
    assert len({got[k] for k in range(301)}) == 1 and got[1001] == got[1000] != got[0]


def test_masks_keep_close_pairs():
    rng = random.Random(8)
    chosen = simhash.masks(6, 3)
    assert len(chosen) == 20
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << rng.randrange(64)
        assert any(a & m == b & m for m in chosen)


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert spark.range(1).select(F.lit(1)).count() == 1
