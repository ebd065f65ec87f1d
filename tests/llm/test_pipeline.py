"""The pipeline's stages, each against a plain version over the documents that the stage before kept."""

import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracequarry.llm import decontamination, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out, docs = {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages(stages, spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    docs = {n: {r.doc_id: r.text for r in stages[n].collect()} for n in ["documents", *names[:-1]]}
    a, b, c, d, e = (docs[n] for n in ["documents", *names[:-1]])
    model = quality.trained(stages["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.scores(stages["documents"], model).where("predicted = 1").collect()}
    assert set(b) == good < set(a)
    assert set(c) <= set(b)
    sets = {k: set(zip(*((t or "").split()[i:] for i in range(5)), strict=False)) for k, t in b.items()}
    same = {(i, j): len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i, j in combinations(sorted(b), 2)}
    assert not [p for p, s in same.items() if s == 1 and set(p) <= set(c)]
    close = [p for p, s in same.items() if s >= 0.8]
    assert sum(set(p) <= set(c) for p in close) <= 0.1 * len(close)
    lonely = set(b) - {k for p, s in same.items() if s >= 0.6 for k in p}
    assert {k for k in lonely if sets[k]} <= set(c) and lonely
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(d) == {w[0] for w in decontamination.brute_force(list(c.items()), items) if not w[-1]}
    assert e == {k: secrets.redact(t) for k, t in d.items()} and e != d
    assert stages[names[3]].where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = stages[names[4]].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(e) and all(r.n == r.all for r in pieces)


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"].count()


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, columns with other operators' names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, d, item, huge = text(90), text(90), text(90), text(90), text(30), text(60_000)
    texts = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, d), (3, None), (3, ""), (4, huge), (5, text(20) + " " + item), (6, f"{text(40)} password = abcdefghijklmnop"), (6, f"{text(40)}")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, root string, id int, digest string, `__id` int, spans int"
    docs = spark.createDataFrame([(i, t, None, "s", None, "r", 1, "d", 2, None) for i, t in texts], kind)
    spark.createDataFrame([(1, item), (None, a), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or after.columns == docs.columns
        out[name], docs = after, after
    rows = lambda name: sorted(((r.doc_id, zlib.crc32((r.text or "").encode())) for r in out[name].collect()), key=repr)
    crc = lambda rows: sorted(((i, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert rows("quality_classifier") == crc(texts)  # no label: nothing is rejected
    kept = [(1, a), (1, b), (None, c), (None, d), (3, None), *texts[8:]]
    assert rows("simhash_near_dedup") == crc(kept)
    kept = [r for r in kept if r[0] != 5]
    assert rows("benchmark_decontamination") == crc(kept)
    assert rows("secret_scans") == crc([(i, t and t.replace("password = abcdefghijklmnop", "[SECRET]")) for i, t in kept])
    pieces = out["packing"].collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id == 3) == 1 and {r.doc_id for r in pieces} == {i for i, _ in kept}


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
