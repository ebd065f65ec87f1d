"""Sources, evaluation, generation, streaming, and all queries against their SQL."""

import datetime
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import naming
from tracequarry.operators import evaluation, generation, representation, tasks
from tracequarry.oracles import ORACLES
from tracequarry.plans import pipeline
from tracequarry.plans.features import feature_table, long_form
from tracequarry.queries import QUERIES
from tracequarry.model import from_positions
from tracequarry.sources import config, tables
from tracequarry.sources.files import copy_matching
from tracequarry.streaming import events as streaming
from tracequarry.sources.xes import read_xes, read_xes_rows, unreadable, write_xes


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            connection.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, sf_dir, duck, name):
    rel = duck.sql(ORACLES[name])
    names, want = rel.columns, rel.fetchall()
    table = QUERIES[name](spark, sf_dir)
    assert sorted(table.columns) == sorted(names)
    got = [tuple(plain(r[c]) for c in sorted(names)) for r in table.collect()]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()


XES = """<?xml version="1.0"?>
<log xmlns="http://www.xes-standard.org/">
<trace><string key="concept:name" value="10"/><event><string key="concept:name" value="a &amp; b"/><date key="time:timestamp" value="2024-01-01T00:00:00"/></event></trace>
<trace><string key="concept:name" value="9"/></trace>
<trace><string key="concept:name" value="8"/><event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T00:00:00"/></event><event><string key="concept:name" value="b"/><string key="lifecycle:transition" value="start"/><date key="time:timestamp" value="2024-01-01T00:00:01"/></event></trace>
</log>"""


def test_xes_round_trip(spark, tmp_path):
    (tmp_path / "one_1.xes").write_text(XES)
    (tmp_path / "notes.txt").write_text("not a log")
    log = read_xes(spark, str(tmp_path))
    assert [(r.log, r.case_id, r.n_events) for r in log.traces.orderBy("seen").collect()] == [("one_1", "9", 0), ("one_1", "10", 1), ("one_1", "8", 2)]
    assert read_xes_rows(spark, str(tmp_path)).where("size(events) = 2").first().events[1].lifecycle == "start"
    assert unreadable(read_xes_rows(spark, str(tmp_path))).collect() == []
    write_xes(log, str(tmp_path / "out"))
    text = (tmp_path / "out" / "one_1.xes").read_text()
    assert text.startswith("<?xml") and text.count("<extension") == 3 and text.count("<global") == 2 and text.rstrip().endswith("</log>")
    again = read_xes(spark, str(tmp_path / "out"))
    assert again.events.select("log", "case_id", "pos", "activity", "ts").exceptAll(log.events.select("log", "case_id", "pos", "activity", "ts")).count() == 0
    assert again.traces.count() == 3
    (tmp_path / "below/a/b").mkdir(parents=True)
    (tmp_path / "below/a/b/two.xes").write_text(XES.replace('value="8"/>', 'value="8"/><event'))
    with pytest.warns(UserWarning, match="1 of two"):
        assert read_xes(spark, str(tmp_path / "below")).traces.count() == 2
    with pytest.raises(FileNotFoundError):
        read_xes(spark, str(tmp_path / "below"), ".log")


def test_odd_log_names(spark, tmp_path):
    names = ["a/b", "50% + x", "ü:1", ""]
    log = from_positions(spark.createDataFrame([(n, "c", 1, "x", None) for n in names], "log string, case_id string, pos long, activity string, ts timestamp"))
    write_xes(log, str(tmp_path / "logs"))
    assert sorted(r.log for r in read_xes(spark, str(tmp_path / "logs")).traces.collect()) == sorted(names)


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "grid_rmcv_enve.csv").write_text("task,rmcv,epa_normalized_variant_entropy\nt1,0.1,NaN\nt2,0.2,0.5\n")
    got = tables.tasks(spark, str(tmp_path / "grid_rmcv_enve.csv"))
    assert got.columns == ["log", "ratio_most_common_variant", "epa_normalized_variant_entropy"] and got.where("epa_normalized_variant_entropy is null").count() == 1
    assert list(tables.tasks(spark, str(tmp_path), "ratio_most_common_variant")) == ["epa_normalized_variant_entropy"]
    some = tables.tasks(spark, {"input_path": str(tmp_path / "grid_rmcv_enve.csv"), "objectives": ["ratio_most_common_variant"]})
    assert some.columns == ["log", "ratio_most_common_variant"]
    assert tables.tasks(spark, [{"log": "a", "rmcv": 0.1}, {"log": "b", "mvo": 2}]).count() == 2
    assert tables.tasks(spark, {"rmcv": 0.3}).first().log == "1"
    with pytest.raises(ValueError):
        tables.tasks(spark, "nowhere")
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"log": "a", "rmcv": 0.5}')
    (tmp_path / "j/b.json").write_text('{"log": "b", "mvo": 2}')
    got = {r.log: r for r in tables.read_feature_json(spark, str(tmp_path / "j")).collect()}
    assert got["a"].ratio_most_common_variant == 0.5 and got["b"].ratio_most_common_variant is None
    (tmp_path / "m_1.csv").write_text("log,x\na,1\nb,2\n")
    (tmp_path / "m_2.csv").write_text("log,y\nb,3\nc,4\n")
    assert sorted((r.log, r.x, r.y) for r in tables.merge_csvs(spark, str(tmp_path), "m_").collect()) == [("a", 1, None), ("b", 2, 3), ("c", None, 4)]
    tables.write_feature_csv(some, str(tmp_path / "w_feat.csv"))
    assert (tmp_path / "w_feat.csv").is_file() and tables.read_features(spark, str(tmp_path / "w_feat.csv")).count() == 2
    (tmp_path / "j/lines.json").write_text('{"log": "c", "rmcv": NaN}\n{"log": "d", "rmcv": 0.25}\n')
    (tmp_path / "j/spread.json").write_text('{\n "log": "e",\n "rmcv": 0.75\n}\n')
    got = {r.log: r.ratio_most_common_variant for r in tables.read_feature_json(spark, str(tmp_path / "j")).collect()}
    assert got == {"a": 0.5, "b": None, "c": None, "d": 0.25, "e": 0.75}
    tables.merge_jsons(spark, str(tmp_path / "j"), str(tmp_path / "merged.csv"))
    assert (tmp_path / "merged.csv").read_text().count("\n") == 6
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.merge_jsons(spark, str(tmp_path / "none"), str(tmp_path / "x.csv"))


def test_copies_of_instances(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/deep/a_1.xes").write_text("x")
    with pytest.warns(UserWarning, match="no file matches b"):
        assert copy_matching(spark, ["a_*.xes", "b.xes"], str(tmp_path / "src"), str(tmp_path / "to")) == 1
    assert (tmp_path / "to/deep_a_1.xes").read_text() == "x"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('[{"pipeline_step": "a", "pipeline_step": "b"}]')
    assert config.read_config(str(tmp_path / "c.json")) == [{"pipeline_step": "b"}]
    (tmp_path / "d.json").write_text('{"pipeline_step": "a"}')
    with pytest.raises(ValueError):
        config.read_config(str(tmp_path / "d.json"))


def test_command_line_needs_a_configuration(capsys, monkeypatch):
    from tracequarry.__main__ import main

    monkeypatch.setattr("sys.argv", ["tracequarry"])
    with pytest.raises(SystemExit):
        main()
    assert "--algorithm-configs" in capsys.readouterr().err


def test_names(spark):
    assert naming.abbreviation(["ratio_top_20_variants", "epa_normalized_sequence_entropy"]) == "rt20v_ense"
    assert naming.output_location({"mvo": 1.5, "a": 0.12346}, "out", "x") == "out/2_a_m/x_01235_15"
    assert naming.output_location({f"k{i}": 0 for i in range(8)}, "out", "x") == "out/8_features/x"
    rows = spark.createDataFrame([("b_2",), ("b_10",), ("B_1",)], "f string")
    assert [r.f for r in rows.orderBy(naming.natural_key(F.col("f"))).collect()] == ["B_1", "b_2", "b_10"]
    long = spark.createDataFrame([("x1" + "0" * 30,), ("x9" + "0" * 29,), ("x007",)], "f string")
    assert [len(r.f) for r in long.orderBy(naming.natural_key(F.col("f"))).collect()] == [4, 31, 32]
    assert rows.select(naming.suffix_number(F.lit("some_log_168.xes")).alias("n")).first().n == 168


def test_similarity(spark):
    targets = long_form(spark.createDataFrame([("a", 0.2, 0.4), ("b", None, 0.4), ("c", 0.2, float("nan")), ("d", 0.1, 0.1)], "log string, x double, y double"))
    achieved = long_form(spark.createDataFrame([("a", 0.20017714791851102, 0.052097205658647006), ("b", 0.0, 0.052097205658647006), ("c", 0.2, 0.0)], "log string, x double, y double"))
    got = {r.log: r.target_similarity for r in evaluation.target_similarity(targets, achieved).collect()}
    assert got["a"] == pytest.approx(0.7418932364693801) and got["b"] == pytest.approx(0.7418932612931081) and got["c"] == 1 and got["d"] is None


def test_hull_and_scaling(spark):
    points = spark.createDataFrame([("s", float(x), float(y)) for x in range(5) for y in range(5)], "s string, x double, y double")
    assert {(r.x, r.y) for r in representation.convex_hulls(points, "s", "x", "y").collect()} == {(0, 0), (4, 0), (4, 4), (0, 4)}
    got = representation.standardize(spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "log string, x double, y double"), ["x", "y"]).orderBy("log").collect()
    assert [(r.x, r.y) for r in got] == [(-1, 0), (1, 0)]
    assert representation.l2_normalize(spark.createDataFrame([("a", 3.0, 4.0), ("z", 0.0, 0.0)], "log string, x double, y double"), ["x", "y"]).orderBy("log").first().x == 0.6


def test_tasks(spark):
    assert tasks.value_grid(spark).count() == 121 and tasks.single_grid(spark).count() == 11
    pairs = tasks.objective_pairs(spark.createDataFrame([("c",), ("a",), ("b",)], "feature string")).collect()
    assert sorted(map(tuple, pairs)) == [("a", "b"), ("a", "c"), ("b", "c")]
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y")).repartition(6)
    assert {r.x: r.task for r in tasks.numbered(rows, ["x"]).collect()} == {k: f"task_{k + 1}" for k in range(5000)}
    assert tasks.numbered(rows.limit(0), ["x"]).collect() == []


def test_generation_is_deterministic(spark):
    import random

    configs = generation.drawn(generation.config_space({"mode": [6], "num_traces": [2500], "loop": [0.2], "sequence": [1], "choice": [1], "parallel": [0.5]}), 2, random.Random(1))
    trials = generation.trial_table(spark, configs, 7)
    one, two = (generation.play_out(trials, n).events.select("log", "case_id", "pos", "activity") for n in (1000, 137))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    assert {r.log: r.n_traces for r in feature_table(generation.play_out(trials), ["n_traces"]).collect()} == {"trial_0": 2500, "trial_1": 2500}
    tree = generation.process_tree(configs[0], 7)
    nodes = generation.adjacency(tree)
    assert len({n[4] for n in nodes if n[4]}) == 6 and nodes[0][1] is None
    with pytest.raises(NotImplementedError):
        generation.simulated(trials, "DEF")


def test_pipeline(spark, tmp_path):
    step = {"pipeline_step": "event_logs_generation", "output_path": str(tmp_path / "out"), "generator_params": {"experiment": [{"log": "t", "ratio_variants_per_number_of_traces": 0.3, "rmcv": 0.2}], "config_space": {"mode": [4, 6], "num_traces": [30, 60], "sequence": [0.01, 1], "choice": [0.01, 1], "parallel": [0.01, 1], "loop": [0.01], "silent": [0.01]}, "n_trials": 6}}
    (tmp_path / "one_1.xes").write_text(XES)
    steps = [step, {"pipeline_step": "feature_extraction", "input_path": str(tmp_path / "one_1.xes"), "feature_params": {"feature_set": ["simple_stats"]}}, {"pipeline_step": "evaluation_plotter", "input_path": "", "output_path": "", "targets": [{"log": "t", "rmcv": 0.2}]}, {"pipeline_step": "benchmark_test"}]
    (tmp_path / "steps.json").write_text(json.dumps(steps))
    with pytest.warns(UserWarning):
        got = pipeline.run(spark, config.read_config(str(tmp_path / "steps.json")))
    assert [n for n, _ in got] == ["event_logs_generation", "feature_extraction", "evaluation_plotter"]
    assert got[0][1].first().target_similarity > 0.5 and got[1][1].first().n_traces == 3
    assert 0 < got[2][1]["similarity"].first().target_similarity <= 1
    assert (tmp_path / "out/2_rmcv_rvpnot/t.xes").is_file() and (tmp_path / "out/features/2_rmcv_rvpnot/t.json").is_file()


def test_generation_then_extraction(spark, tmp_path):
    """A configuration as users have it: the default method by name, then features of what it wrote."""
    space = {"mode": [5, 20], "sequence": [0.01, 1], "choice": [0.01, 1], "parallel": [0.01, 1], "loop": [0.01, 1], "silent": [0.01, 1], "lt_dependency": [0.01, 1], "num_traces": [10, 100], "duplicate": [0], "or": [0]}
    steps = [
        {"pipeline_step": "event_logs_generation", "output_path": f"{tmp_path}/out", "generator_params": {"simulation_method": "PTLG", "experiment": {"epa_normalized_sequence_entropy_linear_forgetting": 0.2, "ratio_top_20_variants": 0.4}, "config_space": space, "n_trials": 2}},
        {"pipeline_step": "feature_extraction", "input_path": f"{tmp_path}/out", "feature_params": {"feature_set": ["trace_length", "ratio_top_20_variants"]}, "output_path": f"{tmp_path}/plots"},
    ]
    made, read = (r for _, r in pipeline.run(spark, steps))
    assert read.count() == made.count() == 1 and read.first().trace_len_max > 0
    assert read.first().ratio_top_20_variants == pytest.approx(made.first().ratio_top_20_variants)
    assert (tmp_path / "plots/out_feat.csv").is_file()
    with pytest.raises(NotImplementedError):
        pipeline.run(spark, [{**steps[0], "generator_params": {**steps[0]["generator_params"], "simulation_method": "DEF"}}])


def test_search_comes_close(spark):
    """Four tasks, and how similar a model-based optimiser gets in 50 trials."""
    one, two = "ratio_top_20_variants", "epa_normalized_sequence_entropy_linear_forgetting"
    targets = spark.createDataFrame([("a", 0.2, 0.4), ("b", 0.4, 0.7), ("c", None, 0.4), ("d", 0.2, None)], f"log string, {one} double, {two} double")
    space = {**generation.DEFAULT_SPACE, "mode": [5, 20], "num_traces": [20, 200]}
    got = {r.log: r.target_similarity for r in generation.search(spark, targets, space, n_trials=50)[0].collect()}
    assert all(got[k] >= least - 0.02 for k, least in (("a", 0.74), ("b", 0.61), ("c", 0.74), ("d", 1.0))), got


def test_surrogate_predicts():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((60, 3))
    f = lambda x: np.c_[np.sin(3 * x[:, 0]), x[:, 1] * x[:, 2]]
    at = rng.random((200, 3))
    mean, doubt = generation.surrogate(x, f(x))(at)
    assert np.abs(mean - f(at)).mean() < 0.1 and doubt.min() >= 0 and generation.surrogate(x, f(x))(x)[1].mean() < doubt.mean()


def test_principal_components(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(40, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    table = spark.createDataFrame([(f"l{i}", *map(float, row)) for i, row in enumerate(x)], "log string, a double, b double, c double")
    points, shares, weights = representation.principal_components(table, ["a", "b", "c"])
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    v = v[:2] * np.sign(v[np.arange(2), np.abs(v[:2]).argmax(axis=1)])[:, None]
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2].tolist())
    got = {r.feature: (r.pc1, r.pc2) for r in weights.collect()}
    assert [got[c] for c in "abc"] == [pytest.approx(tuple(w)) for w in v.T]
    found = {r.log: (r.pc1, r.pc2) for r in points.collect()}
    assert all(found[f"l{i}"] == pytest.approx(tuple(row)) for i, row in enumerate(centred @ v.T))


def test_streams_keep_and_forget(spark, tmp_path):
    """State of a case over batches, and its end when the watermark has passed it."""
    kind = "case_id string, event_id long, activity string, ts timestamp"
    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    for k, rows in enumerate(([("c", 1, "a", hour(0)), ("d", 2, "x", hour(1))], [("c", 3, "b", hour(2))], [("d", 4, "y", hour(200))], [("d", 5, "y", hour(201))], [("c", 6, "z", hour(202))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = {r.case_id: (r.n_events, r.prefix) for r in streaming.finished(streaming.case_prefixes(stream), "update", f"{tmp_path}/out", ["case_id"]).collect()}
    assert got == {"c": (1, "z"), "d": (3, "x>y>y")}


def test_cases_that_share_a_bucket(spark, tmp_path):
    """Cases are kept and forgotten one by one, however few rows of the state store they share; Python is called per bucket, not per case."""
    kind = "case_id string, event_id long, activity string, ts timestamp"
    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    first = [(f"k{i}", 10 * i + j, "ab"[j], hour(1 - j)) for i in range(300) for j in (0, 1)]
    batches = (first, [("k0", 1, "c", hour(2)), ("k0", 0, "b", hour(2))], [("k1", 2, "y", hour(200))], [("k1", 3, "y", hour(201))], [("k1", 4, "w", hour(202)), ("k2", 5, "z", hour(202))])
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for buckets in (1, 7):
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        folder = f"{tmp_path}/out{buckets}"
        got = {r.case_id: (r.n_events, r.prefix) for r in streaming.finished(streaming.case_prefixes(stream, buckets=buckets), "update", folder, ["case_id"]).collect()}
        assert got == {f"k{i}": (2, "b>a") for i in range(300)} | {"k0": (4, "b>a>b>c"), "k1": (5, "b>a>y>y>w"), "k2": (1, "z")}
        assert spark.read.format("statestore").option("batchId", 0).load(f"{folder}/checkpoint").count() == buckets
