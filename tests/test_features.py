"""Features of a log that can be counted by hand, properties of others, and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.registry import FAMILIES, FEATURES, resolve
from tracequarry.model import from_positions, tables
from tracequarry.operators import automaton, entropies
from tracequarry.plans.features import feature_table, long_form, wide_form


def log_of(spark, traces, name="m"):
    rows = [(name, str(i), j + 1, a, j * 1000, [i]) for i, t in enumerate(traces) for j, a in enumerate(t)]
    events = spark.createDataFrame(rows, "log string, case_id string, pos long, activity string, ts long, place array<long>").withColumn("ts", F.timestamp_seconds("ts"))
    empty = spark.createDataFrame([(name, str(i), [i]) for i, t in enumerate(traces) if not t], "log string, case_id string, place array<long>")
    return from_positions(events, empty)


@pytest.fixture(scope="module")
def mini(spark):
    return feature_table(log_of(spark, ["abc", "abc", "ac", "abd", "b"])).first().asDict()


HAND = {
    "n_traces": 5, "n_unique_traces": 4, "ratio_variants_per_number_of_traces": 0.8, "ratio_most_common_variant": 0.4, "ratio_top_1_variants": 0, "ratio_top_20_variants": 0, "ratio_top_50_variants": 0.6, "ratio_top_75_variants": 0.8,
    "trace_len_min": 1, "trace_len_max": 3, "trace_len_mean": 2.4, "trace_len_median": 3, "trace_len_variance": 0.64, "trace_len_std": 0.8, "trace_len_q1": 2, "trace_len_q3": 3, "trace_len_skewness": -0.84375, "trace_len_kurtosis": -0.921875, "trace_len_mode": 3,
    "trace_len_entropy": 1.545422903193594, "trace_len_geometric_mean": 2.22064303492292, "trace_len_harmonic_mean": 2.0, "trace_len_hist1": 1, "trace_len_hist6": 1, "trace_len_hist10": 3, "trace_len_hist2": 0,
    "n_unique_activities": 4, "activities_mean": 3, "activities_median": 3.5, "activities_variance": 1.5, "activities_q1": 2.5, "activities_skewness": -0.8164965809, "activities_kurtosis": -1,
    "n_unique_start_activities": 2, "start_activities_variance": 2.25, "start_activities_q1": 1.75, "start_activities_kurtosis": -2, "n_unique_end_activities": 3, "end_activities_mean": 5 / 3, "end_activities_skewness": 0.7071067812,
    "eventropy_trace": 1.9219280948873623, "eventropy_prefix": 2.3553885422, "eventropy_prefix_flattened": 2.4193819456, "eventropy_global_block": 3.1180782093, "eventropy_k_block_ratio_1": 1.8553885422, "eventropy_k_block_diff_3": 0.9182958341 - 1.8423709932,
    "epa_variant_entropy": 7.4547199494, "epa_normalized_variant_entropy": 0.6934264036, "epa_sequence_entropy": 10.0438586014, "epa_normalized_sequence_entropy": 0.3368288370,
    "epa_sequence_entropy_linear_forgetting": 4.0091065782, "epa_normalized_sequence_entropy_linear_forgetting": 0.1344485979, "epa_sequence_entropy_exponential_forgetting": 6.2645496874, "epa_normalized_sequence_entropy_exponential_forgetting": 0.2100866877,
}


@pytest.mark.parametrize("name", HAND)
def test_hand_counted(mini, name):
    assert mini[name] == pytest.approx(HAND[name], abs=1e-9, rel=1e-9)


def test_identities(mini):
    assert len(FEATURES) == len(mini) - 1 == 103 and len(FAMILIES) == 8
    assert mini["n_unique_activities"] * mini["activities_mean"] == 12
    assert mini["eventropy_k_block_diff_1"] == mini["eventropy_k_block_ratio_1"]
    assert sum(mini[f"trace_len_hist{i}"] for i in range(1, 11)) * 0.2 == pytest.approx(1)
    tops = [mini[f"ratio_top_{p}_variants"] for p in (1, 5, 10, 20, 50, 75)]
    assert tops == sorted(tops)
    assert all(0 <= mini[f] <= 1 for f in mini if f.startswith("epa_normalized"))


def test_empty_traces_count(spark):
    got = feature_table(log_of(spark, ["ab", "", "ab", ""]), ["simple_stats", "trace_len_min", "trace_len_geometric_mean", "eventropy_trace", "start_activities_max"]).first()
    assert (got.n_traces, got.n_unique_traces, got.trace_len_min, got.trace_len_geometric_mean, got.eventropy_trace, got.start_activities_max) == (4, 2, 0, 0, 1, 2)


def test_equal_lengths_and_constant_counts(spark):
    got = feature_table(log_of(spark, ["ab", "ba"]), ["trace_length", "activities"]).first()
    assert got.trace_len_hist6 == pytest.approx(10) and got.trace_len_hist1 == 0
    assert got.trace_len_std == 0 and got.trace_len_skewness is None and got.activities_kurtosis is None


def test_only_empty_traces(spark):
    got = feature_table(log_of(spark, ["", ""])).first()
    assert got.n_traces == 2 and got.trace_len_max == 0 and got.trace_len_entropy == 0 and got.epa_variant_entropy is None


def test_partitions(spark):
    rows = sorted((r.pos, r.states, r.events) for r in automaton.partitions(log_of(spark, ["abc", "abc", "ac", "abd", "b"])).collect())
    assert rows == [(1, 1, 1), (1, 3, 9), (2, 1, 1), (3, 1, 1)]


def test_order_of_traces_only_matters_for_the_automaton(spark):
    traces = ["abc", "ac", "abd", "b", "abc"]
    one, two = (feature_table(log_of(spark, t), ["simple_stats", "trace_variant", "activities", "eventropy_prefix", "eventropy_global_block"]).first() for t in (traces, traces[::-1]))
    for a, b in zip(one, two, strict=True):
        assert a == (pytest.approx(b) if isinstance(b, float) else b)


def test_two_logs_are_apart(spark):
    a, b = log_of(spark, ["ab", "a"], "x"), log_of(spark, ["abc"], "y")
    both = from_positions(a.events.select("log", "case_id", "pos", "activity", "ts").union(b.events.select("log", "case_id", "pos", "activity", "ts")))
    got = {r.log: r.trace_len_mean for r in feature_table(both, ["trace_len_mean"]).collect()}
    assert got == {"x": 1.5, "y": 3}


def test_resolve():
    assert resolve(["ense"]) == ["epa_normalized_sequence_entropy"]
    assert resolve(["simple_stats", "ratio_unique_traces_per_trace"]) == ["n_traces", "n_unique_traces", "ratio_variants_per_number_of_traces"]
    with pytest.raises(ValueError):
        resolve(["no such thing"])


def test_phrases():
    assert entropies.phrases(list("aaaaaa")) == 3 and entropies.phrases([]) == 0


def test_lempel_ziv_reads_traces_in_order(spark):
    traces = ["ab", "cad", "ab", "bb", "cad", "ab", "", "bb", "ab", "cad", "d"] * 3
    rate = lambda t: entropies.phrases(t) * math.log2(len(t)) / len(t)
    got = entropies.lempel_ziv(log_of(spark, traces)).first()
    assert got.eventropy_lempel_ziv == pytest.approx(rate("".join(traces))) != pytest.approx(rate("".join(sorted(traces, key=traces.index))))
    assert got.eventropy_lempel_ziv_flattened == pytest.approx(rate("abcadbbd"))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound", [1, 4])
def test_nearest_neighbours_against_all_distances(spark, bound):
    rng = random.Random(6)
    traces = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 4, 9, 20)))) for _ in range(60)] + ["abc"] * 9 + ["", "x" * 40]
    got = entropies.nearest_neighbours(log_of(spark, traces), bound).first()
    full = [t for t in traces if t]
    near = [sorted(edit_distance(a, b) for j, b in enumerate(full) if j != i) for i, a in enumerate(full)]
    for k in (3, 5, 7):
        assert got[f"eventropy_knn_{k}"] == pytest.approx(sum(math.log2(len(full) * n[k - 1] / k + 1) for n in near) / len(full))


def test_nearest_neighbours(spark):
    got = entropies.nearest_neighbours(log_of(spark, ["ab"] * 4 + ["cd"] * 4)).first()
    assert got.eventropy_knn_3 == 0 and got.eventropy_knn_5 == pytest.approx(math.log2(8 * 2 / 5 + 1))


def test_long_and_wide(spark):
    wide = feature_table(log_of(spark, ["ab", "a"]), ["trace_len_mean", "trace_len_std"])
    back = wide_form(long_form(wide), ["trace_len_mean", "trace_len_std"])
    assert back.collect() == wide.collect()


def test_tables(spark):
    got = tables(log_of(spark, ["ab", ""]))
    assert got["nested"].count() == 2 and got["events"].count() == 2
