"""The engine's queries over the tables of a folder, by name.

Doubles are rounded to six decimals, since sums depend on the order of their terms.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import naming
from tracequarry.model import EventLog, event_log
from tracequarry.operators import automaton, counts, entropies, evaluation, generation, representation, tasks
from tracequarry.plans import pipeline
from tracequarry.plans.features import feature_table, long_form, wide_form
from tracequarry.sources import tables
from tracequarry.sources.config import read_config
from tracequarry.sources.files import copy_matching, cut, list_files, shared_folder, write_named, write_single
from tracequarry.sources.xes import read_xes, write_xes
from tracequarry.sources.xes import trace_numbers as trace_order
from tracequarry.streaming import events as streaming

WEEK_FEATURES = ["ratio_variants_per_number_of_traces", "ratio_most_common_variant", "trace_len_mean", "trace_len_std", "eventropy_trace"]
PAIR = WEEK_FEATURES[:2]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = f(spark, sf_dir)
        return table.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes))

    QUERIES[f.__name__] = rounded
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily(spark: SparkSession, sf_dir: str, log: Column | str = "EV_DAY") -> EventLog:
    """A user's events of a day are a case."""
    case = F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return event_log(read(spark, sf_dir, "events"), case, F.col("event_type"), [F.col("ts"), F.col("event_id")], F.col("ts"), log)


def weekly(spark: SparkSession, sf_dir: str) -> EventLog:
    """As daily(), with a log per week."""
    return daily(spark, sf_dir, F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))


def conversations(spark: SparkSession, sf_dir: str) -> EventLog:
    """Conversations as cases of roles; a turn is a thousand seconds."""
    return event_log(read(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("role"), [F.col("turn"), F.col("text")], F.timestamp_seconds(F.col("turn") * 1000), "CONV")


def customers(spark: SparkSession, sf_dir: str) -> EventLog:
    """A customer's orders as a case of priorities."""
    return event_log(read(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderpriority"), [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderdate"), "ORD")


def week_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(feature_table(weekly(spark, sf_dir), WEEK_FEATURES))


def next_week(log: Column) -> Column:
    return F.date_format(F.date_add(log.cast("date"), 7), "yyyy-MM-dd")


def targets_of(features: DataFrame) -> DataFrame:
    """Each week's targets are the features of the week before; a second feature under 0.01 is no objective."""
    second = F.when(F.col(PAIR[1]) >= 0.01, F.col(PAIR[1])).alias(PAIR[1])
    return features.select(next_week(F.col("log")).alias("log"), PAIR[0], second, *WEEK_FEATURES[2:])


def week_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_of(week_features(spark, sf_dir))


def week_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets and features of the weeks, from features made once."""
    features = week_features(spark, sf_dir)
    return targets_of(features), features


def long_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets, features = week_pair(spark, sf_dir)
    return long_form(targets), long_form(features)


def week_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, made = evaluation.without_nulls(*week_pair(spark, sf_dir), PAIR)
    return evaluation.distances(made, targets, PAIR, [F.col("log")])


# event logs and counts


@query
def event_log_traces(spark, sf_dir):
    rows = daily(spark, sf_dir).traces
    return rows.select("log", "case_id", "n_events", "first_activity", "last_activity", F.unix_micros("seen.first_ts").alias("first_us"))


@query
def event_positions(spark, sf_dir):
    return daily(spark, sf_dir).events.select("case_id", "pos", "activity", (F.col("pos") * generation.STEP_SECONDS).alias("clock"))


@query
def simple_stats(spark, sf_dir):
    return counts.simple_stats(daily(spark, sf_dir))


@query
def simple_stats_conversations(spark, sf_dir):
    return counts.simple_stats(conversations(spark, sf_dir))


@query
def simple_stats_customers(spark, sf_dir):
    return counts.simple_stats(customers(spark, sf_dir))


@query
def trace_length_counts(spark, sf_dir):
    return counts.lengths(daily(spark, sf_dir))


@query
def trace_length_stats(spark, sf_dir):
    return feature_table(daily(spark, sf_dir), ["trace_length"]).drop(*(f"trace_len_{h}" for h in ("skewness_hist", "kurtosis_hist", *(f"hist{i}" for i in range(1, 11)))))


@query
def trace_length_hist(spark, sf_dir):
    return counts.length_histogram(daily(spark, sf_dir))


@query
def variant_counts(spark, sf_dir):
    """How many variants occur how often."""
    return counts.variants(conversations(spark, sf_dir)).groupBy("log", "n_events", "n").agg(F.count("*").alias("n_variants"))


@query
def variant_stats(spark, sf_dir):
    return counts.trace_variant(daily(spark, sf_dir)).drop(*(f"ratio_top_{p}_variants" for p in counts.TOP_SHARES))


@query
def ratio_top_variants(spark, sf_dir):
    return counts.top_shares(daily(spark, sf_dir))


@query
def activity_counts(spark, sf_dir):
    return counts.activity_counts(daily(spark, sf_dir), "activities")


@query
def activities_stats(spark, sf_dir):
    return counts.activity_stats(daily(spark, sf_dir), "activities")


@query
def start_activities_stats(spark, sf_dir):
    return counts.activity_stats(daily(spark, sf_dir), "start_activities")


@query
def end_activities_stats(spark, sf_dir):
    return counts.activity_stats(daily(spark, sf_dir), "end_activities")


# entropies


@query
def epa_states(spark, sf_dir):
    """States and events by depth, and how many states open a partition."""
    rows = automaton.states(daily(spark, sf_dir))
    return rows.groupBy("log", F.col("pos").alias("depth")).agg(F.count("*").alias("states"), F.sum("n").alias("events"), F.count_if("opens").alias("openings"))


@query
def epa_partitions(spark, sf_dir):
    """How many partitions have how many states and events."""
    return automaton.partitions(daily(spark, sf_dir)).groupBy("log", "states", "events").agg(F.count("*").alias("n"))


@query
def epa_entropy(spark, sf_dir):
    return automaton.automaton_entropies(daily(spark, sf_dir))


@query
def epa_entropy_conversations(spark, sf_dir):
    return automaton.automaton_entropies(conversations(spark, sf_dir))


@query
def eventropy_trace(spark, sf_dir):
    return entropies.trace_entropy(daily(spark, sf_dir))


@query
def eventropy_prefix(spark, sf_dir):
    return entropies.prefix_entropy(daily(spark, sf_dir))


@query
def eventropy_k_block(spark, sf_dir):
    return entropies.block_features(daily(spark, sf_dir))


@query
def eventropy_global_block(spark, sf_dir):
    return entropies.global_block_entropy(daily(spark, sf_dir))


@query
def eventropy_lempel_ziv(spark, sf_dir):
    return entropies.lempel_ziv(daily(spark, sf_dir))


@query
def eventropy_knn(spark, sf_dir):
    return entropies.nearest_neighbours(conversations(spark, sf_dir))


# feature tables


@query
def feature_table_wide(spark, sf_dir):
    """All features of the daily log."""
    return feature_table(daily(spark, sf_dir))


@query
def feature_table_families(spark, sf_dir):
    """All features but those whose entropies no SQL expresses, asked for by family."""
    return feature_table(daily(spark, sf_dir), ["simple_stats", "trace_length", "trace_variant", "activities", "start_activities", "end_activities", "epa_based", "eventropy_trace", "eventropy_prefix", "eventropy_prefix_flattened", "eventropy_global_block", "eventropy_global_block_flattened", *(f"eventropy_k_block_{x}_{k}" for k in (1, 3, 5) for x in ("ratio", "diff"))])


@query
def feature_table_weeks(spark, sf_dir):
    return week_features(spark, sf_dir)


@query
def feature_table_long(spark, sf_dir):
    return long_form(week_features(spark, sf_dir))


@query
def feature_table_pivot(spark, sf_dir):
    return wide_form(long_form(week_features(spark, sf_dir)).where("log is not null"), WEEK_FEATURES)


# evaluation


@query
def target_similarity(spark, sf_dir):
    return evaluation.target_similarity(*long_pair(spark, sf_dir))


@query
def objective_abs_error(spark, sf_dir):
    return evaluation.objective_errors(*long_pair(spark, sf_dir))


@query
def scalar_cost(spark, sf_dir):
    return evaluation.scalar_cost(evaluation.objective_errors(*long_pair(spark, sf_dir)))


@query
def first_match_fallback_join(spark, sf_dir):
    targets, features = week_pair(spark, sf_dir)
    return evaluation.match_or_first(features.select("log", *PAIR), targets, [PAIR[0]], [F.col("log")])


@query
def first_match_of_targets(spark, sf_dir):
    """The other direction: each target with what was generated for it, or the first generated row."""
    targets, features = week_pair(spark, sf_dir)
    return evaluation.match_or_first(targets.select("log", *PAIR), features, [PAIR[0]], [F.col("log")])


@query
def anti_filter_nulls(spark, sf_dir):
    return evaluation.without_nulls(*week_pair(spark, sf_dir), PAIR)[1].select("log", *PAIR)


@query
def merge_outer(spark, sf_dir):
    targets, features = week_pair(spark, sf_dir)
    made = features.select("log", F.col(PAIR[0]).alias("achieved"))
    return evaluation.outer_merge([made, targets.select("log", F.col(PAIR[0]).alias("target"))])


@query
def cumulated_distance(spark, sf_dir):
    return evaluation.cumulated_distance(week_distances(spark, sf_dir).withColumn("pair", F.lit(naming.abbreviation(PAIR))), ["pair"])


@query
def distance_grid(spark, sf_dir):
    return evaluation.distance_grid(week_distances(spark, sf_dir))


@query
def distinct_value_grid(spark, sf_dir):
    rows = week_distances(spark, sf_dir).withColumns({"x": F.round("x", 1), "y": F.round("y", 2)})
    return evaluation.distinct_value_grid(rows, "log")


@query
def distance_matrix(spark, sf_dir):
    return evaluation.distance_matrix(evaluation.pair_distances(*long_pair(spark, sf_dir), feature_pairs(spark)))


@query
def instance_selection(spark, sf_dir):
    rows = evaluation.pair_distances(*long_pair(spark, sf_dir), feature_pairs(spark))
    return evaluation.selected(rows)


@query
def distance_histogram(spark, sf_dir):
    return evaluation.histogram(week_distances(spark, sf_dir))


@query
def feature_box_stats(spark, sf_dir):
    parts = dict(zip(("Real", "Generated"), long_pair(spark, sf_dir), strict=True))
    return evaluation.box_statistics(evaluation.tagged_union(parts), ["source", "feature"])


@query
def feature_ranges(spark, sf_dir):
    return evaluation.feature_ranges(long_form(week_features(spark, sf_dir)))


@query
def unit_range_features(spark, sf_dir):
    return evaluation.unit_range_features(long_form(week_features(spark, sf_dir)))


# tasks and names


def feature_pairs(spark: SparkSession) -> DataFrame:
    return tasks.objective_pairs(spark.createDataFrame([(f,) for f in WEEK_FEATURES], "feature string"))


@query
def objective_pairs(spark, sf_dir):
    return feature_pairs(spark)


@query
def value_grid(spark, sf_dir):
    return tasks.value_grid(spark)


@query
def range_grid(spark, sf_dir):
    return tasks.range_grid(long_form(week_features(spark, sf_dir)), *PAIR)


@query
def key_abbreviation(spark, sf_dir):
    """Short forms of the features' names with each event type in front."""
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    names = kinds.select("event_type", F.explode(F.array(*map(F.lit, WEEK_FEATURES))).alias("feature"))
    return names.select(F.concat_ws("_", "event_type", "feature").alias("name")).withColumn("short", naming.abbreviated(F.col("name")))


@query
def natural_sort(spark, sf_dir):
    """Nations' keys in natural order, by rank."""
    from pyspark.sql import Window

    names = read(spark, sf_dir, "nation").select(F.concat(F.lit("Log_"), F.col("n_nationkey").cast("string")).alias("name"))
    return names.select("name", F.row_number().over(Window.orderBy(naming.natural_key(F.col("name")))).alias("place"))


@query
def output_key(spark, sf_dir):
    rows = long_form(week_features(spark, sf_dir)).where(F.col("feature").isin(*PAIR))
    return naming.output_keys(rows.withColumn("value", F.round("value", 4)), "log", "feature", "value")


# representativeness


@query
def impute_mean(spark, sf_dir):
    return representation.impute_mean(week_targets(spark, sf_dir).select("log", *PAIR), PAIR)


@query
def standardize(spark, sf_dir):
    return representation.standardize(week_features(spark, sf_dir), WEEK_FEATURES)


@query
def l2_normalize(spark, sf_dir):
    return representation.l2_normalize(week_features(spark, sf_dir), WEEK_FEATURES)


@query
def pca_2d(spark, sf_dir):
    return representation.principal_components(representation.standardize(week_features(spark, sf_dir), WEEK_FEATURES), WEEK_FEATURES)[0]


@query
def pca_weights(spark, sf_dir):
    return representation.principal_components(representation.standardize(week_features(spark, sf_dir), WEEK_FEATURES), WEEK_FEATURES)[2]


@query
def convex_hull(spark, sf_dir):
    parts = dict(zip(("Real", "Generated"), week_pair(spark, sf_dir), strict=True))
    return representation.convex_hulls(evaluation.tagged_union({k: t.withColumn("source", F.lit(k)) for k, t in parts.items()}), "source", *PAIR)


# generation


@query
def config_space(spark, sf_dir):
    return generation.space_table(spark)


@query
def tree_playout(spark, sf_dir):
    """Features of the logs of fifty configurations of the default space."""
    import random

    trials = generation.trial_table(spark, generation.drawn(generation.config_space(), 50, random.Random(10)), 10)
    return feature_table(generation.play_out(trials), ["simple_stats", "ratio_most_common_variant", "trace_len_mean"])


@query
def generate_for_targets(spark, sf_dir):
    """The best of fifty trials for each target of an 11 x 11 grid."""
    targets = tasks.value_grid(spark).select(F.col("task").alias("log"), F.col("v1").alias(PAIR[0]), F.col("v2").alias(PAIR[1]))
    return generation.search(spark, targets)[0]


@query
def play_out_laws(spark, sf_dir):
    """Logs of trees with one kind of operator: what the operator says of every trace."""
    kinds = ("sequence", "choice", "parallel")
    plain = {"mode": 6, "num_traces": 1500, "lt_dependency": 0.0, "duplicate": 0, "or": 0, "silent": 0.0, "loop": 0.0}
    configs = [plain | {k: float(k == kind) for k in kinds} for kind in kinds]
    log = generation.play_out(generation.trial_table(spark, configs, 3))
    facts = feature_table(log, ["n_traces", "trace_len_min", "trace_len_max", "n_unique_activities", "activities_max"])
    once = log.events.groupBy("log", "case_id", "activity").agg(F.count("*").alias("times"), F.max(F.unix_seconds("ts") - F.col("pos") * generation.STEP_SECONDS).alias("off")).groupBy("log").agg(F.max("times").alias("repeats"), F.max("off").alias("clock_off"))
    return facts.join(once, "log").withColumn("one_variant", F.col("log") == "trial_0").drop("activities_max")


@query
def search_of_known_targets(spark, sf_dir):
    """Tasks that ask for what the first trials are: each is found exactly."""
    import random

    space = {**generation.DEFAULT_SPACE, "mode": [5, 9], "num_traces": [40, 90]}
    first = generation.trial_table(spark, generation.drawn(generation.config_space(space), 4, random.Random(10)), 10, "r0")
    targets = feature_table(generation.play_out(first), ["ratio_variants_per_number_of_traces", "trace_len_mean"])
    return generation.search(spark, targets, space, n_trials=8, rounds=2)[0].select("log", "cost", "target_similarity")


# sources and sinks: what is written to the shared folder, read back


def sessions_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """Conversations as cases, with a log per length of the conversation's first text: several logs of several cases."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return event_log(rows, F.col("conv_id"), F.col("role"), [F.col("turn"), F.col("role")], F.timestamp_seconds(F.col("turn") * 1000), F.concat(F.lit("part "), (F.pmod("conv_id", F.lit(5))).cast("string")))


@query
def xes_round_trip(spark, sf_dir):
    """Logs written as .xes files and read again."""
    folder = shared_folder(spark, "xes")
    write_xes(sessions_log(spark, sf_dir), folder)
    return read_xes(spark, folder).events.select("log", "case_id", "pos", "activity", F.unix_seconds("ts").alias("second"))


@query
def xes_files(spark, sf_dir):
    """The files that logs are written to, by name, with their headers' parts and their traces counted."""
    folder = shared_folder(spark, "xes")
    write_xes(sessions_log(spark, sf_dir), folder)
    marks = {"extensions": "<extension ", "defaults": "<global ", "traces": "<trace>", "events": "<event>"}
    lines = spark.read.text(list_files(spark, folder, ".xes"))
    return lines.groupBy(F.url_decode("_metadata.file_name").alias("file")).agg(*(F.sum(F.size(F.split("value", m)) - 1).alias(k) for k, m in marks.items()))


@query
def trace_numbers(spark, sf_dir):
    return trace_order(sessions_log(spark, sf_dir))


@query
def feature_extraction_of_files(spark, sf_dir):
    """A pipeline's extraction step over a folder of logs: the features that it returns, from the file that it leaves."""
    folder = shared_folder(spark, "logs")
    write_xes(sessions_log(spark, sf_dir), f"{folder}/logs")
    pipeline.extraction_step(spark, {"input_path": f"{folder}/logs", "feature_params": {"feature_set": ["simple_stats", "trace_len_mean"]}})
    return tables.read_features(spark, f"{folder}/logs_feat.csv").select("log", *(F.col(c).cast("double").alias(c) for c in ("n_traces", "n_unique_traces", "ratio_variants_per_number_of_traces", "trace_len_mean")))


def short_names(table: DataFrame) -> DataFrame:
    """The table with the short form of a feature's name, which readers replace."""
    return table.withColumnRenamed(PAIR[1], "rmcv")


@query
def csv_features(spark, sf_dir):
    """A feature table with short names as one CSV file and back; its id column comes last there."""
    path = f"{shared_folder(spark, 'features')}/week_feat.csv"
    tables.write_feature_csv(short_names(week_features(spark, sf_dir)).select("rmcv", PAIR[0], *WEEK_FEATURES[2:], "log"), path)
    return tables.read_features(spark, path).select("log", *WEEK_FEATURES)


@query
def json_features(spark, sf_dir):
    """A JSON file per log and back; a target that is no objective is no key there."""
    folder = shared_folder(spark, "features")
    tables.write_feature_json(week_targets(spark, sf_dir), folder)
    return tables.read_feature_json(spark, folder).select("log", *WEEK_FEATURES)


@query
def json_lines_features(spark, sf_dir):
    """A file with an object a line beside files of one object over several lines."""
    folder = shared_folder(spark, "features")
    features = week_features(spark, sf_dir).select("log", *PAIR)
    write_single(features, f"{folder}/lines.json", "json")
    spread = F.concat_ws("\n", F.lit("{"), *(F.concat(F.lit(f'  "{c}": "' if c == "log" else f'  "{c}": '), F.col(c).cast("string"), F.lit('",' if c == "log" else "," if c != PAIR[1] else "")) for c in features.columns), F.lit("}"))
    again = features.withColumn("log", F.concat(F.lit("again "), "log"))
    write_named(again.select(F.col("log").alias("name"), spread.alias("value")), folder, ".json", [])
    return tables.read_feature_json(spark, folder)


@query
def json_to_csv(spark, sf_dir):
    """A folder of JSON files merged into one CSV file."""
    folder = shared_folder(spark, "features")
    tables.write_feature_json(week_targets(spark, sf_dir), f"{folder}/json")
    tables.merge_jsons(spark, f"{folder}/json", f"{folder}/merged.csv")
    return tables.read_features(spark, f"{folder}/merged.csv").select("log", *WEEK_FEATURES)


@query
def file_listing(spark, sf_dir):
    """The JSON files, but not the others, of a folder."""
    folder = shared_folder(spark, "features")
    features = week_features(spark, sf_dir)
    tables.write_feature_json(features, folder)
    tables.write_feature_csv(features, f"{folder}/all.csv")
    return spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in list_files(spark, folder, ".json")], "file string")


@query
def merge_csv_files(spark, sf_dir):
    """CSV files of one prefix joined by log, each keeping its rows."""
    folder = shared_folder(spark, "features")
    targets, features = week_pair(spark, sf_dir)
    tables.write_feature_csv(features.select("log", F.col(PAIR[0]).alias("achieved")), f"{folder}/part_1.csv")
    tables.write_feature_csv(targets.select("log", F.col(PAIR[0]).alias("target")), f"{folder}/part_2.csv")
    tables.write_feature_csv(targets.select("log", F.lit(1).alias("other")), f"{folder}/else.csv")
    return tables.merge_csvs(spark, folder, "part_")


def task_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a CSV file of targets for the first feature and each other one, and one without the first."""
    folder, targets = shared_folder(spark, "tasks"), week_targets(spark, sf_dir).withColumnRenamed("log", "task")
    for f in WEEK_FEATURES[1:]:
        tables.write_feature_csv(targets.select("task", PAIR[0], f), f"{folder}/grid_{naming.abbreviation([PAIR[0], f])}.csv")
    tables.write_feature_csv(targets.select("task", *PAIR[1:]), f"{folder}/grid_{naming.abbreviation(PAIR[1:])}.csv")
    return folder


@query
def tasks_of_a_file(spark, sf_dir):
    return tables.tasks(spark, f"{task_files(spark, sf_dir)}/grid_{naming.abbreviation(PAIR)}.csv")


@query
def tasks_of_a_folder(spark, sf_dir):
    """The targets of each file about the first feature, by the file's other feature."""
    found = tables.tasks(spark, task_files(spark, sf_dir), PAIR[0])
    parts = [t.select(F.lit(k).alias("competitor"), "log", F.col(PAIR[0]).alias("reference"), F.col(k).alias("value")) for k, t in found.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def tasks_with_objectives(spark, sf_dir):
    path = f"{task_files(spark, sf_dir)}/grid_{naming.abbreviation(PAIR)}.csv"
    return tables.tasks(spark, {"input_path": path, "objectives": [PAIR[1]]})


@query
def tasks_inline(spark, sf_dir):
    """Rows given in a configuration, with and without a name, short names and missing objectives."""
    return tables.tasks(spark, [{"rmcv": 0.2, "mvo": 4}, {"rmcv": 0.5}])


@query
def unknown_task_source(spark, sf_dir):
    """What is neither file, folder, rows nor row is refused."""
    out = []
    for source in ("nowhere.txt", [], [1], 5):
        try:
            tables.tasks(spark, source)
        except ValueError as error:
            out.append((str(source), type(error).__name__))
    return spark.createDataFrame(out, "source string, error string")


@query
def experiment_files(spark, sf_dir):
    """Targets and pipeline configurations written for pairs of objectives, and the targets read by the configurations."""
    folder = shared_folder(spark, "experiments")
    tables.write_experiments(feature_pairs(spark).where(F.col("feat1").isin(*PAIR)), folder, [0.0, 0.5, 1.0])
    parts = []
    for file in list_files(spark, folder, ".json"):
        step = read_config(file, spark)[0]
        one, two = step["generator_params"]["experiment"]["objectives"]
        rows = tables.tasks(spark, step["generator_params"]["experiment"])
        parts.append(rows.select(F.lit(file.rsplit("/", 1)[-1]).alias("file"), F.lit(one).alias("feat1"), F.lit(two).alias("feat2"), "log", F.col(one).alias("v1"), F.col(two).alias("v2")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def distance_matrix_of_files(spark, sf_dir):
    """The distance matrix of two families of files, pairs of features and one single one."""
    folder = shared_folder(spark, "families")
    targets, features = week_pair(spark, sf_dir)
    for pair in ([*PAIR], [PAIR[0], WEEK_FEATURES[4]], [PAIR[0]]):
        tables.write_feature_csv(features.select(*pair, "log"), f"{folder}/made/{naming.abbreviation(pair)}_feat.csv")
        tables.write_feature_csv(targets.select(F.col("log").alias("task"), *pair), f"{folder}/grid/grid_{naming.abbreviation(pair)}.csv")
    return pipeline.distance_matrix_files(spark, [f"{folder}/made/"], [f"{folder}/grid/grid_"])


@query
def instance_copies(spark, sf_dir):
    """The files of selected instances, copied under their folder's name."""
    folder = shared_folder(spark, "instances")
    features = week_features(spark, sf_dir)
    tables.write_feature_json(features, f"{folder}/made")
    chosen = evaluation.selected(features.select("log", F.col(PAIR[0]).alias("distance")), 0.9).orderBy("log")
    copy_matching(spark, [f"{r.log}.json" for r in chosen.collect()], f"{folder}/made", f"{folder}/selection")
    return spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in list_files(spark, f"{folder}/selection")], "file string")


@query
def pipeline_of_a_config(spark, sf_dir):
    """A configuration's steps: features reloaded from a CSV file, extracted from JSON files and compared with targets."""
    folder = shared_folder(spark, "pipeline")
    targets, features = week_pair(spark, sf_dir)
    tables.write_feature_csv(features, f"{folder}/made.csv")
    tables.write_feature_json(features, f"{folder}/made")
    tables.write_feature_csv(targets, f"{folder}/targets.csv")
    steps = [
        {"pipeline_step": "event_logs_generation", "output_path": f"{folder}/made.csv"},
        {"pipeline_step": "feature_extraction", "input_path": f"{folder}/made", "output_path": f"{folder}/out"},
        {"pipeline_step": "evaluation_plotter", "input_path": f"{folder}/out/made_feat.csv", "targets": f"{folder}/targets.csv"},
    ]
    spark.createDataFrame([(json.dumps(steps),)], "value string").coalesce(1).write.text(f"{folder}/config")
    done = pipeline.run(spark, read_config(f"{folder}/config", spark))
    similar = done[2][1]["similarity"]
    return done[0][1].select("log", F.col(PAIR[0]).alias("reloaded")).join(done[1][1].select("log", F.col(PAIR[0]).alias("extracted")), "log").join(similar, "log", "left")


@query
def suffix_numbers(spark, sf_dir):
    """The numbers at the end of file names."""
    names = read(spark, sf_dir, "nation").select(F.concat(F.lower(F.col("n_name")), F.lit("_el_"), F.col("n_nationkey").cast("string"), F.lit(".xes")).alias("file"))
    return names.select("file", naming.suffix_number(F.col("file")).alias("number"))


@query
def wrapped_text(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", naming.wrapped(F.col("text")).alias("text"))


@query
def numeric_columns(spark, sf_dir):
    """The numeric columns of a table with others."""
    return evaluation.numeric_part(read(spark, sf_dir, "customer").withColumnRenamed("c_name", "log").select("log", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query
def rows_above_mean(spark, sf_dir):
    """A row filter by a predicate over two features."""
    return week_features(spark, sf_dir).where((F.col(PAIR[0]) > F.col(PAIR[1])) & (F.col("trace_len_mean") > 1)).select("log", *PAIR)


@query
def numbered_tasks(spark, sf_dir):
    """Logs in order of a feature, as tasks with running names."""
    return tasks.numbered(week_features(spark, sf_dir).select("log", PAIR[0]), [PAIR[0], "log"])


@query
def instances_near_targets(spark, sf_dir):
    """Instance selection over rows of many customers: each customer's order total against that of the customer before, per nation."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("log"), (F.col("c_acctbal") / 10_000).alias("value"))
    targets = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("string").alias("log"), (F.col("c_acctbal") / 10_000).alias("value"))
    one = lambda t: t.select("log", F.lit("balance").alias("feature"), "value")
    return evaluation.selected(evaluation.objective_errors(one(targets), one(rows)).select("log", F.col("error").alias("distance")))


@query
def customer_similarity(spark, sf_dir):
    """Target similarities of many tasks with two objectives, one of them null for some."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("log"), (F.col("c_acctbal") / 10_000).alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") / 25).alias("b"))
    targets = rows.select((F.col("log").cast("long") + 1).cast("string").alias("log"), "a", "b")
    return evaluation.target_similarity(long_form(targets), long_form(rows))


# streaming


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.event_stream(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)


@query
def stream_event_counts(spark, sf_dir):
    rows = streaming.finished(streaming.windowed_counts(events_stream(spark, sf_dir), "event_type"), "complete", shared_folder(spark, "counts"))
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query
def stream_sliding_counts(spark, sf_dir):
    rows = streaming.finished(streaming.windowed_counts(events_stream(spark, sf_dir), "event_type", "1 day", "6 hours"), "complete", shared_folder(spark, "sliding"))
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query
def stream_sessions(spark, sf_dir):
    """Sessions of users that end after six hours without events."""
    rows = streaming.finished(streaming.sessions(events_stream(spark, sf_dir), "user_id", "6 hours"), "complete", shared_folder(spark, "sessions"))
    return rows.select(F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "user_id", "n")


@query
def stream_decayed_sums(spark, sf_dir):
    """Events with weights that decay over days, per type."""
    return streaming.decayed(streaming.finished(streaming.decayed_sums(events_stream(spark, sf_dir), "event_type"), "complete", shared_folder(spark, "decayed")), "event_type")


@query
def stream_case_prefixes(spark, sf_dir):
    cases = events_stream(spark, sf_dir).select(F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("case_id"), "event_id", F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"))
    return streaming.finished(streaming.case_prefixes(cases), "update", shared_folder(spark, "cases"), ["case_id"])


@query
def stream_replay(spark, sf_dir):
    """A log replayed as a stream, written by it and read as a log again."""
    folder = shared_folder(spark, "replay")
    streaming.replay(daily(spark, sf_dir), f"{folder}/events")
    stream = streaming.event_stream(spark, f"{folder}/events", "*.parquet", spark.read.parquet(f"{folder}/events").schema)
    again = streaming.as_event_log(streaming.written(stream, f"{folder}/written", f"{folder}/checkpoint"))
    return counts.simple_stats(again)
