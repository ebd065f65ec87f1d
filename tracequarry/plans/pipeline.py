"""Pipelines of steps: generation, feature extraction, evaluation, as a configuration lists them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.naming import abbreviation
from tracequarry.functions.registry import ALIASES
from tracequarry.operators import evaluation, generation
from tracequarry.plans.features import feature_table, long_form
from tracequarry.sources import tables
from tracequarry.sources.files import list_files
from tracequarry.sources.xes import read_xes, write_xes


def generation_step(spark: SparkSession, step: dict) -> DataFrame:
    """Generates a log for each target; writes logs and features below output_path. The features with target_similarity."""
    out, params = step.get("output_path"), step.get("generator_params") or {}
    if out and out.endswith(".csv"):
        return tables.read_features(spark, out)
    if "experiment" not in params:
        raise ValueError("generator_params needs an experiment")
    targets = tables.tasks(spark, params["experiment"])
    trials = int(params.get("n_trials", 50))
    log, best = generation.generate(spark, targets, space=params.get("config_space"), n_trials=trials, rounds=min(3, trials), method=params.get("simulation_method", generation.METHODS[0]))
    objectives = [c for c in targets.columns if c != "log"]
    features = feature_table(log, objectives).join(best.select("log", "target_similarity"), "log")
    if out:
        name = f"{len(objectives)}_{abbreviation(sorted(objectives))}" if len(objectives) <= 7 else f"{len(objectives)}_features"
        write_xes(log, f"{out}/{name}")
        tables.write_feature_json(features, f"{out}/features/{name}")
    return features


def extraction_step(spark: SparkSession, step: dict) -> DataFrame:
    """The features of a CSV file, of a folder of JSON files, or of XES logs, as the folder's first file says.

    Those of a folder are also written to ``<folder>_feat.csv``, below output_path or else beside the folder.
    """
    path, params = step["input_path"], step.get("feature_params") or {}
    if path.endswith(".csv"):
        return tables.read_features(spark, path)
    files = list_files(spark, path)
    if files and files[0].endswith(".json"):
        table = tables.read_feature_json(spark, path)
    else:
        table = feature_table(read_xes(spark, path), params.get("feature_set"))
    if not path.endswith(".xes"):
        parent, name = path.rstrip("/").rsplit("/", 1) if "/" in path.rstrip("/") else (".", path.rstrip("/"))
        tables.write_feature_csv(table, f"{step.get('output_path') or parent}/{name}_feat.csv")
    return table


def evaluation_step(spark: SparkSession, step: dict, generated: DataFrame) -> dict[str, DataFrame]:
    """What the plots of a step show: similarities and, for a reference feature, distance grids per competitor."""
    params = step.get("plotter_params") or step
    source, reference = params.get("targets") or step.get("targets"), ALIASES.get(step.get("reference_feature", ""), step.get("reference_feature"))
    if source is None:
        return {"similarity": generated.select("log", "target_similarity")} if "target_similarity" in generated.columns else {}
    targets = tables.tasks(spark, source, reference)
    if isinstance(targets, dict):
        out = {}
        for other, table in targets.items():
            both = [reference, other]
            if all(f in generated.columns for f in both):
                kept, made = evaluation.without_nulls(table, generated, both)
                out[other] = evaluation.distance_grid(evaluation.distances(made, kept, both, [F.col("log")]))
        return out
    long = long_form(targets)
    return {"similarity": evaluation.target_similarity(long, long_form(generated)), "errors": evaluation.objective_errors(long, long_form(generated))}


def distance_matrix_files(spark: SparkSession, generated: list[str], targets: list[str]) -> DataFrame:
    """The distance matrix of two families of CSV files, whose columns say what pair or single feature they are about."""
    made, wanted = (tables.read_family(spark, paths) for paths in (generated, targets))
    both = made.join(wanted.select("feat1", "feat2", "log", F.col("v1").alias("t1"), F.col("v2").alias("t2")), ["feat1", "feat2", "log"])
    second = F.when(F.col("feat1") == F.col("feat2"), 0.0).otherwise(F.pow(F.col("v2") - F.col("t2"), F.lit(2)))
    return evaluation.distance_matrix(both.select("feat1", "feat2", "log", F.sqrt(F.pow(F.col("v1") - F.col("t1"), F.lit(2)) + second).alias("distance")))


def run(spark: SparkSession, steps: list[dict]) -> list[tuple[str, object]]:
    """The steps in order; each gives (name, result). Steps of other names are skipped with a warning."""
    out: list[tuple[str, object]] = []
    generated: DataFrame | None = None
    for step in steps:
        name = step.get("pipeline_step")
        if name == "event_logs_generation":
            generated = generation_step(spark, step)
            out.append((name, generated))
        elif name == "feature_extraction":
            out.append((name, extraction_step(spark, step)))
        elif name == "evaluation_plotter":
            table = tables.read_features(spark, step["input_path"]) if str(step.get("input_path", "")).endswith(".csv") else generated
            if table is None:
                raise ValueError("an evaluation needs generated features")
            out.append((name, evaluation_step(spark, step, table)))
        else:
            warnings.warn(f"step {name} is skipped", stacklevel=2)
    return out
