"""The features by name and family, and the names they also go by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracequarry.model import EventLog
from tracequarry.operators import automaton, counts, entropies

#: Short names of features in configurations and file headers.
SHORT_NAMES = {
    "rutpt": "ratio_variants_per_number_of_traces",
    "rmcv": "ratio_most_common_variant",
    "tlcv": "trace_len_coefficient_variation",
    "mvo": "mean_variant_occurrence",
    "enve": "epa_normalized_variant_entropy",
    "ense": "epa_normalized_sequence_entropy",
    "eself": "epa_sequence_entropy_linear_forgetting",
    "enself": "epa_normalized_sequence_entropy_linear_forgetting",
    "eseef": "epa_sequence_entropy_exponential_forgetting",
    "enseef": "epa_normalized_sequence_entropy_exponential_forgetting",
}
ALIASES = SHORT_NAMES | {"ratio_unique_traces_per_trace": "ratio_variants_per_number_of_traces"}
STATISTICS = ("min", "max", "mean", "median", "std", "variance", "q1", "q3", "iqr", "skewness", "kurtosis")


@dataclass(frozen=True)
class Part:
    """A plan that computes some features of a family; only parts with requested features are planned."""

    family: str
    features: tuple[str, ...]
    plan: Callable[[EventLog], DataFrame]


def _parts() -> list[Part]:
    found = [
        Part("simple_stats", ("n_traces", "n_unique_traces", "ratio_variants_per_number_of_traces"), counts.simple_stats),
        Part("trace_length", (*(f"trace_len_{s}" for s in (*STATISTICS, "mode", "geometric_mean", "geometric_std", "harmonic_mean", "coefficient_variation", "entropy")), *(f"trace_len_hist{i}" for i in range(1, counts.BINS + 1)), "trace_len_skewness_hist", "trace_len_kurtosis_hist"), counts.trace_length),
        Part("trace_variant", ("ratio_most_common_variant", *(f"ratio_top_{p}_variants" for p in counts.TOP_SHARES), *(f"{s}_variant_occurrence" for s in ("mean", "std", "skewness", "kurtosis"))), counts.trace_variant),
    ]
    for kind in ("activities", "start_activities", "end_activities"):
        found.append(Part(kind, (f"n_unique_{kind}", *(f"{kind}_{s}" for s in STATISTICS)), lambda log, kind=kind: counts.activity_stats(log, kind)))
    found += [
        Part("eventropies", ("eventropy_trace",), entropies.trace_entropy),
        Part("eventropies", ("eventropy_prefix", "eventropy_prefix_flattened"), entropies.prefix_entropy),
        Part("eventropies", ("eventropy_global_block", "eventropy_global_block_flattened"), entropies.global_block_entropy),
        Part("eventropies", ("eventropy_lempel_ziv", "eventropy_lempel_ziv_flattened"), entropies.lempel_ziv),
        Part("eventropies", tuple(f"eventropy_k_block_{s}_{k}" for s in ("diff", "ratio") for k in entropies.BLOCKS), entropies.block_features),
        Part("eventropies", tuple(f"eventropy_knn_{k}" for k in entropies.NEIGHBOURS), entropies.nearest_neighbours),
        Part("epa_based", tuple(f"epa_{n}{f}" for n in ("", "normalized_") for f in ("variant_entropy", "sequence_entropy", "sequence_entropy_linear_forgetting", "sequence_entropy_exponential_forgetting")), automaton.automaton_entropies),
    ]
    return found


PARTS = _parts()
FEATURES = tuple(f for p in PARTS for f in p.features)
FAMILIES = tuple(dict.fromkeys(p.family for p in PARTS))


def resolve(names: list[str] | None) -> list[str]:
    """Feature names for features, families and aliases, in order and once each; all for None."""
    if names is None:
        return list(FEATURES)
    out: dict[str, None] = {}
    for name in names:
        name = ALIASES.get(name, name)
        members = [f for p in PARTS if p.family == name for f in p.features] or [name]
        if unknown := [m for m in members if m not in FEATURES]:
            raise ValueError(f"unknown feature or family: {unknown[0]}")
        out |= dict.fromkeys(members)
    return list(out)
