"""Targets, target classes, scoring methods and feature families.

The values in this module are fixed: names, files and column orders that inputs and outputs must carry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from assaysift.session import local_table

# Target classes with display name, member targets and compound file. The first target is the reference.
TARGET_CLASSES = {
    "furin": ("Furin", ("furin",), "compounds_furin_standardized.csv"),
    "fasn": ("FASN", ("fasn",), "compounds_fasn_standardized.csv"),
    "pa": ("PA", ("pa_ph1n1", "pa_h3n2", "pa_h5n1"), "compounds_pa_standardized.csv"),
    "na": ("NA", ("na_ph1n1", "na_h3n2", "na_h5n1"), "compounds_na_standardized.csv"),
}
STRAIN_DISPLAY = {"ph1n1": "pH1N1", "h3n2": "H3N2", "h5n1": "H5N1"}
STRAIN_ORDER = ("ph1n1", "h3n2", "h5n1")

# Scoring methods in column order, their weights in the consensus, and the branches they form.
METHOD_WEIGHTS = {"glide-sp": 2.0, "pignet2": 2.0, "ligunity": 3.0, "boltz-2": 3.0, "balm": 1.0, "mammal": 1.0}
METHODS = tuple(METHOD_WEIGHTS)
BRANCHES = {"sequence": ("balm", "mammal"), "pose": ("glide-sp", "pignet2"), "structure": ("ligunity", "boltz-2")}
SPREAD_METHOD = "glide-sp"
SPREAD_SOURCE_COLUMN = "glidescore_sd"
SPREAD_COLUMN = "glide-sp_glidescore_sd"

# Output columns of the feature families.
SUMMARY_COLUMNS = (
    "sequence_rank_mean",
    "pose_rank_mean",
    "structure_rank_mean",
    "consensus_123_rank",
    "method_rank_sd",
    "method_rank_range",
    "branch_rank_sd",
    "structure_minus_pose_rank",
    "sequence_minus_structure_rank",
)
DISAGREEMENT_COLUMNS = (
    "method_rank_sd",
    "method_rank_range",
    "branch_rank_sd",
    "structure_minus_pose_rank",
    "sequence_minus_structure_rank",
)
DESCRIPTOR_COLUMNS = (
    "exact_mol_wt",
    "logp",
    "tpsa",
    "hbd",
    "hba",
    "formal_charge",
    "rotatable_bonds",
    "ring_count",
    "aromatic_ring_count",
    "heavy_atom_count",
    "fraction_csp3",
    "structural_alert_count",
    "qed",
)
FEATURE_FAMILIES = {
    "method_scores": tuple(f"{m}_score" for m in METHODS),
    "method_ranks": tuple(f"{m}_rank" for m in METHODS),
    "method_rank_summary": SUMMARY_COLUMNS,
    "glide_uncertainty": (SPREAD_COLUMN,),
    "chemical_descriptors": DESCRIPTOR_COLUMNS,
    "target_context": (),
}

# Table keys and metadata columns.
KEYS = ("id", "target")
METADATA_COLUMNS = ("id", "target", "target_class", "strain", "smiles")
LABEL = "label_pkd"
OVERLAP = "in_experimental_data"
ASSAY_COLUMNS = ("id", "target", "target_class", "strain", "smiles", "label_pkd", "label_source", "round_id")


@dataclass(frozen=True)
class Target:
    """One concrete target."""

    name: str
    target_class: str
    strain: str | None


def _members(target_class: str) -> list[Target]:
    return [
        Target(t, target_class, None if t == target_class else t.removeprefix(f"{target_class}_"))
        for t in class_targets(target_class)
    ]


def class_targets(target_class: str) -> list[str]:
    """List the targets of a class, reference target first."""
    if target_class not in TARGET_CLASSES:
        raise ValueError(f"Unknown target_class: {target_class}")
    return list(TARGET_CLASSES[target_class][1])


def reference_target(target_class: str) -> str:
    """Return the target a class compares its others with."""
    return class_targets(target_class)[0]


def compound_file(target_class: str) -> str:
    """Return the compound library file of a class."""
    class_targets(target_class)
    return TARGET_CLASSES[target_class][2]


def target_labels(target_class: str, targets: list[str] | None = None) -> dict[str, str]:
    """Map targets to the short labels used in context column names."""
    names = class_targets(target_class) if targets is None else targets
    return {t: t.removeprefix(f"{target_class}_") for t in names}


def get_target(name: str) -> Target:
    """Return one target by name."""
    for target_class in TARGET_CLASSES:
        for target in _members(target_class):
            if target.name == name:
                return target
    raise ValueError(f"Unknown target: {name}")


def all_targets() -> list[Target]:
    """List every target, class by class."""
    return [t for c in TARGET_CLASSES for t in _members(c)]


def registry_table(spark: SparkSession) -> DataFrame:
    """Return the registry as a small table (target, target_class, strain)."""
    rows = [(t.name, t.target_class, t.strain) for t in all_targets()]
    return local_table(spark, rows, {"target": "string", "target_class": "string", "strain": "string"})
