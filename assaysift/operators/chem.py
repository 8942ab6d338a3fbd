"""Chemistry columns computed by RDKit inside Arrow batches.

RDKit is optional. Without it the functions raise ImportError when called, before any job starts.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaysift.functions.numeric import col
from assaysift.operators.keys import require_columns, require_none
from assaysift.operators.similarity import k_medoids
from assaysift.sources import registry

# Default fingerprint.
RADIUS = 2
BITS = 2048
DESCRIPTOR_SCHEMA = "id {id}, " + ", ".join(f"{c} double" for c in registry.DESCRIPTOR_COLUMNS)


def available() -> bool:
    """Return whether RDKit can be imported."""
    return importlib.util.find_spec("rdkit") is not None


def _need_rdkit() -> None:
    if not available():
        raise ImportError("RDKit is required for chemistry columns; install it on the driver and the executors.")


def _molecule(smiles: str, key: object):
    from rdkit import Chem

    molecule = Chem.MolFromSmiles(smiles)
    if molecule is None:
        raise ValueError(f"Could not parse SMILES for id={key}")
    return molecule


def unique_compounds(df: DataFrame, smiles: str = "smiles", validate: bool = True) -> DataFrame:
    """Return one row per id; an id with two SMILES strings is an error."""
    require_columns(df, ["id", smiles], "compound table")
    pairs = df.select("id", col(smiles).alias("smiles")).distinct()
    if validate:
        clashes = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        require_none(clashes, ["id"], "Each id must map to exactly one SMILES string; conflicts")
    return pairs


def descriptors(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Return 13 molecular descriptors per row of (id, smiles)."""
    require_columns(df, ["id", smiles], "Input table")
    _need_rdkit()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rdkit import Chem
        from rdkit.Chem import QED, Crippen, Descriptors, Lipinski, rdMolDescriptors

        calls = {
            "exact_mol_wt": Descriptors.ExactMolWt,
            "logp": Crippen.MolLogP,
            "tpsa": rdMolDescriptors.CalcTPSA,
            "hbd": Lipinski.NumHDonors,
            "hba": Lipinski.NumHAcceptors,
            "formal_charge": Chem.GetFormalCharge,
            "rotatable_bonds": Lipinski.NumRotatableBonds,
            "ring_count": Lipinski.RingCount,
            "aromatic_ring_count": rdMolDescriptors.CalcNumAromaticRings,
            "heavy_atom_count": Lipinski.HeavyAtomCount,
            "fraction_csp3": Lipinski.FractionCSP3,
            "structural_alert_count": lambda m: QED.properties(m).ALERTS,
            "qed": QED.qed,
        }
        for batch in batches:
            molecules = [_molecule(s, k) for k, s in zip(batch["id"], batch["smiles"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], **{n: [float(f(m)) for m in molecules] for n, f in calls.items()}})

    rows = df.select("id", col(smiles).alias("smiles"))
    return rows.mapInPandas(compute, DESCRIPTOR_SCHEMA.format(id=dict(rows.dtypes)["id"]))


def fingerprints(df: DataFrame, smiles: str = "smiles", radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """Return the set bits of the Morgan fingerprint of each unique compound as ``bits``."""
    _need_rdkit()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rdkit.Chem import rdFingerprintGenerator

        generator = rdFingerprintGenerator.GetMorganGenerator(radius=int(radius), fpSize=int(bits))
        for batch in batches:
            found = [
                list(generator.GetFingerprint(_molecule(s, k)).GetOnBits())
                for k, s in zip(batch["id"], batch["smiles"], strict=True)
            ]
            yield pd.DataFrame({"id": batch["id"], "smiles": batch["smiles"], "bits": found})

    rows = unique_compounds(df, smiles)
    return rows.mapInPandas(compute, f"id {dict(rows.dtypes)['id']}, smiles string, bits array<bigint>")


def scaffolds(df: DataFrame) -> DataFrame:
    """Return the Murcko scaffold per row of (id, smiles); acyclic molecules stand for themselves."""
    require_columns(df, ["id", "smiles"], "compound table")
    _need_rdkit()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rdkit import Chem
        from rdkit.Chem.Scaffolds import MurckoScaffold

        for batch in batches:
            names, kinds = [], []
            for key, text in zip(batch["id"], batch["smiles"], strict=True):
                molecule = _molecule(text, key)
                core = MurckoScaffold.GetScaffoldForMol(molecule)
                ringed = core is not None and core.GetNumAtoms() > 0
                names.append(Chem.MolToSmiles(core if ringed else molecule, isomericSmiles=True))
                kinds.append("murcko" if ringed else "acyclic")
            yield pd.DataFrame({"id": batch["id"], "murcko_scaffold": names, "scaffold_type": kinds})

    rows = df.select("id", "smiles")
    return rows.mapInPandas(compute, f"id {dict(rows.dtypes)['id']}, murcko_scaffold string, scaffold_type string")


def cluster_compounds(
    df: DataFrame, n_clusters: int, smiles: str = "smiles", radius: int = RADIUS, bits: int = BITS, max_iter: int = 100
) -> DataFrame:
    """Cluster unique compounds by Tanimoto distance of their fingerprints."""
    return k_medoids(fingerprints(df, smiles, radius, bits), "id", "bits", n_clusters, max_iter)


# A planar embedding needs all fingerprints in one process.
MAX_EMBEDDED = 50_000


def planar_embedding(
    fingerprint_table: DataFrame, bits: int = BITS, n_neighbors: int = 30, min_dist: float = 0.1, random_state: int = 42
) -> DataFrame:
    """Return two UMAP coordinates per compound for plotting; one or two compounds get fixed coordinates."""
    spark = fingerprint_table.sparkSession
    rows = fingerprint_table.select("id", "bits").orderBy("id").limit(MAX_EMBEDDED + 1).collect()
    schema = f"id {dict(fingerprint_table.dtypes)['id']}, umap_x double, umap_y double"
    if len(rows) > MAX_EMBEDDED:
        raise ValueError(f"planar embedding is a plotting aid for up to {MAX_EMBEDDED} compounds")
    if len(rows) <= 2:
        return spark.createDataFrame([(r["id"], float(i), 0.0) for i, r in enumerate(rows)], schema)
    try:
        import umap
    except ImportError as error:
        raise ImportError("umap-learn is required for planar embeddings.") from error
    import numpy as np

    matrix = np.zeros((len(rows), bits), dtype=bool)
    for i, row in enumerate(rows):
        matrix[i, row["bits"]] = True
    reducer = umap.UMAP(
        n_components=2,
        n_neighbors=min(max(2, int(n_neighbors)), len(rows) - 1),
        min_dist=float(min_dist),
        metric="jaccard",
        random_state=int(random_state),
    )
    plane = reducer.fit_transform(matrix)
    return spark.createDataFrame(
        [(r["id"], float(x), float(y)) for r, (x, y) in zip(rows, plane, strict=True)], schema
    )
