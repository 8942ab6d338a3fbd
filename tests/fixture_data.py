"""Writes a small screening data set: method files, libraries and label files."""

import os

import numpy as np
import pandas as pd

METHODS = ["glide-sp", "pignet2", "ligunity", "boltz-2", "balm", "mammal"]
TARGETS = {"na": ["na_ph1n1", "na_h3n2", "na_h5n1"], "pa": ["pa_ph1n1", "pa_h3n2", "pa_h5n1"], "furin": ["furin"], "fasn": ["fasn"]}


def write(root: str, classes=("na",), n: int = 120, seed: int = 3) -> dict:
    """Write the data set and return its frames."""
    rng = np.random.default_rng(seed)
    os.makedirs(f"{root}/shared/features", exist_ok=True)
    os.makedirs(f"{root}/shared/datasets", exist_ok=True)
    os.makedirs(f"{root}/round_one/assay_data", exist_ok=True)
    ids = [f"c{i:04d}" for i in range(n)]
    truth = {t: rng.normal(size=n) for c in classes for t in TARGETS[c]}
    predictions = {}
    for j, method in enumerate(METHODS):
        rows = []
        for target, hidden in truth.items():
            noisy = np.round(hidden + rng.normal(scale=0.4 + 0.1 * j, size=n), 1)
            frame = pd.DataFrame({"id": ids, "target": target, "prediction": noisy})
            frame = frame[rng.random(n) < 0.97]
            rows.append(frame)
        table = pd.concat(rows, ignore_index=True)
        if method == "glide-sp":
            table["glidescore_sd"] = np.round(rng.random(len(table)), 3)
        table.to_csv(f"{root}/shared/features/{method}_predictions.csv", index=False)
        predictions[method] = table
    for target_class in classes:
        library = pd.DataFrame({"id": ids, "smiles": [f"C{'C' * (i % 5)}O" for i in range(n)], "source": "lab"})
        library.to_csv(f"{root}/shared/datasets/compounds_{target_class}_standardized.csv", index=False)
        for target in TARGETS[target_class]:
            strain = target.split("_", 1)[1] if "_" in target else ""
            picked = rng.permutation(n)[: int(n * 0.8)]
            label = np.round(5 + truth[target][picked] * 0.8 + rng.normal(scale=0.2, size=len(picked)), 3)
            pd.DataFrame(
                {
                    "id": [ids[i] for i in picked],
                    "target": target,
                    "target_class": target_class,
                    "strain": strain,
                    "smiles": [library["smiles"][i] for i in picked],
                    "label_pkd": label,
                    "label_source": "test",
                    "round_id": "",
                }
            ).to_csv(f"{root}/round_one/assay_data/{target}.csv", index=False)
    return predictions
