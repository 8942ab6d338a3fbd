"""Plain-text rendering of jobs and progress."""

from __future__ import annotations

import textwrap
from collections.abc import Mapping
from typing import Any


def show(value: Any) -> str:
    """Render one value compactly."""
    if value is None:
        return "-"
    if isinstance(value, Mapping):
        return ", ".join(f"{k}={value[k]}" for k in sorted(value)) or "{}"
    if isinstance(value, list | tuple):
        return ", ".join(str(v) for v in value)
    return str(value)


def fields(tag: str, values: Mapping[str, Any]) -> str:
    """Render a tagged progress line."""
    return f"{tag} " + " | ".join(f"{k}={show(v)}" for k, v in values.items())


def job_text(job: Mapping[str, Any], number: int | None = None) -> str:
    """Render the settings, comparisons and model runs of one job."""
    lines = [f"== Job{'' if number is None else f' {number}'}: {job['name']}"]
    for key in (
        "output_label",
        "train_round_id",
        "dataset_mode",
        "target",
        "target_class",
        "comparison_preset",
        "tuning_mode",
        "tuning_metric",
        "inference_mode",
    ):
        lines.append(f"  {key}: {show(job.get(key))}")
    for comparison in job["comparisons"]:
        families = [r["feature_set"] for r in comparison["feature_requests"]]
        lines.append(f"  comparison {comparison['name']}: {show(families)}")
    for run in job["model_runs"]:
        scaled = run.get("standardize_features", job.get("standardize_features"))
        lines.append(f"  model {run['model_type']}: {show(run.get('model_params', {}))}; standardize={scaled}")
    return "\n".join(lines)


def wrap_label(text: str, width: int = 42, indent: str = "") -> str:
    """Wrap a display label for an axis or legend without breaking words."""
    return textwrap.fill(text, width=width, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)
