"""Command line: python -m assaysift.plans {learn,evaluation,selected,space,extrapolation} ..."""

from __future__ import annotations

import argparse

from assaysift.functions.console import fields, job_text
from assaysift.plans import diagnostics, learner
from assaysift.session import get_spark
from assaysift.sources.config import load_run_config


def parser() -> argparse.ArgumentParser:
    """Return the argument parser."""
    root = argparse.ArgumentParser(prog="assaysift")
    commands = root.add_subparsers(dest="command", required=True)
    learn = commands.add_parser("learn", help="run learner jobs of a YAML configuration")
    learn.add_argument("--config", required=True)
    learn.add_argument("--dry-run", action="store_true", help="print the resolved jobs and stop")
    for name in ("evaluation", "selected", "extrapolation", "space"):
        sub = commands.add_parser(name)
        sub.add_argument("--results-dir", default="results")
        sub.add_argument("--data-dir", default="data")
        if name == "space":
            sub.add_argument("--round-ids", nargs="+")
            sub.add_argument("--target-classes", nargs="+")
            sub.add_argument("--top-n-scaffolds", type=int, default=20)
        else:
            sub.add_argument("--round-id", default="round_synthetic")
            sub.add_argument("--dataset-labels", nargs="+")
        if name == "evaluation":
            sub.add_argument("--metric", default="spearman")
        if name == "selected":
            sub.add_argument("--disagreement-column", default="branch_rank_sd")
        if name == "extrapolation":
            sub.add_argument("--assay-round-ids", nargs="+")
            sub.add_argument("--tanimoto-threshold", type=float, default=0.40)
    return root


def main(argv: list[str] | None = None) -> None:
    """Run one command."""
    args = parser().parse_args(argv)
    if args.command == "learn":
        jobs = load_run_config(args.config)["jobs"]
        if args.dry_run:
            for i, job in enumerate(jobs, start=1):
                print(job_text(job, i))
            return
        spark = get_spark()
        for job in jobs:
            print(job_text(job))
            done = learner.run_job(spark, job)
            print(fields("[saved]", {"summary": done["summary_path"], "merged": done["merged_inference_path"]}))
        return
    spark = get_spark()
    if args.command == "evaluation":
        paths = diagnostics.evaluation_diagnostics(
            spark, args.results_dir, args.round_id, args.dataset_labels, args.metric
        )
    elif args.command == "selected":
        paths = diagnostics.selected_model_diagnostics(
            spark, args.results_dir, args.round_id, args.dataset_labels, args.disagreement_column
        )
    elif args.command == "space":
        paths = diagnostics.chemical_space_diagnostics(
            spark, args.data_dir, args.results_dir, args.round_ids, args.target_classes, args.top_n_scaffolds
        )
    else:
        paths = diagnostics.extrapolation_diagnostics(
            spark,
            args.data_dir,
            args.results_dir,
            args.round_id,
            args.assay_round_ids,
            args.dataset_labels,
            args.tanimoto_threshold,
        )
    for name, path in paths.items():
        print(fields("[saved]", {name: path}))


if __name__ == "__main__":
    main()
