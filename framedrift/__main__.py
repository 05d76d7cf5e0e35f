"""Command line of the directory job, the fixed-length job and the drift report, for ``spark-submit``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from framedrift.operators import drift
from framedrift.operators.selection import DEFAULT_CHUNK, DEFAULT_CHUNKS_PER_PART
from framedrift.plans.job import run_captures, run_fixed_length, summary
from framedrift.plans.plan import QUICK_FLAGS, REORDER_METHODS, load_plan, parse_pad_argument, plan_from_flags
from framedrift.sources import discovery
from framedrift.sources.packets import MODES, SPLIT_BYTES


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="framedrift")
    jobs = parser.add_subparsers(dest="job", required=True)

    run = jobs.add_parser("perturb", help="perturb captures by a plan")
    _io_arguments(run)
    run.add_argument("--plan", help="JSON plan file")
    for kind, value in QUICK_FLAGS.items():
        run.add_argument("--" + kind.replace("_", "-"), help=f"pct:{value}" if value else "pct")
    run.add_argument("--chunk-size", type=int, default=DEFAULT_CHUNK)
    run.add_argument("--chunks-per-part", type=int, default=DEFAULT_CHUNKS_PER_PART)
    run.add_argument("--mode", choices=MODES, help="default: REPAIR unless the plan edits frames")
    run.add_argument("--reorder-method", choices=REORDER_METHODS, default="blocks")
    run.add_argument("--run-id", help="name of the run; needed for --resume-parts")
    run.add_argument("--resume-parts", action="store_true", help="go on at the unfinished parts of a run that stopped")
    run.add_argument("--metadata", action="store_true", help="a JSON file beside each output")
    run.add_argument("--on-length-change", choices=["keep", "revert"], default="keep")

    fixed = jobs.add_parser("fix-length", help="force a share of packets to one length")
    _io_arguments(fixed)
    fixed.add_argument("-n", "--percent", type=float, required=True)
    fixed.add_argument("-l", "--length", type=int, required=True)
    fixed.add_argument("--pad", type=parse_pad_argument, default=b"\x0f")
    fixed.add_argument("--exact", action="store_true")

    report = jobs.add_parser("drift", help="compare two tables of flows")
    report.add_argument("--before", required=True, help="CSV with a header row")
    report.add_argument("--after", required=True, help="CSV with a header row")
    report.add_argument("--distributions", help="folder for histograms and curves of the key features, as CSV")

    parsed = parser.parse_args(argv)
    if parsed.job == "perturb":
        parsed.flags = {kind: getattr(parsed, kind) for kind in QUICK_FLAGS}
        if any(flag is not None for flag in parsed.flags.values()) == bool(parsed.plan):
            parser.error("give either --plan or quick flags")
        if not parsed.plan:
            try:
                parsed.steps = plan_from_flags(**parsed.flags)
            except ValueError as problem:
                parser.error(str(problem))
    return parsed


def _io_arguments(job: argparse.ArgumentParser) -> None:
    source = job.add_mutually_exclusive_group(required=True)
    source.add_argument("--in-root", help="directory of captures named cap*")
    source.add_argument("--in-file", help="one capture of any name")
    job.add_argument("--out-root", required=True)
    job.add_argument("--seed", type=int, default=0)
    job.add_argument("--limit", type=int)
    job.add_argument("--layout", choices=["mirror", "date"], default="mirror")
    job.add_argument("--resume", action="store_true")
    job.add_argument("--split-bytes", type=int, default=SPLIT_BYTES)
    job.add_argument("--part-files", action="store_true", help="one finished capture per part, for any file system")


def _captures(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.in_file:
        return discovery.single_capture(spark, args.in_file)
    return discovery.discover(spark, args.in_root, args.limit)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName("framedrift").getOrCreate()
    if args.job in ("perturb", "fix-length"):
        names = ("seed", "layout", "resume", "split_bytes", "part_files")
        shared = {name: getattr(args, name) for name in names}
    if args.job == "perturb":
        plan = load_plan(Path(args.plan).read_text(encoding="utf-8")) if args.plan else args.steps
        runs = run_captures(
            _captures(spark, args),
            args.out_root,
            plan,
            chunk_size=args.chunk_size,
            chunks_per_part=args.chunks_per_part,
            mode=args.mode,
            reorder_method=args.reorder_method,
            on_length_change=args.on_length_change,
            run_id=args.run_id,
            resume_parts=args.resume_parts,
            metadata=args.metadata,
            **shared,
        )
        print("\n".join(summary(runs)))
    elif args.job == "drift":
        tables = [drift.load_flow_csv(spark, path) for path in (args.before, args.after)]
        report = drift.drift_report(*tables)
        for name in ("rows", "features", "top"):
            print("\n".join(report[name].toJSON().collect()))
        if args.distributions:
            report["distributions"].coalesce(1).write.csv(args.distributions, header=True)
    else:
        runs = run_fixed_length(
            _captures(spark, args), args.out_root, args.percent, args.length, args.pad, exact=args.exact, **shared
        )
        print("\n".join(summary(runs.select("capture_id", "total", "perturbed", "error"))))


if __name__ == "__main__":
    main()
