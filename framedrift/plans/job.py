"""Directory job: discover captures, perturb them, write them, keep a ledger of runs."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framedrift.operators import selection
from framedrift.operators.statistics import counters
from framedrift.plans.fixed_length import DEFAULT_PAD, force_length, force_trace
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import Step, plan_text
from framedrift.sinks.captures import check_sink, finished_parts, for_each, place_fragments, write_fragments
from framedrift.sources import discovery
from framedrift.sources.files import broadcast_if_small, clearing, delete_folder, resolve, settle
from framedrift.sources.packets import SPLIT_BYTES, read_packets

RUNS_FOLDER = "_runs"
SUMMARY_ROWS = 10


def _header_rows(captures: DataFrame, like: DataFrame) -> DataFrame:
    """One lost row per readable capture, so that an empty capture still gets its file."""
    values = {
        "capture_id": F.col("capture_id"),
        "linktype": F.coalesce(F.col("linktype"), F.lit(discovery.DEFAULT_LINKTYPE)),
        "repaired": F.lit("header"),
        "packet_no": F.lit(0),
    }
    columns = [
        values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        for field in like.schema.fields
    ]
    return captures.filter("error is null").select(*columns)


def run_trace(
    captures: DataFrame,
    out_root: str,
    make_trace: Callable[[DataFrame, DataFrame], DataFrame],
    counted: dict[str, Column],
    facts: dict,
    mode: str,
    layout: str = "mirror",
    resume: bool = False,
    split_bytes: int = SPLIT_BYTES,
    run_id: str | None = None,
    part_files: bool = False,
    part_of: Column | None = None,
) -> DataFrame:
    """Read captures, make a trace of their packets, write it, and keep a ledger of the run.

    ``make_trace(packets, headed)`` gets the packets, with one header row per readable capture, and the
    captures with their headers. ``facts`` are columns of the ledger that are the same in every row.
    ``part_of``, the part of a packet, lets a run that stopped go on where it was: under the same
    ``run_id``, with the same facts and unchanged captures, parts that it has finished are not read into
    the trace again, and their fragments are used as they are.
    """
    if part_of is not None and run_id is None:
        raise ValueError("a run that can go on needs a run_id")
    with clearing():
        return _run_trace(captures, out_root, make_trace, counted, facts, mode, layout, resume, split_bytes, run_id, part_files, part_of)


def _still_good(spark: SparkSession, headed: DataFrame, staging: str, attempt: str, counted: list[str]) -> DataFrame:
    """Parts that earlier attempts have finished, of captures whose files have not changed since any of them."""
    now = headed.select("capture_id", "length", "modification_time")
    before = [f"{staging}/{name}" for name in discovery.folder_names(staging) if name.startswith("files-")]
    kept = finished_parts(spark, f"{staging}/parts", counted).join(now.select("capture_id"), "capture_id", "left_semi")
    if before:
        then = spark.read.parquet(*before).toDF("capture_id", "_length", "_time")
        changed = now.join(then, "capture_id").filter("length <> _length or modification_time <> _time").select("capture_id")
        kept = kept.join(changed, "capture_id", "left_anti")
    now.write.parquet(f"{staging}/files-{attempt}")
    return kept


def _without_parts(packets: DataFrame, kept: DataFrame, part_of: Column) -> DataFrame:
    """Packets outside the parts that are there already; rows with an error stay."""
    many = kept.count()
    done = broadcast_if_small(kept.select("capture_id", F.col("part_id").alias("_part")), many)
    packets = packets.withColumn("_part", F.when(F.col("error").isNull(), part_of))
    return packets.join(done, ["capture_id", "_part"], "left_anti").drop("_part")


def _run_trace(
    captures: DataFrame, out_root: str, make_trace: Callable, counted: dict[str, Column], facts: dict, mode: str, layout: str,
    resume: bool, split_bytes: int, run_id: str | None, part_files: bool, part_of: Column | None,
) -> DataFrame:
    spark = captures.sparkSession
    begin = time.monotonic()
    run_id = run_id or uuid.uuid4().hex
    out_root = out_root.rstrip("/")
    check_sink(out_root, part_files)
    # A run that is repeated under its name must not meet what an earlier attempt has left, unless it goes on.
    same = hashlib.sha256(json.dumps([facts, sorted(counted), mode, layout, part_files]).encode()).hexdigest()[:12]
    attempt = uuid.uuid4().hex[:8]
    staging = f"{out_root}/_staging-{run_id}-{attempt if part_of is None else same}"

    captures = settle(discovery.with_output(captures, out_root, layout))
    clashes = discovery.output_clashes(captures).orderBy("output").limit(SUMMARY_ROWS).collect()
    if clashes:
        raise ValueError(f"several captures would write {[row.output for row in clashes]}")
    skipped = None
    if resume:
        discovery.make_folder(out_root)
        skipped = settle(discovery.existing_outputs(spark, out_root, captures))
        captures = settle(discovery.without_done(captures, skipped))

    headed = settle(discovery.read_headers(captures))
    packets = read_packets(headed, mode, split_bytes)
    packets = packets.unionByName(_header_rows(headed, packets))
    if part_of is not None:
        kept = settle(_still_good(spark, headed, staging, attempt, list(counted)))
        packets = _without_parts(packets, kept, part_of)
    trace = make_trace(packets, headed)
    ledger = write_fragments(trace, f"{staging}/parts", counted, part_files, marked=part_of is not None)
    ledger.write.mode("overwrite").parquet(f"{staging}/ledger-{attempt}")
    ledger = spark.read.parquet(f"{staging}/ledger-{attempt}")
    if part_of is not None:
        again = ledger.select("capture_id", "part_id")
        ledger = settle(ledger.unionByName(kept.join(again, ["capture_id", "part_id"], "left_anti")))
    placed = place_fragments(ledger, captures, staging, part_files)

    sums = ledger.groupBy("capture_id").agg(*[F.sum(name).alias(name) for name in counted])
    runs = headed.withColumnRenamed("error", "_unreadable").join(sums, "capture_id", "left")
    runs = runs.join(placed.select("capture_id", "error", "bytes", "parts"), "capture_id", "left")
    runs = runs.withColumn("error", F.coalesce("_unreadable", "error")).withColumns(
        {
            "status": F.when(F.col("error").isNull(), "done").otherwise("error"),
            "reason": F.lit(None).cast("string"),
        }
    )
    if part_of is not None:
        kept = kept.groupBy("capture_id").agg(F.count("*").alias("parts_kept"))
        runs = runs.join(kept, "capture_id", "left").fillna(0, ["parts_kept"])
        counted = counted | {"parts_kept": None}
    shown = ["capture_id", "path", "output", "date_dir", "status", "reason", "error"]
    runs = runs.select(*shown, "bytes", "parts", *counted)
    if skipped is not None:
        skips = skipped.withColumns({"status": F.lit("skipped"), "reason": F.lit("exists")})
        runs = runs.unionByName(skips.select(*shown[:4], "status", "reason"), allowMissingColumns=True)
    runs = runs.withColumns(
        {name: F.lit(value) for name, value in facts.items()}
        | {
            "run_id": F.lit(run_id),
            "finished_at": F.current_timestamp(),
            "run_elapsed_sec": F.lit(round(time.monotonic() - begin, 3)),
        }
    )
    target = f"{out_root}/{RUNS_FOLDER}/run_id={run_id}"
    runs.drop("run_id").write.mode("overwrite").parquet(target)
    delete_folder(staging)
    return spark.read.parquet(target).withColumn("run_id", F.lit(run_id))


def run_captures(
    captures: DataFrame,
    out_root: str,
    plan: list[Step],
    seed: int = 0,
    chunk_size: int = selection.DEFAULT_CHUNK,
    chunks_per_part: int = selection.DEFAULT_CHUNKS_PER_PART,
    layout: str = "mirror",
    resume: bool = False,
    split_bytes: int = SPLIT_BYTES,
    mode: str | None = None,
    run_id: str | None = None,
    part_files: bool = False,
    resume_parts: bool = False,
    metadata: bool = False,
    **options,
) -> DataFrame:
    """Perturb a table of captures (see ``discover``); returns the ``runs`` rows of this run.

    Repair is on when the plan leaves frame bytes alone and off when it edits them, unless
    ``mode`` says otherwise. ``part_files`` writes finished captures of ``chunks_per_part`` chunks each,
    for outputs that are no mounted file system. ``resume_parts``, with a ``run_id``, lets a run that
    stopped go on at its unfinished parts when it is started again. ``metadata`` writes a JSON file beside
    each output. ``options`` go to :func:`perturb`.
    """
    if mode is None:
        mode = "STRICT" if any(step.edits_content for step in plan) else "REPAIR"

    def make_trace(packets: DataFrame, headed: DataFrame) -> DataFrame:
        return perturb(packets, plan, seed, chunk_size, chunks_per_part, track=True, **options)

    facts = {"plan": plan_text(plan), "seed": seed, "chunk_size": chunk_size}
    part_of = None
    if resume_parts:
        facts |= {"chunks_per_part": chunks_per_part, "options": json.dumps(options, sort_keys=True)}
        part_of = F.floor(F.floor(F.col("packet_no") / chunk_size) / chunks_per_part).cast("long")
    runs = run_trace(
        captures, out_root, make_trace, counters(plan, repaired=True), facts, mode, layout, resume, split_bytes, run_id, part_files, part_of
    )
    if metadata:
        write_metadata(runs)
    return runs


def run_fixed_length(
    captures: DataFrame,
    out_root: str,
    percent: float,
    length: int,
    pad: bytes = DEFAULT_PAD,
    seed: int = 0,
    exact: bool = False,
    chunk_size: int = selection.DEFAULT_CHUNK,
    split_bytes: int = SPLIT_BYTES,
    **options,
) -> DataFrame:
    """Force a share of the packets of each capture to one length; ledger as for plans.

    ``options`` are layout, resume, run_id and part_files.
    """

    def make_trace(packets: DataFrame, headed: DataFrame) -> DataFrame:
        # The exact sample is drawn from a scan that leaves the frames where they are.
        light = read_packets(headed, "STRICT", split_bytes, with_frames=False) if exact else None
        header = F.coalesce(F.col("repaired") == "header", F.lit(False))
        forced = force_length(packets.filter(~header), percent, length, pad, seed, exact, light)
        forced = forced.unionByName(packets.filter(header), allowMissingColumns=True)
        return force_trace(forced, chunk_size=chunk_size, track=True)

    is_packet = F.coalesce(F.col("repaired"), F.lit("")) != "header"
    counted = {
        "total": (is_packet & F.col("error").isNull()).cast("long"),
        "perturbed": F.coalesce("selected", F.lit(False)).cast("long"),
    }
    facts = {"plan": json.dumps({"percent": percent, "length": length, "pad": pad.hex(), "exact": exact})}
    facts |= {"seed": seed, "chunk_size": chunk_size}
    return run_trace(captures, out_root, make_trace, counted, facts, "STRICT", split_bytes=split_bytes, **options)


def write_metadata(runs: DataFrame) -> None:
    """A JSON file beside each finished output, as ``metadata_path`` names it, with the ledger's row of the capture."""
    path = F.concat(F.regexp_replace("output", r"[.]pcap$", ""), F.lit(".metadata.json"))
    done = runs.filter("status = 'done'").select(path.alias("path"), F.to_json(F.struct(*runs.columns)).alias("text"))

    def write(row: dict) -> None:
        system, inner = resolve(row["path"])
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(row["text"].encode())

    for_each(done, write, runs.sparkSession.sparkContext.defaultParallelism)


def run_directory(
    spark: SparkSession, in_root: str, out_root: str, plan: list[Step], limit: int | None = None, **options
) -> DataFrame:
    """The whole directory below ``in_root``; options as in :func:`run_captures`."""
    check_sink(out_root, options.get("part_files", False))
    return run_captures(discovery.discover(spark, in_root, limit), out_root, plan, **options)


def summary(runs: DataFrame) -> list[str]:
    """The first ten results as JSON."""
    return runs.orderBy("capture_id").limit(SUMMARY_ROWS).toJSON().collect()
