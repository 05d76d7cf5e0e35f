"""Counts per capture, taken from a tracked trace in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.operators.selection import MASK_STEPS, alive, was_applied
from framedrift.plans.plan import CONTENT_STEPS, Step


def counters(plan: list[Step], repaired: bool = False) -> dict[str, Column]:
    """Named 0/1 columns whose sums are the statistics of a run.

    ``loss_drop``, ``retransmit_dup`` and ``reorder_packets`` are sums over the whole
    capture and over all steps of their kind; ``step_<k>`` holds each step by itself.
    Selection steps count what they hit even if a later step drops it, steps by row each frame they give
    and each packet they drop.
    """
    kinds = {"loss": "loss_drop", "retransmit": "retransmit_dup", "reorder": "reorder_packets"}
    one = lambda condition: condition.cast("long")
    per_step = {
        f"step_{s.number}": one(was_applied(s.number, len(plan) > MASK_STEPS) & (alive() if s.type in CONTENT_STEPS else F.lit(True)))
        for s in plan
    }
    named = {
        "total_in": one((F.col("copy_no") == 0) & F.coalesce(F.col("lost_at") >= 0, F.lit(True))),
        "total_out": one(alive()),
    }
    for kind, name in kinds.items():
        parts = [per_step[f"step_{s.number}"] for s in plan if s.type == kind]
        named[name] = sum(parts, start=F.lit(0).cast("long"))
    if repaired:
        fixed = F.col("repaired").isin("capped", "truncated") & (F.col("copy_no") == 0)
        named["repaired_packets"] = one(F.coalesce(fixed, F.lit(False)))
        gone = F.col("repaired") == "discarded"
        named["discarded_records"] = one(F.coalesce(gone, F.lit(False)))
    return named | per_step


def run_counts(trace: DataFrame, plan: list[Step]) -> DataFrame:
    """Statistics per capture of a trace made with ``track=True``."""
    named = counters(plan, "repaired" in trace.columns)
    rows = trace.select("capture_id", *[column.alias(name) for name, column in named.items()])
    return rows.groupBy("capture_id").agg(*[F.sum(name).alias(name) for name in named])


def selected_counts(flagged: DataFrame) -> DataFrame:
    """Total and selected packets per capture."""
    return flagged.groupBy("capture_id").agg(
        F.count("*").alias("total"), F.count_if("selected").alias("perturbed")
    )
