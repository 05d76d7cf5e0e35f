"""Compile a plan into one DataFrame: a fold of trace operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framedrift.operators import content, selection
from framedrift.operators.retime import retime
from framedrift.plans.plan import COPYING_STEPS, CUSTOM_STEPS, ROW_STEPS, Step


def _content_step(step: Step, seed: int, rounds: int, track: bool):
    if step.by_row:
        function, batched = ROW_STEPS[step.type]
        return lambda df, native: content.by_row(df, step.pct, seed, step.number, function, step.params, batched, rounds, track)
    if step.type == "seq_offset":
        return lambda df, native: content.seq_offset(
            df, step.pct, seed, step.number, step.params["offset"], native, step.params.get("checksums", "recompute")
        )
    return lambda df, native: content.length_forge(
        df,
        step.pct,
        seed,
        step.number,
        step.params["new_len"],
        step.params["pad"],
        native=native,
    )


def perturb(
    packets: DataFrame,
    plan: list[Step],
    seed: int = 0,
    chunk_size: int = selection.DEFAULT_CHUNK,
    chunks_per_part: int = selection.DEFAULT_CHUNKS_PER_PART,
    track: bool = False,
    on_length_change: str = "keep",
    reorder_method: str = "blocks",
    native: bool = False,
) -> DataFrame:
    """Packets after the plan, with their output order (``pos``) and times (``ts_new_us``).

    Selection steps run in plan order, then content steps on what survived; each copy has
    draws of its own. Everything up to the last copying step is row-local and runs in the
    scan stage, frame edits included; then one shuffle by (capture, part) serves all
    windows over chunks and the writer. ``track`` keeps lost rows for the statistics.

    Steps by row, and content steps behind one, run after the re-timing instead, so that the frames of a
    list share a time and a dropped one moves no other. They leave rows in their tasks, so the writer
    still finds its parts together.
    """
    df = selection.start_trace(packets, chunk_size, chunks_per_part, track, wide=len(plan) > selection.MASK_STEPS)
    choosing = [step for step in plan if not step.edits_content]
    contents = [step for step in plan if step.edits_content]
    first = next((i for i, step in enumerate(contents) if step.by_row), len(contents))
    if on_length_change == "revert" and first < len(contents):
        first = 0  # all edits of a frame are undone together
    copying = sum(step.type in COPYING_STEPS for step in choosing)
    # Copy numbers are dense again after a renumbering, which leaves 32 bits to the frames of lists.
    unit = copying if copying <= selection.COPYING_AT_ONCE else 32
    editing, late = ([_content_step(step, seed, unit, track) for step in some] for some in (contents[:first], contents[first:]))
    multiplying = [
        i for i, step in enumerate(choosing) if step.type in COPYING_STEPS + tuple(CUSTOM_STEPS)
    ]
    edit_after = multiplying[-1] if multiplying else -1

    edit = partial(
        content.edit_frames,
        steps=editing,
        seed=seed,
        on_length_change=on_length_change,
        native=native,
    )
    span, rounds, gathered = chunk_size, 0, False
    lossy_first = next((i for i, s in enumerate(choosing) if s.type != "loss"), len(choosing))
    edit_after = max(edit_after, lossy_first - 1)
    if edit_after < 0:
        df = edit(df)
    for i, step in enumerate(choosing):
        method = (step.params.get("method") or reorder_method) if step.type == "reorder" else None
        if (step.type == "rate_modify" or method == "blocks") and not gathered:
            df, gathered = selection.gather_parts(df), True
        if step.type in COPYING_STEPS:
            if rounds % 32 == selection.COPYING_AT_ONCE:
                df = selection.renumber(df if gathered else selection.gather_parts(df))
                # Whatever copies there were are numbered below 2^32 now.
                gathered, rounds, span = True, 32, 1 << 32
            rounds += 1
        if step.type == "loss":
            df = selection.lose(df, step.pct, seed, step.number, track)
        elif step.type == "retransmit":
            df = selection.retransmit(df, step.pct, seed, step.number, span, rounds)
            span *= 2
        elif step.type == "rate_modify":
            df = selection.rate_modify(df, step.pct, seed, step.number, rounds)
            span *= 2
        elif step.type == "reorder":
            df = selection.reorder(df, step.pct, step.params["m"], seed, step.number, method)
            gathered = True
        else:
            # Header rows carry the file header of a capture and are not the step's to drop.
            header = F.coalesce(F.col("repaired") == "header", F.lit(False)) if "repaired" in df.columns else F.lit(False)
            changed = CUSTOM_STEPS[step.type](df.filter(~header), step, seed)
            df, gathered = changed.unionByName(df.filter(header), allowMissingColumns=True), False
        if i == edit_after:
            # An Arrow UDF hides the partitioning of its input, so the shuffle comes after it.
            df = edit(df)
            gathered = gathered and not editing
    if not gathered:
        df = selection.gather_parts(df)
    if late and copying > selection.COPYING_AT_ONCE:
        df = selection.renumber(df)
    df = retime(df)
    if not late:
        return df
    df = content.edit_frames(df, late, seed, on_length_change, native, rowwise=True)
    return df.withColumns({name: F.when(selection.alive(), F.col(name)) for name in ("pos", "ts_new_us")}) if track else df
