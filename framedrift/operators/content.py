"""Steps that edit frame bytes, each on its own sample of the packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framedrift.functions.draws import chance, row_draw
from framedrift.functions.frames import forge_length, shift_sequence
from framedrift.functions.octets import pad_to
from framedrift.operators.rowwise import apply_rowwise
from framedrift.operators.selection import alive, mark


def _sampled(df: DataFrame, pct: float, seed: int, step: int) -> DataFrame:
    flag = chance(row_draw(seed, step), pct) & alive()
    if "_closed" in df.columns:
        flag = flag & ~F.col("_closed")
    return df.withColumn("_flag", flag)


def seq_offset(
    df: DataFrame, pct: float, seed: int, step: int, offset: int = 1000, native: bool = False, checksums: str = "recompute"
) -> DataFrame:
    """Shift the TCP sequence number of a sample."""
    df = shift_sequence(_sampled(df, pct, seed, step), "_flag", offset, native, checksums)
    return mark(df, step, F.col("_flag")).drop("_flag")


def length_forge(
    df: DataFrame,
    pct: float,
    seed: int,
    step: int,
    new_len: int | None = None,
    pad: bytes = b"\x00",
    lengths: str = "all",
    native: bool = False,
) -> DataFrame:
    """Forge the payload length of a sample."""
    df = _sampled(df, pct, seed, step)
    df = forge_length(df, "_flag", new_len, pad, lengths, native)
    return mark(df, step, F.col("_flag")).drop("_flag")


def by_row(
    df: DataFrame, pct: float, seed: int, step: int, function: Callable, params: dict, batched: bool, rounds: int, track: bool = False
) -> DataFrame:
    """Put a sample through a function of one packet; ``rounds`` copying steps came before."""
    df = _sampled(df, pct, seed, step)
    lost = step if track else None
    return apply_rowwise(df, function, params, batched, flag="_flag", step=step, copy_unit=1 << rounds, lost_step=lost).drop("_flag")


def fix_length(df: DataFrame, length: int, pad: bytes = b"\x0f", flag: str = "selected") -> DataFrame:
    """Force flagged frames to ``length`` bytes; checksums are left alone."""
    if length < 0:
        raise ValueError(f"length must be >= 0, not {length}")
    forced = pad_to(F.col("frame"), length, pad)
    return df.withColumn("frame", F.when(F.col(flag), forced).otherwise(F.col("frame")))


def edit_frames(
    df: DataFrame, steps: list, seed: int, on_length_change: str = "keep", native: bool = False, rowwise: bool = False
) -> DataFrame:
    """Apply content steps, given as functions of (df, native), in order.

    ``on_length_change='revert'`` gives a frame back as it was, with all its edits undone,
    when they changed its length. ``rowwise`` says that there are steps by row among them; the frames of
    their lists have any length.
    """
    if on_length_change not in ("keep", "revert"):
        raise ValueError(f"on_length_change must be 'keep' or 'revert', not {on_length_change!r}")
    if not steps:
        return df
    revert = on_length_change == "revert"
    kept = {"_size": F.length("frame")}
    if revert:
        kept |= {"_before": F.col("frame"), "_mask": F.col("applied")}
    if rowwise:
        kept |= {"_closed": F.lit(False)}
    df = df.withColumns(kept)
    for step in steps:
        df = step(df, native)
    changed = F.length("frame") != F.col("_size")
    if revert:
        changed = changed & ~F.col("_closed") if rowwise else changed
        df = df.withColumns(
            {
                "applied": F.when(changed, F.col("_mask")).otherwise(F.col("applied")),
                "frame": F.when(changed, F.col("_before")).otherwise(F.col("frame")),
            }
        )
    elif "orig_len" in df.columns:
        # The length on the wire stays as captured unless the frame itself changed size.
        resized = F.when(changed, F.length("frame")).otherwise(F.col("orig_len"))
        df = df.withColumn("orig_len", resized)
    return df.drop("_before", "_mask", "_size", "_closed")
