"""Seeded draws that depend on row keys only.

A draw is a 32-bit number cut from an MD5 over seed, step and keys. The same row
gets the same draw under any partitioning, after a task is retried, in a batch or
in a stream, and in any other engine that has MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32
ROW_KEYS = ("capture_id", "packet_no", "copy_no")


def draw(seed: int, step: int | str, *keys: str | Column, part: int = 0) -> Column:
    """32-bit draw for the row's ``keys``; ``part`` 0..3 picks independent words of one digest."""
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.lit(str(step)), *[c.cast("string") for c in columns])
    )
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def row_draw(seed: int, step: int | str, part: int = 0) -> Column:
    """Draw of one packet copy."""
    return draw(seed, step, *ROW_KEYS, part=part)


def chance(drawn: Column, pct: float) -> Column:
    """True with probability ``pct`` (0..1): ``drawn / 2^32 < pct`` without leaving integers."""
    return drawn < F.lit(math.ceil(pct * DRAW_RANGE)).cast("long")
