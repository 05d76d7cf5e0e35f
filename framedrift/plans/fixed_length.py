"""Force a percentage of the packets of captures to a fixed frame length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framedrift.operators import selection
from framedrift.operators.content import fix_length
from framedrift.plans.plan import check_percent

DEFAULT_PAD = b"\x0f"


def force_length(
    packets: DataFrame,
    percent: float,
    length: int,
    pad: bytes = DEFAULT_PAD,
    seed: int = 0,
    exact: bool = False,
    light: DataFrame | None = None,
) -> DataFrame:
    """Packets with ``selected`` and edited frames; times and checksums stay as they are.

    ``exact`` selects round(total * percent / 100) packets of every capture, otherwise
    each packet is selected with that probability. ``light`` is the same packets from a scan without
    frames, from which exact samples are then drawn.
    """
    check_percent(percent)
    packets = packets.withColumn("copy_no", F.lit(0).cast("long"))
    if exact:
        if light is not None:
            light = light.withColumn("copy_no", F.lit(0).cast("long"))
        flagged = selection.flag_exact(packets, percent, seed, drawn_from=light)
    else:
        flagged = selection.flag_bernoulli(packets, percent, seed)
    changed = F.col("selected") & (F.length("frame") != length)
    flagged = flagged.withColumn("orig_len", F.when(changed, length).otherwise(F.col("orig_len")))
    return fix_length(flagged, length, pad)


def force_trace(forced: DataFrame, **chunking) -> DataFrame:
    """The same packets as a gathered trace for the writer, in file order."""
    trace = selection.start_trace(forced.drop("copy_no"), **chunking)
    return selection.gather_parts(trace).withColumn("ts_new_us", F.col("ts_us"))
