"""Output positions and strictly increasing times inside a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framedrift.operators.selection import alive, chunk_order


def number_positions(df: DataFrame) -> DataFrame:
    """Add ``out_no``: 0-based position of each surviving packet in its chunk."""
    number = (F.row_number().over(chunk_order()) - 1).cast("long")
    return df.withColumn("out_no", F.when(alive(), number))


def retime(df: DataFrame) -> DataFrame:
    """Add ``ts_new_us``: strictly increasing times in output order.

    The first packet keeps its time. Each next one follows its predecessor at their
    original distance, or after 1 microsecond where that distance is not positive. The
    recurrence is a running sum of max(distance, 1), so it is one window.
    """
    order = chunk_order()
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("ts_us") - F.lag("ts_us").over(order)
    df = df.withColumn("_gap", F.greatest(step, F.when(step.isNotNull(), F.lit(1))))
    moved = F.first("ts_us").over(upto) + F.sum(F.coalesce("_gap", F.lit(0))).over(upto)
    return df.withColumn("ts_new_us", F.when(alive(), moved)).drop("_gap")
