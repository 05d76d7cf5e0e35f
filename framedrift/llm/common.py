"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framedrift.sources.files import settle, shared_folder

__all__ = ["blank_null", "fold", "read_table", "settle", "shared_folder", "split_join", "unused"]

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
HOT_KEYS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Arrow batches are bounded in rows and bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to differ from ``columns``, case aside."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def blank_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; null keys count as the text ''."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) without sending a hot key to one task.

    ``right`` has in column ``rows`` how many rows of ``left`` hold its key. A key counts as hot at
    ``total / HOT_KEYS`` rows, so at most HOT_KEYS of them exist whatever the size: these are
    broadcast, and their rows are not shuffled. All other keys are joined as usual.
    """
    hot_at = max(1000, -(-total // HOT_KEYS))
    right = right.select([F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    hot, cold = right.where(F.col(rows) >= hot_at), right.where(F.col(rows) < hot_at)
    right_keys = [f"_right_{k}" for k in keys]
    met = left.join(F.broadcast(hot), same, "inner").drop(*right_keys)
    unmet = left.join(F.broadcast(hot.select(*right_keys)), same, "left_anti")
    return met.unionByName(unmet.join(cold, same, how).drop(*right_keys))
