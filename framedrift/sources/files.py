"""Files on any mounted or Arrow-supported file system, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a Spark path."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def open_input(path: str) -> BinaryIO:
    """Seekable reader."""
    system, inner = resolve(path)
    return system.open_input_file(inner)


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one on a single machine only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="framedrift-"))
    return context.getCheckpointDir()


_SETTLED: ContextVar[list[str] | None] = ContextVar("settled", default=None)


@contextmanager
def clearing() -> Iterator[None]:
    """Delete at the end what ``settle`` stores inside; for jobs whose result does not read it any more."""
    paths: list[str] = []
    outer = _SETTLED.set(paths)
    try:
        yield
    finally:
        _SETTLED.reset(outer)
        for path in paths:
            delete_folder(path)


def delete_folder(path: str) -> None:
    """Delete a folder that this library made; nothing if it is not there."""
    system, inner = resolve(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        system.delete_dir(inner)


def settle(df: DataFrame) -> DataFrame:
    """Store a table that several later jobs read in the shared folder: computed once, no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    if (paths := _SETTLED.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Shuffle a table of fewer files than cores, for CPU-heavy row work; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a table of known size, in rows and in Spark's estimate of its bytes; beyond that the join shuffles."""
    if rows > limit:
        return df
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if estimate <= most_bytes else df
