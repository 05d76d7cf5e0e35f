"""Structured Streaming over a directory of arriving captures."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framedrift.plans.job import run_captures
from framedrift.plans.plan import Step
from framedrift.sources import discovery
from framedrift.sources.packets import read_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _arriving(spark: SparkSession, root: str, per_batch: int | None) -> DataFrame:
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", discovery.CAPTURE_GLOB)
    )
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(root)


def stream_packets(
    spark: SparkSession, root: str, mode: str = "STRICT", per_batch: int | None = None
) -> DataFrame:
    """Streaming DataFrame of packets; row-local operators (loss, copies, frame edits) apply to it.

    The stream carries paths and lengths, and each file is read where its packets are needed, a step in
    memory at a time, so files may have any size.
    """
    files = _arriving(spark, root, per_batch).select("path", "length")
    files = files.withColumn("capture_id", discovery.relative_to(F.col("path"), root))
    return read_files(files.filter(discovery.outside_encrypted(F.col("capture_id"))), mode)


def perturb_arrivals(
    spark: SparkSession,
    in_root: str,
    out_root: str,
    plan: list[Step],
    checkpoint: str,
    per_batch: int | None = None,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Run the directory job on every batch of new captures.

    The stream carries paths and lengths only; a batch holds whole files, so chunks are
    complete and large captures are split as in the batch job. The checkpoint remembers
    finished batches; a repeated batch writes the same bytes under the same run id.
    """
    # Streams into one output keep ledgers of their own.
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    files = _arriving(spark, in_root, per_batch).select(
        "path", "length", F.col("modificationTime").alias("modification_time")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        captures = discovery.captures_from_listing(batch, in_root)
        run_captures(captures, out_root, plan, run_id=f"batch-{stream}-{batch_id}", **options)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
