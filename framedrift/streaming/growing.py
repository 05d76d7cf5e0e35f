"""Captures that grow: whole plans run on the stream, a part of a capture as soon as it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framedrift.operators.selection import DEFAULT_CHUNK, DEFAULT_CHUNKS_PER_PART
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import Step
from framedrift.sinks.captures import place_fragments, write_fragments
from framedrift.sources import discovery
from framedrift.sources.capture_format import register_format
from framedrift.sources.files import broadcast_if_small, clearing, delete_folder, settle


class Growing:
    """One growing directory and its outputs, ``name.part-00000.pcap`` and so on, as the job's ``part_files`` are.

    A part is ``chunks_per_part`` chunks of ``chunk_size`` packets. Packets of parts that are not complete
    wait in the checkpoint folder, in one table per batch, so a batch that is repeated starts from the same
    ones. Nothing a plan does reaches over a part, so parts come out as in the batch job.
    """

    def __init__(
        self, out_root: str, plan: list[Step], checkpoint: str, seed: int = 0, chunk_size: int = DEFAULT_CHUNK,
        chunks_per_part: int = DEFAULT_CHUNKS_PER_PART, mode: str | None = None, **options,
    ):
        self.out_root, self.checkpoint = out_root.rstrip("/"), checkpoint.rstrip("/")
        self.plan, self.seed, self.options = plan, seed, options
        self.chunk_size, self.chunks_per_part = chunk_size, chunks_per_part
        self.mode = mode or ("STRICT" if any(step.edits_content for step in plan) else "REPAIR")

    def start(self, spark: SparkSession, in_root: str, available_now: bool = True, **source) -> StreamingQuery:
        """Follow the captures below ``in_root``; ``source`` are options of the format, such as maxBytesPerTrigger."""
        register_format(spark)
        packets = spark.readStream.format("pcap").options(mode=self.mode, state=f"{self.checkpoint}/ends", **source).load(in_root)
        writer = packets.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.checkpoint}/stream")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _part(self):
        return F.floor(F.floor(F.col("packet_no") / self.chunk_size) / self.chunks_per_part).cast("long")

    def _waiting(self, spark: SparkSession) -> list[int]:
        names = discovery.folder_names(f"{self.checkpoint}/waiting")
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("batch-"))

    def _batch(self, batch: DataFrame, number: int) -> None:
        with clearing():
            spark = batch.sparkSession
            rows = settle(batch)
            rows.filter("error is not null").write.mode("overwrite").parquet(f"{self.checkpoint}/errors/batch-{number}")
            rows = rows.filter("error is null")
            before = [n for n in self._waiting(spark) if n < number]
            if before:
                rows = rows.unionByName(spark.read.parquet(f"{self.checkpoint}/waiting/batch-{before[-1]}"))
            # The last part of each capture may go on, be it full: a discarded record may still belong to it.
            last = settle(rows.groupBy("capture_id").agg(F.max(self._part()).alias("_last")))
            rows = rows.join(broadcast_if_small(last, last.count()), "capture_id").withColumn("_open", self._part() == F.col("_last")).drop("_last")
            rows.filter("_open").drop("_open").write.mode("overwrite").parquet(f"{self.checkpoint}/waiting/batch-{number}")
            self._write(rows.filter("not _open").drop("_open"))
        for done in before[:-1]:
            delete_folder(f"{self.checkpoint}/waiting/batch-{done}")

    def finish(self, spark: SparkSession) -> None:
        """Write what waits: the captures will not grow any more."""
        waiting = self._waiting(spark)
        if waiting:
            with clearing():
                self._write(spark.read.parquet(f"{self.checkpoint}/waiting/batch-{waiting[-1]}"))

    def errors(self, spark: SparkSession) -> DataFrame:
        """(capture_id, error) of captures that could not be read on."""
        names = [f"{self.checkpoint}/errors/{n}" for n in discovery.folder_names(f"{self.checkpoint}/errors")]
        return spark.read.parquet(*names).select("capture_id", "error")

    def _write(self, packets: DataFrame) -> None:
        spark = packets.sparkSession
        staging = f"{self.out_root}/_staging-{uuid.uuid4().hex}"
        trace = perturb(packets, self.plan, self.seed, self.chunk_size, self.chunks_per_part, **self.options)
        write_fragments(trace, f"{staging}/parts", part_files=True).write.parquet(f"{staging}/ledger")
        ledger = spark.read.parquet(f"{staging}/ledger")
        named = discovery.with_output(discovery.with_names(ledger.select("capture_id").distinct()), self.out_root)
        place_fragments(ledger, named, f"{staging}/parts", part_files=True)
        delete_folder(staging)
