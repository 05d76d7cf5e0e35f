"""Write classic captures in parallel.

Rows arrive shuffled by (capture, part), a part being a bounded run of chunks. A task
writes each part to a fragment of its own in a staging folder and reports it in a ledger.
Placing the fragments is a second job over the ledger, where running sums of the sizes
give each fragment its offset in the output: a capture of one part is renamed, the parts
of a large one are copied to their offsets by as many tasks. Outputs appear under their
name by rename, whole or not at all, and a retried task can only repeat the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framedrift.sources.files import resolve, settle

# Fixed values of the written format: little-endian, microseconds, version 2.4, snaplen 65535.
WRITTEN_MAGIC = b"\xd4\xc3\xb2\xa1"
WRITTEN_VERSION = (2, 4)
WRITTEN_SNAPLEN = 65_535
FILE_HEADER_BYTES = 24

COPY_BYTES = 8 << 20
STAGING_FOLDERS = 256
FINISHED = ".finished.json"


def file_header(linktype: int) -> bytes:
    """Header of a written capture."""
    fields = (*WRITTEN_VERSION, 0, 0, WRITTEN_SNAPLEN, linktype)
    return WRITTEN_MAGIC + struct.pack("<HHIIII", *fields)


def record_bytes(batch: pa.RecordBatch) -> bytes:
    """Records of the batch's rows, headers and frames interleaved."""
    frames = batch.column("frame").to_pylist()
    sizes = np.fromiter(map(len, frames), np.uint32, len(frames))
    originals = batch.column("orig_len").to_numpy(zero_copy_only=False)
    times = batch.column("ts_us").to_numpy(zero_copy_only=False)
    heads = np.empty((len(frames), 4), "<u4")
    heads[:, 0] = times // 1_000_000
    heads[:, 1] = times % 1_000_000
    heads[:, 2] = sizes
    heads[:, 3] = np.maximum(originals, sizes)
    packed = heads.tobytes()
    pieces = [b""] * (2 * len(frames))
    pieces[::2] = [packed[16 * i : 16 * i + 16] for i in range(len(frames))]
    pieces[1::2] = frames
    return b"".join(pieces)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Slices of equal (capture_id, part_id) of a sorted batch."""
    captures = batch.column("capture_id").dictionary_encode().indices.to_numpy()
    parts = batch.column("part_id").to_numpy(zero_copy_only=False)
    changes = np.flatnonzero((np.diff(captures) != 0) | (np.diff(parts) != 0)) + 1
    bounds = [0, *changes.tolist(), batch.num_rows]
    for begin, end in zip(bounds, bounds[1:]):
        piece = batch.slice(begin, end - begin)
        yield piece.column("capture_id")[0].as_py(), int(parts[begin]), piece


class _Fragment:
    """One part being written, and its row of the ledger."""

    def __init__(self, staging: str, capture_id: str, part_id: int, counted: list[str], headed: bool):
        # Many captures make many fragments; no folder should hold them all.
        staging = f"{staging}/{zlib.crc32(capture_id.encode()) % STAGING_FOLDERS:02x}"
        self.system, folder = resolve(staging)
        self.system.create_dir(folder, recursive=True)
        name = f"{part_id}-{uuid.uuid4().hex}"
        self.inner = f"{folder}/{name}"
        self.row = {"capture_id": capture_id, "part_id": part_id, "fragment": f"{staging}/{name}"}
        self.row |= {"bytes": 0, "error": None, "linktype": None} | dict.fromkeys(counted, 0)
        self.headed = headed
        self.out = self.system.open_output_stream(self.inner)

    def add(self, rows: pa.RecordBatch, counted: list[str]) -> None:
        for name in counted:
            self.row[name] += pc.sum(rows.column(name)).as_py() or 0
        errors = rows.column("error").drop_null()
        if len(errors) and not self.row["error"]:
            self.row["error"] = errors[0].as_py()
        links = rows.column("linktype").drop_null()
        if len(links) and self.row["linktype"] is None:
            self.row["linktype"] = links[0].as_py()
            if self.headed:
                self._put(file_header(self.row["linktype"]))
        held = rows.filter(pc.is_valid(rows.column("frame")))
        if held.num_rows:
            self._put(record_bytes(held))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.row["bytes"] += len(data)

    def close(self, marked: bool) -> dict:
        self.out.close()
        if marked:
            # By rename, so that a note is whole; it says that the part need not be written again.
            with self.system.open_output_stream(f"{self.inner}.new") as note:
                note.write(json.dumps(self.row).encode())
            self.system.move(f"{self.inner}.new", f"{self.inner}{FINISHED}")
        return self.row


def write_fragments(
    trace: DataFrame, staging: str, counted: dict[str, Column] | None = None, part_files: bool = False, marked: bool = False
) -> DataFrame:
    """Write every (capture, part) of a gathered trace to a fragment; gives the ledger.

    Part 0 of a capture starts with the file header, with ``part_files`` every part. Columns ``counted`` are summed per
    part on the way, so statistics need no pass of their own. ``marked`` leaves a note beside each
    finished fragment, for ``finished_parts``.
    """
    counted = counted or {}
    names = list(counted)
    has_error = "error" in trace.columns
    rows = trace.sortWithinPartitions(
        "capture_id", "part_id", "chunk_id", F.col("pos").asc_nulls_last(), "copy_no"
    ).select(
        "capture_id",
        "part_id",
        F.col("ts_new_us").alias("ts_us"),
        F.col("orig_len").cast("long").alias("orig_len"),
        F.when(F.col("lost_at").isNull(), F.col("frame")).alias("frame"),
        F.col("linktype").cast("int").alias("linktype"),
        (F.col("error") if has_error else F.lit(None).cast("string")).alias("error"),
        *[column.alias(name) for name, column in counted.items()],
    )
    arrow_schema = pa.schema(
        [
            ("capture_id", pa.string()),
            ("part_id", pa.int64()),
            ("fragment", pa.string()),
            ("linktype", pa.int32()),
            ("bytes", pa.int64()),
            ("error", pa.string()),
            *[(name, pa.int64()) for name in names],
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda part: pa.RecordBatch.from_pylist([part.close(marked)], schema=arrow_schema)
        part = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for capture_id, part_id, piece in _runs(batch):
                key = (capture_id, part_id)
                if part is None or key != (part.row["capture_id"], part.row["part_id"]):
                    if part is not None:
                        yield done(part)
                    part = _Fragment(staging, capture_id, part_id, names, part_files or part_id == 0)
                part.add(piece, names)
        if part is not None:
            yield done(part)

    return rows.mapInArrow(write, ledger_schema(names))


def ledger_schema(counted: list[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("capture_id", T.StringType()),
            T.StructField("part_id", T.LongType()),
            T.StructField("fragment", T.StringType()),
            T.StructField("linktype", T.IntegerType()),
            T.StructField("bytes", T.LongType()),
            T.StructField("error", T.StringType()),
            *[T.StructField(name, T.LongType()) for name in counted],
        ]
    )


def finished_parts(spark: SparkSession, staging: str, counted: list[str]) -> DataFrame:
    """Ledger rows of the parts that an earlier, stopped run has finished in ``staging``, one each.

    A task that ran twice may have left a fragment more; either holds the same bytes. Fragments that are
    no longer there, and parts of captures with an error, are not among them.
    """
    schema = ledger_schema(counted)
    system, inner = resolve(staging)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    notes = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{FINISHED}").json(staging)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(staging)
    there = files.select(F.substring_index("path", "/", -1).alias("_name"))
    notes = notes.join(there, F.substring_index("fragment", "/", -1) == F.col("_name"), "left_semi")
    rows = notes.groupBy("capture_id", "part_id").agg(F.min(F.struct("fragment", *[c for c in schema.names if c not in ("capture_id", "part_id", "fragment")])).alias("_row"))
    rows = rows.select("capture_id", "part_id", "_row.*").select(*schema.names)
    failed = rows.filter("error is not null").select("capture_id").distinct()
    return rows.join(failed, "capture_id", "left_anti")


def _rename(system: fs.FileSystem, source: str, target: str) -> None:
    """Move into place; a source that is gone was moved by an earlier attempt."""
    system.create_dir(os.path.dirname(target), recursive=True)
    if system.get_file_info(source).type != fs.FileType.NotFound:
        system.move(source, target)
    elif system.get_file_info(target).type == fs.FileType.NotFound:
        raise FileNotFoundError(source)


def _copy_to(fragment: str, target: str, offset: int) -> None:
    """Write a fragment's bytes at ``offset`` of ``target``, which exists; repeating it changes nothing.

    The file system copies by itself where it can, some by sharing the blocks.
    """
    descriptor = os.open(target, os.O_WRONLY)
    try:
        with open(fragment, "rb") as source:
            at, size = 0, os.fstat(source.fileno()).st_size
            try:
                while at < size and (n := os.copy_file_range(source.fileno(), descriptor, size - at, at, offset + at)):
                    at += n
            except (AttributeError, OSError):  # another device, or a system that cannot
                pass
            source.seek(at)
            while data := source.read(COPY_BYTES):
                at += os.pwrite(descriptor, data, offset + at)
    finally:
        os.close(descriptor)


def for_each(df: DataFrame, action, tasks: int) -> None:
    """Run ``action(row)`` on the executors for every row of a ledger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                action(row)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    df.repartition(tasks).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def check_sink(out_root: str, part_files: bool) -> None:
    """Refuse, before anything is read, a form of output that the file system cannot take."""
    if not part_files and not re.match("/|file:", out_root):
        raise ValueError(
            f"{out_root} is no mounted file system, where parts could be written at an offset of one file; "
            "set part_files to get one finished capture file per part"
        )


def part_output(output: Column, part_id: Column) -> Column:
    """Name of a part's own file: capture.pcap gets capture.part-00000.pcap and so on."""
    number = F.lpad(part_id.cast("string"), 5, "0")
    long = F.when(F.length(part_id.cast("string")) > 5, part_id.cast("string")).otherwise(number)
    return F.concat(F.regexp_replace(output, r"\.pcap$", ""), F.lit(".part-"), long, F.lit(".pcap"))


def place_fragments(ledger: DataFrame, outputs: DataFrame, staging: str, part_files: bool = False) -> DataFrame:
    """Turn the fragments of error-free captures into their ``output`` files.

    With ``part_files`` each part is renamed to a capture file of its own (``part_output``), which any
    file system can do; otherwise the parts of a capture are joined, on a mounted file system.
    ``ledger`` must be a stored table: its rows name files. Returns one row per capture.
    """
    capture = Window.partitionBy("capture_id")
    earlier = capture.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    part = Window.partitionBy("capture_id", "part_id")
    sized = ledger.withColumns(
        {
            "offset": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)),
            "parts": F.count("*").over(capture),
            "size": F.sum("bytes").over(capture),
            "first": F.col("part_id") == F.min("part_id").over(capture),
            "failed": F.count("error").over(capture) > 0,
            "written": F.count("*").over(part),
        }
    ).join(outputs.select("capture_id", "output"), "capture_id")
    sized = settle(sized)
    state = sized.agg(
        F.max("written").alias("written"), F.count_if((F.col("parts") > 1) & ~F.col("failed")).alias("several")
    ).first()
    if (state.written or 0) > 1:
        raise RuntimeError("a part was written twice: the trace was not gathered by part")
    placed = sized.filter("not failed").select(
        "capture_id", "part_id", "fragment", "offset", "size", "first", "parts", "output"
    )
    tasks = placed.sparkSession.sparkContext.defaultParallelism

    def rename_single(row: dict) -> None:
        system, source = resolve(row["fragment"])
        _rename(system, source, resolve(row["output"])[1])

    if part_files:
        named = placed.withColumn("output", part_output(F.col("output"), F.col("part_id")))
        for_each(named, rename_single, tasks)
    else:
        for_each(placed.filter("parts = 1"), rename_single, tasks)
    if state.several and not part_files:
        check_sink(staging, False)
        target = F.concat(F.lit(staging + "/joined-"), F.md5("capture_id"))
        several = placed.filter("parts > 1").withColumn("target", target)
        for_each(several.filter("first"), _start_joined, tasks)
        for_each(several, _join_part, tasks)
        for_each(several.filter("first"), _finish_joined, tasks)
        for_each(several, _drop_fragment, tasks)
    return sized.groupBy("capture_id").agg(
        F.first("output").alias("output"),
        F.min("error").alias("error"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("parts"),
    )


def _start_joined(row: dict) -> None:
    """Create the file at its final size, whatever an earlier run has left under the name."""
    target = resolve(row["target"])[1]
    os.makedirs(os.path.dirname(target), exist_ok=True)
    descriptor = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        os.ftruncate(descriptor, row["size"])
    finally:
        os.close(descriptor)


def _join_part(row: dict) -> None:
    source, target = resolve(row["fragment"])[1], resolve(row["target"])[1]
    if os.path.exists(source):
        _copy_to(source, target, row["offset"])


def _finish_joined(row: dict) -> None:
    system, source = resolve(row["target"])
    _rename(system, source, resolve(row["output"])[1])


def _drop_fragment(row: dict) -> None:
    source = resolve(row["fragment"])[1]
    if os.path.exists(source):
        os.unlink(source)
