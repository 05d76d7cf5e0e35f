"""Captures to packets.

A capture up to ``split_bytes`` is one range. A larger one is cut at multiples of
``split_bytes``; every cut proposes where its first record begins, all ranges are walked
in parallel, and a range counts once it begins exactly where the one before it ends. By
induction from the file header the ranges then hold each record once, and running sums of
their counts number the packets. No task ever reads more than one range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framedrift.sources.discovery import FILE_HEADER, decode_header
from framedrift.sources.files import open_input, settle
from framedrift.sources.records import GUESS_WINDOW, RESYNC, Walk, guess_start, read_file_header

SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4096
LEAST_PROGRESS = 0.9
MODES = ("STRICT", "REPAIR", RESYNC)
READ_PROBLEMS = (OSError, ValueError, IndexError, ArithmeticError, struct.error)

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_no", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("incl_len", T.IntegerType()),
        T.StructField("orig_len", T.LongType()),
        T.StructField("frame", T.BinaryType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("repaired", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
ARROW_PACKETS = pa.schema(
    [
        ("capture_id", pa.string()),
        ("packet_no", pa.int64()),
        ("ts_us", pa.int64()),
        ("incl_len", pa.int32()),
        ("orig_len", pa.int64()),
        ("frame", pa.binary()),
        ("linktype", pa.int32()),
        ("repaired", pa.string()),
        ("error", pa.string()),
    ]
)
HEADER_COLUMNS = ["kind", "big_endian", "nanos", "snaplen", "linktype"]
WALKED = "capture_id string, split_no long, start long, stop long, until long, n long, delta string, error string"
SCAN_TASKS = 100_000
TASKS_PER_CORE = 4


def repairs(mode: str) -> bool | str:
    """How records are repaired in ``mode``: not at all, by capping lengths, or (RESYNC) by finding the next sound records."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return RESYNC if mode == RESYNC else mode == "REPAIR"


def failure(capture_id: str, problem: Exception | str) -> pa.RecordBatch:
    """The one row of a capture that cannot be read."""
    said = problem if isinstance(problem, str) else f"{type(problem).__name__}: {problem}"
    row = {"capture_id": capture_id, "error": said}
    return pa.RecordBatch.from_pylist([row], schema=ARROW_PACKETS)


def packet_batches(
    row: dict, data: bytes, repair: bool | str, with_frames: bool
) -> Iterator[pa.RecordBatch]:
    """Packets of one range as Arrow batches."""
    walk = Walk(row, repair, row["start"], row.get("interfaces"))
    number = row["first_packet_no"]
    packets = walk.packets(data, row["stop"])
    while True:
        rows = [packet for _, packet in zip(range(BATCH_ROWS), packets)]
        if not rows:
            return
        times, begins, sizes, originals, links, notes = zip(*rows)
        kept = np.array([note != "discarded" for note in notes])
        numbers = number + np.cumsum(kept) - kept
        number += int(kept.sum())
        if with_frames:
            frames = [
                data[begin : begin + size] if keep else None
                for begin, size, keep in zip(begins, sizes, kept.tolist())
            ]
        else:
            frames = [None] * len(rows)
        columns = [
            pa.array([row["capture_id"]] * len(rows), pa.string()),
            pa.array(numbers, pa.int64()),
            pa.array(times, pa.int64()),
            pa.array(sizes, pa.int32()),
            pa.array(originals, pa.int64()),
            pa.array(frames, pa.binary()),
            pa.array(links, pa.int32()),
            pa.array(notes, pa.string()),
            pa.nulls(len(rows), pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW_PACKETS)


def fetch(path: str, start: int, stop: int) -> bytes:
    """Bytes of a file from ``start`` up to ``stop``."""
    with open_input(path) as source:
        source.seek(start)
        return source.read(stop - start)


def _walk_split(row: dict, repair: bool | str) -> dict:
    """Start, end and packet count of one range; nothing but the name if no start is found.

    A range that cannot be walked counts as not found: its proposed start may be wrong, and if it
    is not, walking it again in order says why.
    """
    try:
        return _walk_found(row, repair)
    except READ_PROBLEMS:
        return {"capture_id": row["capture_id"], "split_no": row["split_no"]}


def _walk_found(row: dict, repair: bool | str) -> dict:
    cut, limit = row["cut"], min(row["cut"] + row["split_bytes"], row["length"])
    result = {"capture_id": row["capture_id"], "split_no": row["split_no"]}
    start = row["start"]
    if start is None:
        window = fetch(row["path"], cut, min(cut + 2 * GUESS_WINDOW, row["length"]))
        found = guess_start(window, row)
        if found is None:
            return result
        start = cut + found
    walk = Walk(row, repair, start)
    count = 0
    if start < limit:
        data = fetch(row["path"], start, min(limit + GUESS_WINDOW, row["length"]))
        count = sum(packet[5] != "discarded" for packet in walk.packets(data, limit))
    until = min(limit + GUESS_WINDOW, row["length"])
    return result | {"start": start, "stop": walk.at, "until": until, "n": count, "delta": walk.delta()}


def _walk_whole(row: dict, repair: bool | str) -> Iterator[dict]:
    """The ranges of a capture in order: exact whatever the file holds.

    A range in ``known`` that begins where the walk has come is kept and not read again. What ends
    the walk becomes a row with ``error``.
    """
    walk = Walk(row, repair, row["start"])
    known = {k["split_no"]: k for k in row["known"] if k["start"] is not None and k["stop"] is not None}
    try:
        for number, cut in enumerate(range(0, row["length"], row["split_bytes"])):
            kept = known.get(number)
            if kept and kept["start"] == walk.at:
                walk.pass_over(kept["stop"], kept["delta"])
                continue
            start, limit, count = walk.at, min(cut + row["split_bytes"], row["length"]), 0
            walk.found = {}
            if start < limit:
                data = fetch(row["path"], start, min(limit + GUESS_WINDOW, row["length"]))
                count = sum(packet[5] != "discarded" for packet in walk.packets(data, limit))
            yield {
                "capture_id": row["capture_id"],
                "split_no": number,
                "start": start,
                "stop": walk.at,
                "until": min(limit + GUESS_WINDOW, row["length"]),
                "n": count,
                "delta": walk.delta(),
            }
    except READ_PROBLEMS as problem:
        yield {"capture_id": row["capture_id"], "split_no": -1, "error": f"{type(problem).__name__}: {problem}"}


def stepwise(row: dict, repair: bool | str, with_frames: bool = True) -> Iterator[pa.RecordBatch]:
    """Packets of a capture from ``start`` on to ``stop``, a step of ``split_bytes`` in memory at a time.

    What is left at the end, if a record is not complete there, can be seen in the row, which goes along:
    ``start``, ``first_packet_no`` and ``interfaces`` are where a later call would go on.
    """
    while row["start"] < row["stop"]:
        start, limit = row["start"], min(row["start"] + row["split_bytes"], row["stop"])
        walk = Walk(row, repair, start, row["interfaces"])
        data = fetch(row["path"], start, min(limit + GUESS_WINDOW, row["length"]))
        count = sum(packet[5] != "discarded" for packet in walk.packets(data, limit))
        if walk.at == start:
            return
        # Once more over the same bytes, or more of them, as the last record may be longer than what was looked at.
        data = data if walk.at - start <= len(data) else fetch(row["path"], start, walk.at)
        yield from packet_batches(row | {"stop": walk.at}, data, repair, with_frames)
        row["start"], row["first_packet_no"] = walk.at, row["first_packet_no"] + count
        if walk.delta():
            row["interfaces"] = [*row["interfaces"], walk.delta()]


def _walked(splits: DataFrame, repair: bool | str, whole: bool = False) -> DataFrame:
    schema = pa.schema(
        [
            ("capture_id", pa.string()),
            ("split_no", pa.int64()),
            ("start", pa.int64()),
            ("stop", pa.int64()),
            ("until", pa.int64()),
            ("n", pa.int64()),
            ("delta", pa.string()),
            ("error", pa.string()),
        ]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not whole:
                yield pa.RecordBatch.from_pylist([_walk_split(row, repair) for row in rows], schema=schema)
                continue
            for row in rows:
                yield pa.RecordBatch.from_pylist(list(_walk_whole(row, repair)), schema=schema)

    return splits.mapInArrow(walk, WALKED)


def scan_tasks(spark: SparkSession, ranges: int, size: int) -> int:
    """Tasks for ``ranges`` of ``size`` bytes in all: one for each SPLIT_BYTES, and a few per core if there are as many ranges.

    Small ranges share a task, as every task of a shuffle costs something for each task before it.
    """
    few = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return max(1, min(max(-(-size // SPLIT_BYTES), few), ranges, SCAN_TASKS))


def spread(df: DataFrame, rows: int, split_bytes: int) -> DataFrame:
    """Rows that are whole ranges of up to ``split_bytes``, dealt to ``scan_tasks``; a task reads one at a time."""
    return df.repartition(scan_tasks(df.sparkSession, rows, rows * split_bytes))


def _index_large(large: DataFrame, split_bytes: int, repair: bool | str) -> DataFrame:
    """Walk all ranges of large captures in parallel and settle their borders."""
    ids = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / split_bytes))
    splits = large.withColumn("split_no", F.explode(ids)).withColumns(
        {"cut": F.col("split_no") * split_bytes, "split_bytes": F.lit(split_bytes)}
    )
    first = F.when(F.col("kind") == "pcapng", 0).otherwise(FILE_HEADER).cast("long")
    splits = splits.withColumn("start", F.when(F.col("split_no") == 0, first))
    splits = settle(splits)
    walks = settle(_walked(spread(splits, splits.count(), split_bytes), repair))

    in_order = Window.partitionBy("capture_id").orderBy("split_no")
    before = F.lag("stop").over(in_order)
    # A range without a start is loose as well, even if the one before it has no end to compare with.
    unsettled = "start is null or (split_no > 0 and not (start <=> _before))"
    left = None
    while True:
        checked = walks.withColumn("_before", before)
        loose = settle(checked.filter(unsettled).select("capture_id", "split_no", F.col("_before").alias("start")))
        count = loose.count()
        if count == 0:
            return walks
        known = loose.filter("start is not null")
        # In parallel as long as a good part of the borders settles in each round.
        if known.isEmpty() or (left is not None and count > LEAST_PROGRESS * left):
            break
        left = count
        again = splits.drop("start").join(known, ["capture_id", "split_no"])
        fixed = _walked(spread(again, count, split_bytes), repair)
        kept = walks.join(known, ["capture_id", "split_no"], "left_anti")
        walks = settle(kept.unionByName(fixed))

    # What is still loose is walked in order; ranges found before are kept where they fit.
    checked = walks.withColumn("_before", before)
    loose = checked.filter(unsettled).select("capture_id").distinct()
    found = F.collect_list(F.struct("split_no", "start", "stop", "delta")).alias("known")
    known = walks.join(loose, "capture_id", "left_semi").groupBy("capture_id").agg(found)
    broken = splits.filter("split_no = 0").join(known, "capture_id")
    # One capture a task as far as the cluster goes: they may be of any size.
    fixed = settle(_walked(spread(broken, loose.count(), SPLIT_BYTES), repair, whole=True))
    kept = walks.join(fixed.select("capture_id", "split_no"), ["capture_id", "split_no"], "left_anti")
    return settle(kept.unionByName(fixed))


def capture_ranges(
    captures: DataFrame, mode: str = "STRICT", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Byte ranges of readable captures: whole records each, with the number of the first."""
    repair = repairs(mode)
    columns = ["capture_id", "path", "length", *HEADER_COLUMNS]
    readable = captures.filter("error is null and linktype is not null").select(*columns)
    first = F.when(F.col("kind") == "pcapng", 0).otherwise(FILE_HEADER).cast("long")
    small = readable.filter(F.col("length") <= split_bytes).withColumns(
        {
            "start": first,
            "stop": F.col("length"),
            "until": F.col("length"),
            "first_packet_no": F.lit(0).cast("long"),
            "interfaces": F.array().cast("array<string>"),
            "error": F.lit(None).cast("string"),
        }
    )
    large = readable.filter(F.col("length") > split_bytes)
    if large.isEmpty():
        return small
    walks = _index_large(large, split_bytes, repair)
    failed = walks.filter("error is not null").select("capture_id", "error")
    walks = walks.drop("error").join(failed, "capture_id", "left_anti")
    earlier = Window.partitionBy("capture_id").orderBy("split_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = walks.withColumns(
        {
            "first_packet_no": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "interfaces": F.coalesce(
                F.collect_list("delta").over(earlier), F.array().cast("array<string>")
            ),
        }
    ).filter("start < stop")
    ranges = large.join(numbered.drop("n", "delta", "split_no"), "capture_id")
    ranges = ranges.withColumn("error", F.lit(None).cast("string"))
    # A capture that cannot be walked is one empty range that says so.
    zero = F.lit(0).cast("long")
    nothing = {"start": zero, "stop": zero, "until": zero, "first_packet_no": zero, "interfaces": F.array().cast("array<string>")}
    unwalked = large.join(failed, "capture_id").withColumns(nothing)
    return small.unionByName(ranges).unionByName(unwalked)


def read_ranges(
    ranges: DataFrame, mode: str = "STRICT", with_frames: bool = True
) -> DataFrame:
    """Packets of byte ranges. A file that fails gives one row with ``error``."""
    repair = repairs(mode)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"]:
                    yield failure(row["capture_id"], row["error"])
                    continue
                try:
                    # Where damage is passed over, by the same bytes as when the range was found.
                    until = max(row["stop"], row["until"]) if repair else row["stop"]
                    data = fetch(row["path"], row["start"], until)
                    yield from packet_batches(row, data, repair, with_frames)
                except READ_PROBLEMS as problem:
                    yield failure(row["capture_id"], problem)

    return ranges.mapInArrow(read, PACKETS)


def read_packets(
    captures: DataFrame,
    mode: str = "STRICT",
    split_bytes: int = SPLIT_BYTES,
    with_frames: bool = True,
) -> DataFrame:
    """Packets of captures that went through ``read_headers``.

    The scan gets a task for each SPLIT_BYTES, and a few per core if there are as many ranges; small
    captures and small ranges share a task.
    """
    ranges = settle(capture_ranges(captures, mode, split_bytes))
    size = ranges.agg(F.sum(F.col("stop") - F.col("start")), F.count("*")).first()
    tasks = scan_tasks(captures.sparkSession, size[1] or 1, size[0] or 0)
    return read_ranges(ranges.repartition(tasks), mode, with_frames)


def read_files(files: DataFrame, mode: str = "STRICT", split_bytes: int = SPLIT_BYTES, with_frames: bool = True) -> DataFrame:
    """Packets of whole files (capture_id, path, length), each read by one task, ``split_bytes`` in memory at a time.

    Row by row, so it works on streaming DataFrames; files may have any size.
    """
    repair = repairs(mode)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from whole_file(row["path"], row["capture_id"], row["length"], repair, split_bytes, with_frames)

    return files.select("capture_id", "path", "length").mapInArrow(read, PACKETS)


def whole_file(path: str, capture_id: str, length: int, repair: bool | str, split_bytes: int, with_frames: bool = True) -> Iterator[pa.RecordBatch]:
    """Packets of a file from its header on, or its error."""
    try:
        with open_input(path) as source:
            header = read_file_header(source.read(FILE_HEADER))
        if header["kind"] == "unknown":
            raise ValueError("unknown capture format")
        if header["linktype"] is None:
            return
        row = {"capture_id": capture_id, "path": path, "length": length, "stop": length, "split_bytes": split_bytes} | header
        row |= {"start": 0 if header["kind"] == "pcapng" else FILE_HEADER, "first_packet_no": 0, "interfaces": []}
        yield from stepwise(row, repair, with_frames)
    except READ_PROBLEMS as problem:
        yield failure(capture_id, problem)


def read_content(files: DataFrame, mode: str = "STRICT", with_frames: bool = True) -> DataFrame:
    """Packets of captures whose bytes are in the column ``content``.

    For file systems only Spark can open; one file is one row here, so it must be below 2 GB (``read_files``
    takes files of any size). Works on streaming DataFrames.
    """
    repair = repairs(mode)
    df = files.withColumn("head", F.substring("content", 1, FILE_HEADER))
    df = decode_header(df.withColumn("length", F.length("content").cast("long")))
    df = df.select("capture_id", "content", "length", *HEADER_COLUMNS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                try:
                    if row["kind"] == "unknown":
                        raise ValueError("unknown capture format")
                    if row["linktype"] is None:
                        continue
                    start = 0 if row["kind"] == "pcapng" else FILE_HEADER
                    row |= {"start": start, "stop": row["length"], "first_packet_no": 0}
                    data = row["content"][start:]
                    yield from packet_batches(row, data, repair, with_frames)
                except READ_PROBLEMS as problem:
                    yield failure(row["capture_id"], problem)

    return df.mapInArrow(read, PACKETS)
