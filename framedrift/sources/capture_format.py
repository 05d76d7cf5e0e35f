"""``spark.read.format("pcap")`` and ``df.write.format("pcap")``, as a Python data source."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401 (binds pa.compute)
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from framedrift.sinks.captures import file_header, record_bytes
from framedrift.sources.discovery import ENCRYPTED_DIRECTORY, FILE_HEADER
from framedrift.sources.files import open_input, resolve
from framedrift.sources.packets import (
    PACKETS,
    READ_PROBLEMS,
    SPLIT_BYTES,
    failure,
    fetch,
    packet_batches,
    repairs,
    stepwise,
    whole_file,
)
from framedrift.sources.records import RESYNC, complete_end, read_file_header

FORMAT = "pcap"
PLANNED_RANGES = 200_000  # rows of an index that the planner looks at one by one
RANGES_PER_TASK = 16
FILES_PER_TASK = 1000
TEMPORARY = "_temporary"
WRITTEN_COLUMNS = ("capture_id", "ts_us", "frame")


@dataclass
class Files(InputPartition):
    """Whole captures: (path, capture_id, length)."""

    files: list[tuple[str, str, int]]


@dataclass
class Ranges(InputPartition):
    """Ranges of an index, as rows or as a slice of a row group of one of its files."""

    rows: list[dict] | None = None
    file: str = ""
    group: int = 0
    begin: int = 0
    end: int = 0


@dataclass
class Bounds:
    """What pushed filters leave of captures, packet numbers and times; both ends included."""

    captures: set[str] | None = None
    packet_no: tuple[int, int] = (0, 1 << 62)
    ts_us: tuple[int, int] = (-(1 << 62), 1 << 62)

    def narrow(self, filters: list[Filter]) -> None:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column == "capture_id" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.captures = wanted if self.captures is None else self.captures & wanted
            elif column in ("packet_no", "ts_us") and not isinstance(f, In):
                low, high = getattr(self, column)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                setattr(self, column, (low, high))

    def takes(self, capture_id: str) -> bool:
        return self.captures is None or capture_id in self.captures

    def meets(self, row: dict) -> bool:
        """Whether a row of an index can hold a wanted packet; one that failed stays for its error."""
        if not self.takes(row["capture_id"]):
            return False
        if row["error"]:
            return True
        first, n = row["first_packet_no"], row["packets"]
        inside = n and first <= self.packet_no[1] and first + n > self.packet_no[0]
        return bool(inside) and row["least_us"] <= self.ts_us[1] and row["most_us"] >= self.ts_us[0]


def captures_below(root: str) -> Iterator[tuple[str, str, int]]:
    """(path, capture_id, length) by the rules of ``discover``; a file is a capture whatever its name."""
    system, inner = resolve(root.rstrip("/"))
    prefix = root.rstrip("/")[: len(root.rstrip("/")) - len(inner)]
    if system.get_file_info(inner).type == fs.FileType.File:
        yield root, inner.rpartition("/")[2], system.get_file_info(inner).size
        return
    for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
        below = info.path[len(inner) :].lstrip("/")
        if info.type == fs.FileType.File and info.base_name.startswith("cap") and not re.search(ENCRYPTED_DIRECTORY, below):
            yield prefix + info.path, below, info.size


class CaptureReader(DataSourceReader):
    """Packets of captures; with an index, of the ranges that filters leave."""

    def __init__(self, options: dict):
        self.root = options.get("path")
        self.repair = repairs(options.get("mode", "STRICT").upper())
        self.mode = options.get("mode", "STRICT").upper()
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.with_frames = options.get("frames", "true").lower() != "false"
        self.index = options.get("index")
        self.bounds = Bounds()
        if not self.root and not self.index:
            raise ValueError("give a path to load, or an index")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the API's name)
        self.bounds.narrow(filters)
        # Ranges hold more packets than were asked for, so Spark applies every filter again.
        yield from filters

    def partitions(self) -> list[InputPartition]:
        return list(self._index_partitions() if self.index else self._file_partitions()) or [Files([])]

    def _file_partitions(self) -> Iterator[Files]:
        held, size = [], 0
        for path, capture_id, length in captures_below(self.root):
            if not self.bounds.takes(capture_id):
                continue
            held.append((path, capture_id, length))
            size += length
            if size >= self.split_bytes or len(held) >= FILES_PER_TASK:
                yield Files(held)
                held, size = [], 0
        if held:
            yield Files(held)

    def _index_partitions(self) -> Iterator[Ranges]:
        system, inner = resolve(self.index.rstrip("/"))
        versions = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.startswith("version=")]
        if not versions:
            raise FileNotFoundError(f"no index in {self.index}")
        newest = max(versions, key=lambda i: int(i.base_name.partition("=")[2]))
        found = [i.path for i in system.get_file_info(fs.FileSelector(newest.path)) if i.base_name.endswith(".parquet")]
        sizes = [(p, pq.ParquetFile(system.open_input_file(p)).metadata) for p in sorted(found)]
        if sum(m.num_rows for _, m in sizes) > PLANNED_RANGES:
            for path, meta in sizes:
                for group in range(meta.num_row_groups):
                    for begin in range(0, meta.row_group(group).num_rows, RANGES_PER_TASK):
                        yield Ranges(file=path, group=group, begin=begin, end=begin + RANGES_PER_TASK)
            return
        held, size = [], 0
        for path, _ in sizes:
            for row in pq.read_table(path, filesystem=system).to_pylist():
                if self._wanted(row):
                    held.append(row)
                    size += (row["stop"] or 0) - (row["start"] or 0)
                    if size >= self.split_bytes:
                        yield Ranges(rows=held)
                        held, size = [], 0
        if held:
            yield Ranges(rows=held)

    def _wanted(self, row: dict) -> bool:
        return row["mode"] == self.mode and self.bounds.meets(row)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Files):
            for path, capture_id, length in partition.files:
                yield from whole_file(path, capture_id, length, self.repair, self.split_bytes, self.with_frames)
            return
        rows = partition.rows
        if rows is None:
            system, _ = resolve(self.index)
            group = pq.ParquetFile(system.open_input_file(partition.file)).read_row_group(partition.group)
            rows = filter(self._wanted, group.slice(partition.begin, partition.end - partition.begin).to_pylist())
        for row in rows:
            if row["error"]:
                yield failure(row["capture_id"], row["error"])
                continue
            try:
                until = max(row["stop"], row["until"]) if self.repair else row["stop"]
                yield from packet_batches(row, fetch(row["path"], row["start"], until), self.repair, self.with_frames)
            except READ_PROBLEMS as problem:
                yield failure(row["capture_id"], problem)


@dataclass
class Written(WriterCommitMessage):
    """Finished files of a task: (below the temporary folder, below the target)."""

    files: list[tuple[str, str]]


class CaptureWriter(DataSourceArrowWriter):
    """Each task writes a capture file per run of rows of one capture; files appear when the job commits.

    Rows are written in the order they come in. ``repartition`` by capture first, or by capture and a part
    of it, and sort within partitions. ``path/capture_id.part-<id>.pcap`` is the name, as a capture may
    come from several tasks.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        missing = [c for c in WRITTEN_COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"columns {missing} are needed to write captures")
        self.root = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex
        self.staging = f"{self.root}/{TEMPORARY}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt = uuid.uuid4().hex
        system, folder = resolve(f"{self.staging}/{attempt}")
        system.create_dir(folder, recursive=True)
        files, out, current = [], None, None
        try:
            for batch in iterator:
                ids = batch.column("capture_id").to_pylist()
                begin = 0
                while begin < len(ids):
                    end = begin + 1
                    while end < len(ids) and ids[end] == ids[begin]:
                        end += 1
                    rows = batch.slice(begin, end - begin)
                    if out is None or ids[begin] != current:
                        if out is not None:
                            out.close()
                        current = ids[begin]
                        name = f"{attempt}/{len(files)}"
                        files.append((name, f"{current}.part-{attempt[:12]}-{len(files)}.pcap"))
                        out = system.open_output_stream(f"{folder}/{len(files) - 1}")
                        links = rows.column("linktype").drop_null() if "linktype" in rows.schema.names else []
                        out.write(file_header(links[0].as_py() if len(links) else 1))
                    out.write(record_bytes(_writable(rows)))
                    begin = end
        except BaseException:
            if out is not None:
                out.close()
            system.delete_dir(folder)
            raise
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = resolve(self.root)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not info.base_name.startswith(TEMPORARY):
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        for message in messages:
            for name, target in message.files if message else []:
                system.create_dir(f"{root}/{target}".rpartition("/")[0], recursive=True)
                system.move(f"{root}/{TEMPORARY}-{self.job}/{name}", f"{root}/{target}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = resolve(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


def _writable(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with a frame, in the columns that records are made of; lengths default to the frame's."""
    rows = rows.filter(rows.column("frame").is_valid())
    frames = rows.column("frame")
    sizes = pa.compute.cast(pa.compute.binary_length(frames), pa.int64())
    originals = pa.compute.coalesce(rows.column("orig_len").cast(pa.int64()), sizes) if "orig_len" in rows.schema.names else sizes
    return pa.RecordBatch.from_arrays([frames, originals, rows.column("ts_us").cast(pa.int64())], ["frame", "orig_len", "ts_us"])


@dataclass
class Growth(InputPartition):
    """What a file has gained: bytes from ``begin`` to ``end``; ``begin`` is where an earlier batch stopped to read."""

    path: str
    capture_id: str
    begin: int
    end: int


class GrowingReader(DataSourceStreamReader):
    """Packets of captures that grow while they are read. An offset has for each file how many bytes were seen.

    Those need not end with a record. Where the last whole one ended, and how many packets came before, is
    noted in the ``state`` folder for each file and offset, by the task that found it; the next batch goes
    on there. A repeated batch finds and notes the same. A record that is cut at the end is left for later.
    Files must only grow; one that got shorter is left alone until it is longer than it was.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.mode = options.get("mode", "STRICT").upper()
        self.repair = repairs(self.mode)
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.most = int(options.get("maxbytespertrigger", 1 << 62))
        if self.mode == RESYNC:
            raise ValueError("what follows damage in a growing capture is not known yet: RESYNC is for whole ones")
        if "state" not in options:
            raise ValueError("a stream of captures needs the option state, a folder that all executors share")
        self.state = options["state"].rstrip("/")
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Sizes now; at most ``maxBytesPerTrigger`` bytes of each file more than last time."""
        for path, capture_id, length in captures_below(self.root):
            known = self.seen.get(capture_id, 0)
            if length > known:
                self.seen[capture_id] = min(length, known + self.most)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the stream tells where it is.
        self.seen = end | {k: max(v, end.get(k, 0)) for k, v in self.seen.items()}
        root = self.root.rstrip("/")
        return [Growth(f"{root}/{name}", name, start.get(name, 0), size) for name, size in sorted(end.items()) if size > start.get(name, 0)]

    def _note(self, capture_id: str, size: int) -> str:
        return f"{self.state}/{hashlib.md5(capture_id.encode()).hexdigest()}-{size}.json"

    def _whole_end(self, part: Growth, at: int, capture: dict) -> int:
        """Where the last whole record before the end of the partition ends, looking at a step at a time."""
        size = self.split_bytes
        while at < part.end:
            window = fetch(part.path, at, min(at + size, part.end))
            stop, order = complete_end(window, capture, at, bool(self.repair))
            if stop > at:
                at, size, capture = stop, self.split_bytes, capture | {"big_endian": order == ">"}
            elif at + size >= part.end:
                break
            else:
                size *= 2  # a record longer than the step
        return at

    def read(self, partition: Growth) -> Iterator[pa.RecordBatch]:
        part = partition
        row = {"start": 0, "first_packet_no": 0, "interfaces": [], "failed": False}
        if part.begin:
            system, note = resolve(self._note(part.capture_id, part.begin))
            with system.open_input_stream(note) as source:
                row = json.loads(source.read())
        try:
            with open_input(part.path) as source:
                header = read_file_header(source.read(FILE_HEADER))
            ready = part.end >= FILE_HEADER and not row["failed"]
            if ready and header["kind"] == "unknown":
                raise ValueError("unknown capture format")
            if ready:
                row |= header | {"capture_id": part.capture_id, "path": part.path, "split_bytes": self.split_bytes}
                row["start"] = max(row["start"], 0 if header["kind"] == "pcapng" else FILE_HEADER)
                stop = self._whole_end(part, row["start"], header | {"big_endian": _order_of(row["interfaces"], header["big_endian"])})
                row |= {"stop": stop, "length": stop}
                yield from stepwise(row, self.repair)
                row["start"] = stop
        except READ_PROBLEMS as problem:
            row["failed"] = True
            yield failure(part.capture_id, problem)
        kept = {k: row[k] for k in ("start", "first_packet_no", "interfaces", "failed")}
        system, note = resolve(self._note(part.capture_id, part.end))
        system.create_dir(note.rpartition("/")[0], recursive=True)
        aside = f"{note}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps(kept).encode())
        system.move(aside, note)


def _order_of(interfaces: list[str], big_endian: bool) -> bool:
    """Byte order of the last section among what a walk has passed."""
    for delta in reversed(interfaces):
        if "order" in (found := json.loads(delta)):
            return found["order"] == ">"
    return big_endian


class CaptureSource(DataSource):
    """Captures as a format of Spark.

    Reading: ``path`` (a directory as ``discover`` takes it, or one file), ``mode`` (STRICT, REPAIR or RESYNC),
    ``splitBytes``, ``frames`` (false leaves them out), ``index`` (a folder of ``write_index``). Without an
    index a capture is read by one task, ``splitBytes`` in memory at a time; with one, by ranges, and only
    by those that filters on capture_id, packet_no and ts_us leave. As a stream: see ``GrowingReader``.
    Writing: see ``CaptureWriter``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return PACKETS

    def reader(self, schema: T.StructType) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(dict(self.options), schema, overwrite)


def register_format(spark: SparkSession) -> None:
    """Make ``format("pcap")`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
