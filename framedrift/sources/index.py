"""A stored index of captures: which bytes hold which packets and times, so that a part is read without walking the rest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framedrift.sources import discovery
from framedrift.sources.files import settle
from framedrift.sources.packets import (
    HEADER_COLUMNS,
    READ_PROBLEMS,
    capture_ranges,
    fetch,
    read_ranges,
    repairs,
    scan_tasks,
    spread,
)
from framedrift.sources.records import Walk

INDEX_BYTES = 4 << 20
FACTS = "packets long, least_us long, most_us long"


def _with_facts(ranges: DataFrame, mode: str) -> DataFrame:
    """Ranges with the number of their packets and the bounds of their times; a range that fails says so in ``error``."""
    repair = repairs(mode)
    kept = ranges.schema.names
    schema = pa.schema([("packets", pa.int64()), ("least_us", pa.int64()), ("most_us", pa.int64()), ("problem", pa.string())])

    def facts(row: dict) -> dict:
        if row["error"]:
            return {"packets": 0, "problem": row["error"]}
        try:
            data = fetch(row["path"], row["start"], max(row["stop"], row["until"]))
            walk = Walk(row, repair, row["start"], row["interfaces"])
            n, least, most = 0, None, None
            for moment, *_, note in walk.packets(data, row["stop"]):
                if note != "discarded":
                    n += 1
                    least = moment if least is None else min(least, moment)
                    most = moment if most is None else max(most, moment)
            return {"packets": n, "least_us": least, "most_us": most}
        except READ_PROBLEMS as problem:
            return {"packets": 0, "problem": f"{type(problem).__name__}: {problem}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = pa.RecordBatch.from_pylist([facts(row.to_pylist()[0])], schema=schema)
                yield pa.RecordBatch.from_arrays([*row.columns, *found.columns], names=[*kept, *schema.names])

    found = ranges.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ranges.schema.fields)}, {FACTS}, problem string")
    return found.withColumn("error", F.col("problem")).drop("problem")


def index_captures(captures: DataFrame, mode: str = "STRICT", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per range of about ``index_bytes`` of the ``captures`` (see ``discover``): offsets, first packet, times.

    The row has all that reading its range needs: format, byte order, and the interfaces of earlier blocks.
    """
    facts = ["capture_id", "length", "modification_time"]
    headed = settle(discovery.read_headers(captures))
    ranges = settle(capture_ranges(headed, mode, index_bytes))
    indexed = _with_facts(spread(ranges, ranges.count(), index_bytes), mode)
    # A file that cannot be read at all has a row that says so.
    unread = headed.filter("error is not null").select("capture_id", "path", *HEADER_COLUMNS, "error")
    indexed = indexed.drop("length").unionByName(unread.withColumn("packets", F.lit(0).cast("long")), allowMissingColumns=True)
    return indexed.join(headed.select(*facts), "capture_id").withColumn("mode", F.lit(mode))


def write_index(captures: DataFrame, folder: str, mode: str = "STRICT", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Bring the index in ``folder`` up to ``captures``: only new and changed files are walked; returns the whole index.

    A file counts as changed if its length or modification time differ, or if it was indexed in the
    other mode. Versions are folders of their own, so readers of an older one go on undisturbed.
    """
    spark = captures.sparkSession
    captures = settle(captures)
    old = _latest(spark, folder)
    key = ["capture_id", "length", "modification_time"]
    if old is None:
        whole = index_captures(captures, mode, index_bytes)
    else:
        sound = old.filter(F.col("mode") == mode)
        kept = sound.join(captures.select(*key), key, "left_semi")
        new = captures.join(sound.select(*key).distinct(), key, "left_anti")
        whole = kept.select(*old.columns).unionByName(index_captures(new, mode, index_bytes))
    versions = _versions(spark, folder)
    target = f"{folder.rstrip('/')}/version={(versions[-1] + 1) if versions else 0}"
    # Written aside first: a version is complete once it has its name.
    aside = f"{folder.rstrip('/')}/_new-{uuid.uuid4().hex}"
    whole.write.parquet(aside)
    discovery.move_folder(aside, target)
    return spark.read.parquet(target)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    names = discovery.folder_names(folder)
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def _latest(spark: SparkSession, folder: str) -> DataFrame | None:
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder.rstrip('/')}/version={versions[-1]}") if versions else None


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a stored index."""
    found = _latest(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no index in {folder}")
    return found


def wanted_ranges(
    index: DataFrame, packets: tuple[int, int] | None = None, times: tuple[int, int] | None = None, captures: list[str] | None = None
) -> DataFrame:
    """Rows of the index whose range can hold a wanted packet; bounds include the first and exclude the last.

    Ranges that failed stay, so that their error is not lost.
    """
    df = index
    if captures is not None:
        df = df.filter(F.col("capture_id").isin(captures))
    inside = F.lit(True)
    if packets is not None:
        inside = inside & (F.col("first_packet_no") < packets[1]) & (F.col("first_packet_no") + F.col("packets") > packets[0])
    if times is not None:
        inside = inside & (F.col("least_us") < times[1]) & (F.col("most_us") >= times[0])
    return df.filter(F.col("error").isNotNull() | inside)


def read_indexed(
    index: DataFrame, packets: tuple[int, int] | None = None, times: tuple[int, int] | None = None,
    captures: list[str] | None = None, with_frames: bool = True,
) -> DataFrame:
    """Packets by number, time or capture, as ``read_packets`` gives them, from the ranges that hold them and no others.

    ``packets`` and ``times`` (microseconds) are half-open. An index in which both modes meet is read by each in turn.
    """
    found = wanted_ranges(index, packets, times, captures)
    parts = []
    for mode in [row["mode"] for row in index.select("mode").distinct().orderBy("mode").collect()]:
        ranges = found.filter(F.col("mode") == mode).select(
            "capture_id", "path", "length", *HEADER_COLUMNS, "start", "stop", "until", "first_packet_no", "interfaces", "error"
        )
        # Indexes may differ in the size of their ranges, so it is taken from the rows.
        held = ranges.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
        parts.append(read_ranges(ranges.repartition(scan_tasks(index.sparkSession, held[0], held[1] or 0)), mode, with_frames))
    if not parts:
        return read_ranges(
            index.select("capture_id", "path", "length", *HEADER_COLUMNS, "start", "stop", "until", "first_packet_no", "interfaces", "error"), with_frames=with_frames
        )
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    wanted = F.lit(True)
    if packets is not None:
        wanted = wanted & (F.col("packet_no") >= packets[0]) & (F.col("packet_no") < packets[1])
    if times is not None:
        wanted = wanted & (F.col("ts_us") >= times[0]) & (F.col("ts_us") < times[1])
    return df.filter(F.col("error").isNotNull() | wanted)
