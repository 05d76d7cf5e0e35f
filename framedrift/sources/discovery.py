"""Which captures a directory holds, what their headers say, where their output goes."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framedrift.functions.octets import hex_uint, hex_uint_le
from framedrift.sources.files import open_input, resolve

# Capture name prefix, excluded directories, formats and limits.
CAPTURE_GLOB = "cap*"
ENCRYPTED_DIRECTORY = "(?i)(^|/)encrypted[^/]*/"
MAGIC_LE_MICROS = "D4C3B2A1"
MAGIC_BE_MICROS = "A1B2C3D4"
MAGIC_LE_NANOS = "4D3CB2A1"
MAGIC_BE_NANOS = "A1B23C4D"
MAGIC_PCAPNG = "0A0D0D0A"
MAGIC_PCAPNG_BE = "1A2B3C4D"
FILE_HEADER = 24
LISTING_TASKS = 1000
MAX_SNAPLEN = 262_144
DEFAULT_LINKTYPE = 1

HEAD_FIELDS = [T.StructField("head", T.BinaryType()), T.StructField("error", T.StringType())]


def relative_to(path: Column, root: str) -> Column:
    """``path`` below ``root``, whatever scheme and authority either is written with."""
    inner = urlparse(root).path.rstrip("/") + "/"
    local = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substr(local, F.instr(local, inner) + len(inner))


def outside_encrypted(capture_id: Column) -> Column:
    """False below a directory whose name begins with ``encrypted``; the root is not looked at."""
    return ~capture_id.rlike(ENCRYPTED_DIRECTORY)


def with_names(files: DataFrame) -> DataFrame:
    """Add ``date_dir`` (first path part) and ``base_name`` (last one)."""
    return files.withColumns(
        {
            "date_dir": F.substring_index("capture_id", "/", 1),
            "base_name": F.substring_index("capture_id", "/", -1),
        }
    )


def first_captures(captures: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` captures by path; none or 0 means all."""
    return captures.orderBy("capture_id").limit(limit) if limit else captures


def discover(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Captures below ``root``: a listing, no file is opened.

    ``capture_id`` is the path relative to the root, so results do not depend on where
    the directory lies.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", CAPTURE_GLOB)
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modification_time"))
    )
    # The reader plans tasks by the size of the files, of which only names are read here.
    return captures_from_listing(files.coalesce(LISTING_TASKS), root, limit)


def single_capture(spark: SparkSession, path: str) -> DataFrame:
    """One file as a capture, whatever its name; its id is the name."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select("path", "length", F.col("modificationTime").alias("modification_time"))
    return with_names(files.withColumn("capture_id", F.substring_index("path", "/", -1)))


def captures_from_listing(files: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """The discovery rules on any listing with ``path``."""
    captures = files.withColumn("capture_id", relative_to(F.col("path"), root))
    captures = captures.filter(outside_encrypted(F.col("capture_id")))
    captures = captures.filter(F.substring_index("capture_id", "/", -1).startswith("cap"))
    return first_captures(with_names(captures), limit)


def with_output(captures: DataFrame, out_root: str, layout: str = "mirror") -> DataFrame:
    """Add ``output``: the relative directory and ``.pcap`` (``mirror``), or only its first part.

    ``layout='date'`` can send two captures to one path; see :func:`output_clashes`.
    """
    out_root = out_root.rstrip("/")
    if layout == "mirror":
        below = F.col("capture_id")
    elif layout == "date":
        below = F.concat_ws("/", "date_dir", "base_name")
    else:
        raise ValueError(f"layout must be 'mirror' or 'date', not {layout!r}")
    return captures.withColumns(
        {
            "output": F.concat(F.lit(out_root + "/"), below, F.lit(".pcap")),
            "metadata_path": F.concat(F.lit(out_root + "/"), below, F.lit(".metadata.json")),
        }
    )


def output_clashes(captures: DataFrame) -> DataFrame:
    """Outputs that more than one capture would write."""
    return captures.groupBy("output").agg(F.count("*").alias("captures")).filter("captures > 1")


def without_done(captures: DataFrame, done: DataFrame, key: str = "capture_id") -> DataFrame:
    """Captures that are not in ``done``: resume."""
    return captures.join(done.select(key), key, "left_anti")


def make_folder(path: str) -> None:
    """Create a folder unless it is there."""
    system, inner = resolve(path)
    system.create_dir(inner, recursive=True)


def folder_names(path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    system, inner = resolve(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [info.base_name for info in found]


def move_folder(source: str, target: str) -> None:
    """Give a finished folder its name."""
    system, inner = resolve(source)
    system.move(inner, resolve(target)[1])


def existing_outputs(spark: SparkSession, out_root: str, captures: DataFrame) -> DataFrame:
    """Those of ``captures`` whose output file is there. Outputs appear by rename, so they are whole."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.pcap")
        .load(out_root)
        .select(relative_to(F.col("path"), out_root).alias("_below"))
    )
    wanted = captures.withColumn("_below", relative_to(F.col("output"), out_root))
    return wanted.join(listed, "_below", "left_semi").drop("_below")


def decode_header(df: DataFrame, head: str = "head") -> DataFrame:
    """Add kind, byte order, time unit, snaplen and linktype from the first 24 bytes.

    A snaplen of 0 or above 262144 counts as 262144. Link types of pcapng are per
    interface; the column then holds 1, Ethernet.
    """
    hexed = F.hex(head)
    magic = F.substring(hexed, 1, 8)
    little = magic.isin(MAGIC_LE_MICROS, MAGIC_LE_NANOS)
    big = magic.isin(MAGIC_BE_MICROS, MAGIC_BE_NANOS)
    df = df.withColumn(
        "kind",
        F.when(little | big, "pcap").when(magic == MAGIC_PCAPNG, "pcapng").otherwise("unknown"),
    )
    whole = (F.col("kind") == "pcap") & (F.length(head) >= FILE_HEADER)
    either = lambda offset: F.when(
        whole, F.when(little, hex_uint_le(hexed, offset, 4)).otherwise(hex_uint(hexed, offset, 4))
    )
    snaplen = either(16)
    valid = (snaplen > 0) & (snaplen <= MAX_SNAPLEN)
    return df.withColumns(
        {
            # A pcapng section names its byte order itself, behind type and length.
            "big_endian": big | ((magic == MAGIC_PCAPNG) & (F.substring(hexed, 17, 8) == MAGIC_PCAPNG_BE)),
            "nanos": magic.isin(MAGIC_LE_NANOS, MAGIC_BE_NANOS),
            "snaplen": F.when(valid, snaplen).when(F.col("kind") != "unknown", MAX_SNAPLEN),
            "linktype": F.when(F.col("kind") == "pcapng", F.lit(1).cast("long"))
            .when(whole, either(20))
            .cast("int"),
        }
    )


def read_headers(captures: DataFrame) -> DataFrame:
    """Add the decoded file header; ``error`` says why a capture cannot be read.

    Only the first 24 bytes of each file are read.
    """
    schema = captures.schema
    names = schema.names

    def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, errors = [], []
            for path in batch.column(names.index("path")).to_pylist():
                try:
                    with open_input(path) as source:
                        heads.append(source.read(FILE_HEADER))
                    errors.append(None)
                except OSError as problem:
                    heads.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            columns = [*batch.columns, pa.array(heads, pa.binary()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "head", "error"])

    df = captures.mapInArrow(peek, T.StructType([*schema.fields, *HEAD_FIELDS]))
    df = decode_header(df)
    unknown = (F.col("kind") == "unknown") & F.col("error").isNull()
    df = df.withColumn(
        "error", F.when(unknown, "unknown capture format").otherwise(F.col("error"))
    )
    return df.drop("head")
