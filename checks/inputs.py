"""The given tables seen as captures, packets, frames and files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framedrift.operators import selection
from framedrift.sinks.captures import place_fragments, write_fragments
from framedrift.sources import discovery
from framedrift.sources.files import open_input, resolve, shared_folder, spread_small

# A run of consecutive events is a capture, so captures are bounded whatever the data.
BLOCK = 500
CHUNK = 100
BLOCKS_PER_DAY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_of(event_id: Column) -> Column:
    day = F.floor(event_id / (BLOCK * BLOCKS_PER_DAY)).cast("string")
    block = F.floor(event_id / BLOCK).cast("string")
    return F.concat(F.lit("day"), day, F.lit("/cap"), block)


def packets(spark: SparkSession, sf_dir: str, frames: bool = False) -> DataFrame:
    """Events as packets; the payload is ``props``."""
    df = table(spark, sf_dir, "events")
    df = spread_small(df) if frames else df
    payload = F.encode("props", "UTF-8")
    frame = frame_of(payload) if frames else payload
    return df.select(
        capture_of(F.col("event_id")).alias("capture_id"),
        (F.col("event_id") % BLOCK).alias("packet_no"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.length(frame).cast("long").alias("orig_len"),
        frame.alias("frame"),
        F.lit(1).alias("linktype"),
        "event_id",
        "user_id",
    )


def start(spark: SparkSession, sf_dir: str, frames: bool = False, track: bool = False) -> DataFrame:
    return selection.start_trace(packets(spark, sf_dir, frames), CHUNK, 2, track)


def _hex(value: Column | int, width: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value), 2 * width, "0")


def frame_of(payload: Column) -> Column:
    """Ethernet frame around ``payload``, checksums zero.

    event_id % 4: 0 IPv4/TCP, 1 IPv4/UDP, 2 IPv6/TCP, 3 VLAN/IPv4/TCP.
    """
    kind = F.col("event_id") % 4
    size = F.length(payload)
    sequence = F.pmod(F.col("event_id") * 1_000_003, F.lit(1 << 32))
    tcp = F.concat(F.lit("04D20050"), _hex(sequence, 4), F.lit("00000007501802000000" + "0000"))
    udp = F.concat(F.lit("003514E9"), _hex(size + 8, 2), F.lit("0000"))
    segment = F.when(kind == 1, udp).otherwise(tcp)
    total = size + F.when(kind == 1, 8).otherwise(20)
    user = _hex(F.col("user_id") % 65536, 2)
    proto = F.when(kind == 1, "11").otherwise("06")
    v4 = F.concat(
        F.lit("4500"), _hex(total + 20, 2), _hex(F.col("event_id") % 65536, 2), F.lit("400040"),
        proto, F.lit("00000A00"), user, F.lit("C0A80001"),
    )
    v6 = F.concat(
        F.lit("60000000"), _hex(total, 2), F.lit("064020010DB8" + "0" * 20), user,
        F.lit("20010DB8" + "0" * 22 + "01"),
    )
    ethertype = F.when(kind == 2, "86DD").when(kind == 3, "810000050800").otherwise("0800")
    head = F.concat(
        F.lit("020000000001020000000002"), ethertype, F.when(kind == 2, v6).otherwise(v4), segment
    )
    return F.concat(F.unhex(head), payload)


def chained_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as IPv6/TCP frames with extension headers, checksums zero.

    event_id % 6: 0 hop-by-hop, 1 routing with a stop left, 2 first fragment, 3 later fragment,
    4 hop-by-hop and destination options, 5 authentication.
    """
    df = spread_small(packets(spark, sf_dir))
    kind = F.col("event_id") % 6
    user = _hex(F.col("user_id") % 65536, 2)
    options = F.lit("00010400000000")
    stop = F.concat(F.lit("0602000100000000" + "20010DB8" + "0" * 18 + "FF"), user)
    chain = F.when(kind == 0, F.concat(F.lit("06"), options)).when(kind == 1, stop).when(kind == 2, "0600000000000007")
    chain = chain.when(kind == 3, "0600001000000007").when(kind == 4, F.concat(F.lit("3C"), options, F.lit("06"), options))
    chain = chain.otherwise("0604" + "0" * 44)
    following = F.when(kind == 1, "2B").when(kind.isin(2, 3), "2C").when(kind == 5, "33").otherwise("00")
    sequence = F.pmod(F.col("event_id") * 1_000_003, F.lit(1 << 32))
    segment = F.concat(F.lit("04D20050"), _hex(sequence, 4), F.lit("00000007501802000000" + "0000"), F.hex("frame"))
    size = F.length(F.concat(chain, segment)) / 2
    head = F.concat(
        F.lit("020000000001020000000002" + "86DD" + "60000000"), _hex(size.cast("long"), 2), following, F.lit("40"),
        F.lit("20010DB8" + "0" * 20), user, F.lit("20010DB8" + "0" * 22 + "01"),
    )
    return df.withColumn("frame", F.unhex(F.concat(head, chain, segment))).withColumn("flag", F.lit(True))


def scratch(spark: SparkSession) -> str:
    """A new folder on the shared file system."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def store(trace: DataFrame, root: str) -> DataFrame:
    """Write a gathered trace as captures below ``root``; the stored ledger."""
    spark = trace.sparkSession
    staging = f"{root}/_staging"
    write_fragments(trace, staging, {"packets": F.lit(1).cast("long")}).write.parquet(f"{staging}/ledger")
    ledger = spark.read.parquet(f"{staging}/ledger")
    outputs = discovery.with_output(
        discovery.with_names(ledger.select("capture_id").distinct()), root
    )
    place_fragments(ledger, outputs, staging)
    return ledger


def store_packets(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    trace = selection.gather_parts(start(spark, sf_dir, frames=True))
    return store(trace.withColumn("ts_new_us", F.col("ts_us")), root)


# One capture that holds seven of eight events, and small ones; ranges are cut so that it has several.
SPLIT = 32 << 10


def hot_packets(spark: SparkSession, sf_dir: str, frames: bool = False) -> DataFrame:
    e = F.col("event_id")
    small = e % 8 == 0
    named = F.concat(F.lit("day1/cap"), F.floor(e / (8 * BLOCK)).cast("string"))
    number = F.when(small, F.floor(e % (8 * BLOCK) / 8)).otherwise(e - F.floor(e / 8) - 1).cast("long")
    return packets(spark, sf_dir, frames).withColumns(
        {"capture_id": F.when(small, named).otherwise("day0/capBig"), "packet_no": number}
    )


def store_hot(spark: SparkSession, sf_dir: str, root: str) -> None:
    trace = selection.start_trace(hot_packets(spark, sf_dir, frames=True), CHUNK, 2)
    store(selection.gather_parts(trace).withColumn("ts_new_us", F.col("ts_us")), root)


def store_pieces(pieces: DataFrame, root: str) -> None:
    """Write (capture_id, packet_no, piece) as files of the pieces in order, part by part like the writer."""
    staging = f"{root}/_staging"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("capture_id", pa.string()), ("part_id", pa.int64()), ("fragment", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                system, folder = resolve(staging)
                system.create_dir(folder, recursive=True)
                name, data = uuid.uuid4().hex, b"".join(row["pieces"])
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(data)
                ledger = {"capture_id": row["capture_id"], "part_id": row["part_id"], "fragment": f"{staging}/{name}", "bytes": len(data)}
                yield pa.RecordBatch.from_pylist([ledger], schema=kinds)

    ordered = F.array_sort(F.collect_list(F.struct("packet_no", "piece")))
    parts = pieces.groupBy("capture_id", F.floor(F.col("packet_no") / (2 * CHUNK)).alias("part_id")).agg(
        F.transform(ordered, lambda x: x["piece"]).alias("pieces")
    )
    ledger = parts.mapInArrow(write, "capture_id string, part_id long, fragment string, bytes long, error string")
    ledger.write.parquet(f"{staging}/ledger")
    ledger = pieces.sparkSession.read.parquet(f"{staging}/ledger")
    outputs = discovery.with_output(discovery.with_names(ledger.select("capture_id").distinct()), root)
    place_fragments(ledger, outputs, staging)


def store_hot_pcapng(spark: SparkSession, sf_dir: str, root: str, damaged: bool = False) -> None:
    """Big-endian pcapng with nanosecond time stamps; every 97th event's block may have a bad length."""
    df = hot_packets(spark, sf_dir)
    size = F.length("frame")
    padded = F.floor((size + 3) / 4) * 4
    ticks = F.col("ts_us") * 1000
    claimed = F.when(F.lit(damaged) & (F.col("event_id") % 97 == 5), F.lit(0x7FFFFFFF).cast("long")).otherwise(padded + 32)
    block = F.concat(
        F.lit("00000006"), _hex(claimed, 4), F.lit("00000000"),
        _hex(F.floor(ticks / (1 << 32)).cast("long"), 4), _hex(F.pmod(ticks, F.lit(1 << 32)), 4), _hex(size, 4), _hex(size, 4),
        F.rpad(F.hex("frame"), (padded * 2).cast("int"), F.lit("0")), _hex(padded + 32, 4),
    )
    section = "0A0D0D0A0000001C1A2B3C4D00010000FFFFFFFFFFFFFFFF0000001C"
    interface = "00000001000000200001000000000000" + "0009000109000000" + "00000000" + "00000020"
    whole = F.concat(F.when(F.col("packet_no") == 0, section + interface).otherwise(""), block)
    store_pieces(df.select("capture_id", "packet_no", F.unhex(whole).alias("piece")), root)


def store_hot_damaged(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Big-endian captures: empty records (event_id % 7 = 3), and a last one that claims 2^31 - 1 bytes of ten."""
    df = hot_packets(spark, sf_dir)
    empty = F.col("event_id") % 7 == 3
    size = F.length("frame")
    record = F.concat(
        _hex(F.floor(F.col("ts_us") / 1_000_000).cast("long"), 4), _hex(F.col("ts_us") % 1_000_000, 4),
        _hex(F.when(empty, 0).otherwise(size).cast("long"), 4), _hex(size, 4), F.when(empty, "").otherwise(F.hex("frame")),
    )
    head = "A1B2C3D4" + "00020004" + "0" * 16 + "0000FFFF" + "00000001"
    whole = F.concat(F.when(F.col("packet_no") == 0, head).otherwise(""), record)
    last = df.groupBy("capture_id").agg((F.max("packet_no") + 1).alias("packet_no"))
    last = last.withColumn("piece", F.unhex(F.lit("00000001000000027FFFFFFF000000FF" + "AB" * 10)))
    store_pieces(df.select("capture_id", "packet_no", F.unhex(whole).alias("piece")).unionByName(last), root)


def store_hot_gaps(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Little-endian captures with damage at every 101st event: in turn, junk behind its record, and a bad length in it."""
    df = hot_packets(spark, sf_dir)
    hit = F.col("event_id") % 101 == 7
    odd = F.floor(F.col("event_id") / 101) % 2 == 1
    size = F.length("frame")
    claimed = F.when(hit & odd, F.lit(0x7FFFFFFF)).otherwise(size).cast("long")
    record = F.concat(
        _little(F.floor(F.col("ts_us") / 1_000_000).cast("long"), 4), _little(F.col("ts_us") % 1_000_000, 4),
        _little(claimed, 4), _little(size, 4), F.hex("frame"), F.when(hit & ~odd, F.lit("FF" * 37)).otherwise(""),
    )
    head = "D4C3B2A1" + "02000400" + "0" * 16 + "FFFF0000" + "01000000"
    whole = F.concat(F.when(F.col("packet_no") == 0, head).otherwise(""), record)
    store_pieces(df.select("capture_id", "packet_no", F.unhex(whole).alias("piece")), root)


def copy_share(spark: SparkSession, source: str, target: str, share: float) -> None:
    """Put the first ``share`` of each file below ``source`` under the same name below ``target``."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = resolve(f"{target}/{row['capture_id']}")
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with open_input(row["path"]) as whole, system.open_output_stream(inner) as out:
                    left = int(row["length"] * share)
                    while left > 0:
                        data = whole.read(min(left, 1 << 20))
                        out.write(data)
                        left -= len(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    found = discovery.discover(spark, source).select("capture_id", "path", "length")
    found.mapInArrow(copy, "n long").agg(F.sum("n")).collect()


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an imaginary directory, one per event."""
    e = F.col("event_id")
    middle = (
        F.when(e % 5 == 0, "sub/cap")
        .when(e % 5 == 1, "encrypted_pcaps/cap")
        .when(e % 5 == 2, "x/Encrypted/y/cap")
        .when(e % 5 == 3, "other")
        .otherwise("notencrypted/cap host-")
    )
    path = F.concat(F.lit("file:/data/in/d"), (e % 7).cast("string"), F.lit("/"), middle, e.cast("string"))
    return table(spark, sf_dir, "events").select(path.alias("path"), "user_id")


def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes of imaginary captures, one per event."""
    e, u = F.col("event_id"), F.col("user_id")
    magic = F.when(e % 6 == 0, "D4C3B2A1").when(e % 6 == 1, "A1B2C3D4").when(e % 6 == 2, "4D3CB2A1")
    magic = magic.when(e % 6 == 3, "A1B23C4D").when(e % 6 == 4, "0A0D0D0A").otherwise("CAFEBABE")
    snaplen = _hex(u * 3000 % 400_000, 4)
    link = F.when(e % 4 == 0, F.lit("00000065")).otherwise("00000001")
    flip = lambda h: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    little = F.col("_le")
    df = table(spark, sf_dir, "events").select(
        "event_id", magic.alias("_m"), snaplen.alias("_s"), link.alias("_l"), (e % 2 == 0).alias("_le")
    )
    head = F.concat(
        F.col("_m"), F.lit("0" * 24),
        F.when(little, flip(F.col("_s"))).otherwise(F.col("_s")),
        F.when(little, flip(F.col("_l"))).otherwise(F.col("_l")),
    )
    whole = F.unhex(head)
    cut = F.when(F.col("event_id") % 11 == 10, F.substring(whole, 1, 20)).otherwise(whole)
    return df.select("event_id", cut.alias("head"))


def _joined(df: DataFrame, piece: Column) -> DataFrame:
    """Hex pieces of each capture joined in packet order; a capture has at most BLOCK of them."""
    ordered = F.array_sort(F.collect_list(F.struct("packet_no", piece.alias("h"))))
    return df.groupBy("capture_id").agg(
        F.array_join(F.transform(ordered, lambda item: item["h"]), "").alias("body")
    )


def _little(value: Column, width: int) -> Column:
    h = _hex(value, width)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def pcapng_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as little-endian pcapng files in ``content``, nanosecond time stamps."""
    df = packets(spark, sf_dir)
    size = F.length("frame")
    padded = F.floor((size + 3) / 4) * 4
    ticks = F.col("ts_us") * 1000
    piece = F.concat(
        F.lit("06000000"), _little(padded + 32, 4), F.lit("00000000"),
        _little(F.floor(ticks / (1 << 32)).cast("long"), 4), _little(F.pmod(ticks, F.lit(1 << 32)), 4),
        _little(size, 4), _little(size, 4),
        F.rpad(F.hex("frame"), (padded * 2).cast("int"), F.lit("0")), _little(padded + 32, 4),
    )
    section = "0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"
    interface = "01000000200000000100000000000000" + "0900010009000000" + "00000000" + "20000000"
    df = _joined(df, piece)
    return df.select("capture_id", F.unhex(F.concat(F.lit(section + interface), "body")).alias("content"))


def damaged_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as big-endian captures with empty records and a bad last length in ``content``.

    event_id % 7 = 3: empty record. The last record of a block claims 40 bytes too many,
    or 2^31 - 1 bytes in odd blocks.
    """
    df = packets(spark, sf_dir)
    empty = F.col("event_id") % 7 == 3
    last = F.col("packet_no") == BLOCK - 1
    odd = F.floor(F.col("event_id") / BLOCK) % 2 == 1
    size = F.length("frame")
    claimed = F.when(last & odd, 0x7FFFFFFF).when(last, size + 40).when(empty, 0).otherwise(size)
    held = F.when(empty & ~last, F.lit("")).otherwise(F.hex("frame"))
    piece = F.concat(
        _hex(F.floor(F.col("ts_us") / 1_000_000).cast("long"), 4), _hex(F.col("ts_us") % 1_000_000, 4),
        _hex(claimed.cast("long"), 4), _hex(size, 4), held,
    )
    head = "A1B2C3D4" + "00020004" + "0" * 16 + "0000FFFF" + "00000001"
    df = _joined(df, piece)
    return df.select("capture_id", F.unhex(F.concat(F.lit(head), "body")).alias("content"))
