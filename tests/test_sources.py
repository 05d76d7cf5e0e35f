import random
import struct

import pytest
from pyspark.sql import functions as F

from framedrift.sources import discovery, records
from framedrift.sources.index import read_indexed, write_index
from framedrift.sources.packets import SPLIT_BYTES, TASKS_PER_CORE, capture_ranges, read_content, read_packets, scan_tasks
from tests import build

FRAMES = [build.ether(0x800, build.ipv4(6, build.tcp(i, b"x" * i))) for i in range(3)]
PACKETS = [(1_600_000_000_000_000 + i * 999_999, frame) for i, frame in enumerate(FRAMES)]


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def load(spark, root, **options):
    captures = discovery.read_headers(discovery.discover(spark, str(root)))
    return read_packets(captures, **options)


def rows(df):
    return sorted(
        (r.capture_id, r.packet_no, r.ts_us, bytes(r.frame)) for r in df.filter("frame is not null").collect()
    )


def test_discovery_rules(spark, tmp_path):
    for name in ["d1/capA", "d1/sub/capB.x", "d1/encrypted_pcaps/capC", "d1/ENCRYPTED/x/capD",
                 "d1/other.pcap", "cap root", "d1/notencrypted/capE", "d1/capA2"]:
        put(tmp_path / "encrypted_root", name, b"1234")
    root = str(tmp_path / "encrypted_root")
    found = discovery.discover(spark, root).collect()
    assert sorted(r.capture_id for r in found) == sorted(
        ["d1/capA", "d1/sub/capB.x", "cap root", "d1/notencrypted/capE", "d1/capA2"]
    )
    by_id = {r.capture_id: r for r in found}
    assert by_id["d1/sub/capB.x"].date_dir == "d1"
    assert by_id["d1/sub/capB.x"].base_name == "capB.x"
    assert by_id["cap root"].date_dir == "cap root"
    assert [r.capture_id for r in discovery.discover(spark, root, 2).collect()] == ["cap root", "d1/capA"]
    assert discovery.discover(spark, root, 0).count() == 5


def test_output_paths_and_clashes(spark, tmp_path):
    for name in ["d1/a/capX", "d1/b/capX"]:
        put(tmp_path, name, b"1234")
    captures = discovery.discover(spark, str(tmp_path))
    mirrored = discovery.with_output(captures, "/out")
    assert sorted(r.output for r in mirrored.collect()) == ["/out/d1/a/capX.pcap", "/out/d1/b/capX.pcap"]
    assert discovery.output_clashes(mirrored).count() == 0
    dated = discovery.with_output(captures, "/out", "date")
    assert [tuple(r) for r in discovery.output_clashes(dated).collect()] == [("/out/d1/capX.pcap", 2)]


def test_four_magics_and_pcapng_agree(spark, tmp_path):
    for (order, nanos) in build.MAGICS:
        put(tmp_path, f"cap{'le' if order == '<' else 'be'}{nanos}", build.pcap(PACKETS, order, nanos))
        data = build.section(order) + build.interface(order, tsresol=9 if nanos else 6)
        for ts, frame in PACKETS:
            data += build.enhanced(ts * (1000 if nanos else 1), frame, order)
        put(tmp_path, f"capng{'le' if order == '<' else 'be'}{nanos}", data)
    df = load(spark, tmp_path)
    got = rows(df)
    assert len(got) == 8 * 3
    for name in {r[0] for r in got}:
        mine = [r[1:] for r in got if r[0] == name]
        assert mine == [(i, ts, frame) for i, (ts, frame) in enumerate(PACKETS)], name
    content = spark.read.format("binaryFile").load(str(tmp_path)).withColumn(
        "capture_id", F.substring_index("path", "/", -1)
    )
    assert rows(read_content(content)) == got


def test_header_fields(spark, tmp_path):
    put(tmp_path, "capA", build.pcap(PACKETS, ">", True, snaplen=0, linktype=101))
    put(tmp_path, "capB", build.pcap(PACKETS, "<", snaplen=300_000))
    put(tmp_path, "capC", b"not a capture, long enough")
    put(tmp_path, "capD", build.pcap([])[:20])
    got = {r.capture_id: r for r in discovery.read_headers(discovery.discover(spark, str(tmp_path))).collect()}
    a, b, c, d = (got[f"cap{x}"] for x in "ABCD")
    assert (a.kind, a.big_endian, a.nanos, a.snaplen, a.linktype) == ("pcap", True, True, 262144, 101)
    assert (b.snaplen, b.linktype) == (262144, 1)
    assert (c.kind, c.error) == ("unknown", "unknown capture format")
    assert d.error is None and d.linktype is None
    assert load(spark, tmp_path).filter("capture_id = 'capD'").count() == 0


def test_repair(spark, tmp_path):
    tail = b"abcdefghij"
    good = build.pcap([(1, b"first"), (2, b"", 0, 0), (3, b"third")])
    cut = build.pcap([(1, b"first"), (2, tail, 40, 60)])
    long = build.pcap([(1, b"first"), (2, b"x" * 30, 70_000, 70_000)], snaplen=20)
    empty_end = build.pcap([(1, b"first"), (2, b"", 9, 9)])
    for name, data in [("capgood", good), ("capcut", cut), ("caplong", long), ("capend", empty_end)]:
        put(tmp_path, name, data)
    df = load(spark, tmp_path, mode="REPAIR")
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.capture_id, r.packet_no, r.ts_us)):
        got.setdefault(r.capture_id, []).append((r.packet_no, r.frame and bytes(r.frame), r.orig_len, r.repaired))
    assert got["capgood"] == [(0, b"first", 5, None), (1, None, 0, "discarded"), (1, b"third", 5, None)]
    assert got["capcut"] == [(0, b"first", 5, None), (1, tail, 10, "truncated")]
    assert got["caplong"][1] == (1, b"x" * 20, 20, "capped")
    assert got["capend"] == [(0, b"first", 5, None), (1, None, 0, "discarded")]


def random_packets(n, seed, low=0, high=1500):
    draw = random.Random(seed)
    return [
        (1_600_000_000_000_000 + i * 1000, draw.randbytes(draw.randint(low, high))) for i in range(n)
    ]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_large_captures_split_exactly(spark, tmp_path, order, kind):
    packets = random_packets(3000, 5)
    if kind == "pcap":
        data = build.pcap(packets, order)
    else:
        data = build.section(order) + build.interface(order)
        for i, (ts, frame) in enumerate(packets):
            if i == 1500:
                data += build.interface(order, linktype=101, tsresol=9)
            number = int(i >= 1500 and i % 2)
            data += build.enhanced(ts * (1000 if number else 1), frame, order, number)
    put(tmp_path, "capbig", data)
    put(tmp_path, "capsmall", build.pcap(PACKETS))
    captures = discovery.read_headers(discovery.discover(spark, str(tmp_path)))
    ranges = capture_ranges(captures, "STRICT", 1 << 17)
    assert ranges.count() > 10
    got = rows(read_packets(captures, split_bytes=1 << 17).filter("capture_id = 'capbig'"))
    assert got == [("capbig", i, ts, frame) for i, (ts, frame) in enumerate(packets)]


@pytest.mark.parametrize("mode", ["STRICT", "REPAIR"])
def test_misleading_payloads_do_not_mislead_splits(spark, tmp_path, mode):
    """Frames that contain whole captures propose wrong starts; the chain check corrects them."""
    inner = build.pcap(random_packets(400, 9, 10, 40))[24:]
    packets = [(i, inner[: 20_000 + i]) for i in range(60)]
    put(tmp_path, "captrap", build.pcap(packets))
    got = rows(load(spark, tmp_path, mode=mode, split_bytes=1 << 15))
    assert got == [("captrap", i, ts, frame) for i, (ts, frame) in enumerate(packets)]


def test_damage_in_a_large_capture_follows_the_serial_rule(spark, tmp_path):
    packets = random_packets(1500, 11, 1, 600)
    data = bytearray(build.pcap(packets, snaplen=2000))
    struct.pack_into("<I", data, 24 + 8, 0xFFFFFFF0)
    at = 24
    for i, (_, frame) in enumerate(packets):
        if i == 700:
            struct.pack_into("<I", data, at + 8, 0x7FFFFFFF)
        at += 16 + len(frame)
    put(tmp_path, "capbad", bytes(data))
    whole = rows(load(spark, tmp_path, mode="REPAIR"))
    split = rows(load(spark, tmp_path, mode="REPAIR", split_bytes=1 << 14))
    assert whole == split and len(whole) > 100


def test_simple_blocks_offsets_and_errors(spark, tmp_path):
    data = build.section() + build.interface(tsoffset=100, tsresol=0x80 | 10, snaplen=4)
    data += build.enhanced(2048, b"abc") + build.simple(b"abcd") + build.block("<", 5, b"stat")
    put(tmp_path, "capng", data)
    put(tmp_path, "capngcut", data[:-6])
    got = rows(load(spark, tmp_path))
    assert [r[1:] for r in got if r[0] == "capng"] == [(0, 102_000_000, b"abc"), (1, 0, b"abcd")]
    # A cut file says so: an error row, or with repair a discarded record.
    cut = load(spark, tmp_path).filter("capture_id = 'capngcut'").collect()
    assert [r.error for r in cut if r.error] == [f"ValueError: damaged block at byte {len(data) - 16}"], cut
    mended = load(spark, tmp_path, mode="REPAIR").filter("capture_id = 'capngcut'").collect()
    assert [r.repaired for r in mended] == [None, None, "discarded"] and not any(r.error for r in mended)


def test_missing_file_is_an_error_row(spark, tmp_path):
    put(tmp_path, "capA", build.pcap(PACKETS))
    put(tmp_path, "capB", build.pcap(PACKETS))
    captures = discovery.read_headers(discovery.discover(spark, str(tmp_path)))
    ranges = spark.createDataFrame(capture_ranges(captures).collect(), capture_ranges(captures).schema)
    (tmp_path / "capB").unlink()
    from framedrift.sources.packets import read_ranges

    got = read_ranges(ranges).collect()
    assert sum(r.error is None for r in got if r.capture_id == "capA") == 3
    assert [r.error[:17] for r in got if r.capture_id == "capB"] == ["FileNotFoundError"]


def test_count_without_frames(spark, tmp_path):
    put(tmp_path, "capA", build.pcap(PACKETS))
    df = load(spark, tmp_path, with_frames=False)
    assert df.filter("frame is null").count() == 3


def pcapng_of(packets, order="<", bad=()):
    """``bad``: numbers of packets before which a block with a senseless size stands."""
    data = build.section(order) + build.interface(order)
    for i, (ts, frame) in enumerate(packets):
        if i in bad:
            data += struct.pack(order + "II", 6, 7)
        data += build.enhanced(ts, frame, order)
    return data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("split_bytes", [1 << 26, 1 << 14])
def test_damaged_blocks_lose_nothing_in_silence(spark, tmp_path, order, split_bytes):
    packets = random_packets(300, 3)
    put(tmp_path, "capng", pcapng_of(packets, order, bad=(100, 220)))
    mended = load(spark, tmp_path, mode="REPAIR", split_bytes=split_bytes).collect()
    assert sorted((r.packet_no, bytes(r.frame)) for r in mended if r.frame is not None) == [
        (i, frame) for i, (_, frame) in enumerate(packets)
    ]
    assert sum(r.repaired == "discarded" for r in mended) == 2
    strict = load(spark, tmp_path, split_bytes=split_bytes).collect()
    assert ["damaged block" in r.error for r in strict if r.error] == [True]


def test_big_endian_blocks_split_without_a_serial_walk(spark, tmp_path, monkeypatch):
    from framedrift.sources import packets as source

    def refuse(*args):
        raise AssertionError("walked in one task")

    packets = random_packets(1500, 6)
    put(tmp_path, "capbe", pcapng_of(packets, ">"))
    monkeypatch.setattr(source, "_walk_whole", refuse)
    captures = discovery.read_headers(discovery.discover(spark, str(tmp_path)))
    ranges = capture_ranges(captures, "STRICT", 1 << 16).collect()
    assert len(ranges) > 10 and max(r.stop - r.start for r in ranges) < 2 << 16
    got = rows(read_packets(captures, split_bytes=1 << 16))
    assert [r[1:] for r in got] == [(i, ts, frame) for i, (ts, frame) in enumerate(packets)]


@pytest.mark.parametrize("split_bytes", [1 << 26, 1 << 14])
def test_a_capture_that_cannot_be_walked_is_an_error_row(spark, tmp_path, split_bytes):
    """An interface block too short for its fields, at any size of file."""
    packets = random_packets(200, 8)
    bad = build.section() + build.block("<", 1, b"") + pcapng_of(packets)[len(build.section()) :]
    put(tmp_path, "capbad", bad)
    put(tmp_path, "capgood", pcapng_of(packets))
    got = load(spark, tmp_path, split_bytes=split_bytes).collect()
    assert {r.capture_id for r in got if r.error} == {"capbad"}
    assert sum(r.frame is not None for r in got if r.capture_id == "capgood") == 200


def test_frames_longer_than_their_block(spark, tmp_path):
    block = bytearray(build.enhanced(5, b"abcdefgh"))
    struct.pack_into("<I", block, 20, 40)
    put(tmp_path, "capng", build.section() + build.interface() + bytes(block) + build.enhanced(6, b"next"))
    mended = load(spark, tmp_path, mode="REPAIR").collect()
    assert sorted((r.packet_no, bytes(r.frame), r.repaired) for r in mended) == [(0, b"abcdefgh", "capped"), (1, b"next", None)]
    assert [r.error for r in load(spark, tmp_path).collect() if r.error] == ["ValueError: frame longer than its block at byte 48"]


def test_many_small_ranges_share_tasks(spark, tmp_path):
    """Tasks follow bytes and cores, not the number of ranges, for captures and their index."""
    packets = [(1_600_000_000_000_000 + i * 1000, b"y" * 80) for i in range(4000)]
    put(tmp_path / "in", "d/capA", build.pcap(packets))
    put(tmp_path / "in", "d/capB", build.pcap(packets[:5]))
    df = load(spark, tmp_path / "in", split_bytes=1024)
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() <= most
    assert [(r.packet_no, r.ts_us) for r in df.filter("capture_id = 'd/capA'").orderBy("packet_no").collect()] == [(i, t) for i, (t, _) in enumerate(packets)]
    stored = write_index(discovery.discover(spark, str(tmp_path / "in")), str(tmp_path / "index"), index_bytes=1024)
    assert stored.count() > 300 and len(stored.inputFiles()) <= most
    found = read_indexed(stored)
    assert found.count() == 4005 and found.rdd.getNumPartitions() <= most


def test_tasks_of_a_scan(spark):
    few = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert scan_tasks(spark, 0, 0) == scan_tasks(spark, 1, 10) == 1
    assert scan_tasks(spark, 7, 7 * SPLIT_BYTES) == 7
    assert scan_tasks(spark, 100_000, 100_000 << 15) == max(few, -(-(100_000 << 15) // SPLIT_BYTES))
    assert scan_tasks(spark, 5000, 5000 * SPLIT_BYTES) == 5000


def test_sound_records_are_sought_near_first(monkeypatch):
    """Few bytes are looked at if a sound record is near; far ones are found all the same."""
    looked = []
    words = records._words
    monkeypatch.setattr(records, "_words", lambda octets, at, span, big: looked.append(span) or words(octets, at, span, big))
    whole = build.pcap([(1_600_000_000_000_000 + i * 1000, b"y" * 80) for i in range(30_000)])[24:]
    capture = {"kind": "pcap", "big_endian": False, "nanos": False, "snaplen": 65535}
    assert records.guess_start(whole[5:], capture) == 91
    assert records.next_record(whole, 5, capture, len(whole), None) == 96
    assert sum(looked) <= 8 * records.FIRST_LOOK
    for gap in (records.FIRST_LOOK - 1, 5 * records.FIRST_LOOK, 300_000, 1_200_000):
        junk = b"\xff" * gap + whole
        assert records.next_record(junk, 3, capture, len(junk), None) == gap
        assert records.guess_start(junk, capture) == (gap if gap < records.GUESS_WINDOW else None)
    pieces = build.section() + build.interface() + b"".join(build.enhanced(i, b"z" * 60) for i in range(100))
    begin = len(build.section() + build.interface())
    assert records.next_block(b"\xff" * 200_000 + pieces, 0, "<") == 200_000 + begin
