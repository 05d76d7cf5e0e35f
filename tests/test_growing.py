import random

import pytest
from pyspark.sql import functions as F

from framedrift.plans.job import run_directory
from framedrift.plans.plan import read_plan
from framedrift.sources import capture_format
from framedrift.sources.records import complete_end
from framedrift.streaming.growing import Growing
from tests import build

PLAN = [{"type": "loss", "pct": 0.2}, {"type": "retransmit", "pct": 0.3}, {"type": "reorder", "pct": 0.8, "params": {"m": 4}}]


def some_packets(n, seed=1):
    draw = random.Random(seed)
    return [(1_600_000_000_000_000 + i * 1000, draw.randbytes(draw.randint(1, 90))) for i in range(n)]


def ng(packets):
    blocks = [build.enhanced(t, f, ">") for t, f in packets]
    middle = build.section("<") + build.interface("<")  # a section of the other byte order half way
    later = [build.enhanced(t, f) for t, f in packets[len(packets) // 2 :]]
    return build.section(">") + build.interface(">") + b"".join(blocks[: len(packets) // 2]) + middle + b"".join(later)


@pytest.mark.parametrize("greedy", [False, True])
def test_growing_captures_come_out_as_in_the_batch_job(spark, tmp_path, greedy):
    whole = {"d/capA": build.pcap(some_packets(230), ">"), "d/capN": ng(some_packets(150, 2)), "d/capS": build.pcap(some_packets(7, 3))}
    raw = PLAN if not greedy else [*PLAN[:2], {"type": "reorder", "pct": 0.5, "params": {"m": 4, "method": "greedy"}}]
    for root in ("in", "grown"):
        (tmp_path / root / "d").mkdir(parents=True)
    for name, data in whole.items():
        (tmp_path / "in" / name).write_bytes(data)
    run_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), read_plan(raw), seed=6, chunk_size=20, chunks_per_part=2, part_files=True)
    growing = Growing(str(tmp_path / "grown_out"), read_plan(raw), str(tmp_path / "check"), seed=6, chunk_size=20, chunks_per_part=2)
    draw = random.Random(5)
    sizes = dict.fromkeys(whole, 0)
    for last in [False] * (2 if greedy else 4) + [True]:
        for name, data in whole.items():
            sizes[name] = len(data) if last else min(len(data), sizes[name] + draw.choice([0, 3, 17, len(data) // 4, len(data) // 3]))
            (tmp_path / "grown" / name).write_bytes(data[: sizes[name]])
        growing.start(spark, str(tmp_path / "grown"), splitBytes=1000).awaitTermination()
    found = lambda root: {str(p.relative_to(tmp_path / root)): p.read_bytes() for p in (tmp_path / root).rglob("*.pcap")}
    before = found("grown_out")
    assert before.items() < found("out").items()  # complete parts are there before the end
    growing.finish(spark)
    assert found("grown_out") == found("out")
    assert growing.errors(spark).count() == 0


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    capture_format.register_format(spark)
    data = build.pcap(some_packets(100))
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for size in (10, 700, 701, len(data) - 1, len(data)):
        (tmp_path / "in/capA").write_bytes(data[:size])
        stream = spark.readStream.format("pcap").option("state", str(tmp_path / "state")).option("maxBytesPerTrigger", 400).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        whole = complete_end(data[24:size], {"kind": "pcap", "big_endian": False}, 24, False)[0] if size > 24 else 24
        assert spark.read.schema(stream.schema).parquet(out).count() <= len(build.read_pcap(data[:whole]))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(out).orderBy("packet_no").collect()
    assert [(r.packet_no, r.ts_us, bytes(r.frame)) for r in rows] == [(i, t, f) for i, (t, f) in enumerate(some_packets(100))]


def test_a_damaged_capture_is_told_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    blocks = [build.enhanced(t, f) for t, f in some_packets(60)]
    bad = blocks[30][:4] + b"\x01\0\0\0" + blocks[30][8:]
    head = build.section() + build.interface()
    growing = Growing(str(tmp_path / "out"), read_plan([{"type": "seq_offset", "pct": 0.0}]), str(tmp_path / "check"), chunk_size=5, chunks_per_part=1)
    for data in (head + b"".join(blocks[:20]), head + b"".join([*blocks[:30], bad, *blocks[31:50]]), head + b"".join([*blocks[:30], bad, *blocks[31:]])):
        (tmp_path / "in/capD").write_bytes(data)
        growing.start(spark, str(tmp_path / "in")).awaitTermination()
    assert [r.capture_id for r in growing.errors(spark).filter(F.col("error").contains("damaged block")).collect()] == ["capD"]


def test_ends_of_whole_records():
    data = build.pcap(some_packets(5))
    ends = [24]
    for _, frame in some_packets(5):
        ends.append(ends[-1] + 16 + len(frame))
    little = {"kind": "pcap", "big_endian": False, "snaplen": 65535}
    for size in range(24, len(data) + 1):
        assert complete_end(data[24:size], little, 24, False) == (max(e for e in ends if e <= size), "<")
    blocks = ng(some_packets(6))
    assert complete_end(blocks, {"kind": "pcapng", "big_endian": True}, 0, False) == (len(blocks), "<")
    assert complete_end(blocks[:-3], {"kind": "pcapng", "big_endian": True}, 0, True)[0] < len(blocks) - 3
