import os
import random

import pytest
from pyspark.sql import functions as F

from framedrift.sources import capture_format, discovery, index
from framedrift.sources.packets import read_packets
from tests import build

FRAMES = [bytes([i % 251]) * (20 + i % 30) for i in range(900)]
TIMES = [1_000_000_000 + 1000 * i for i in range(900)]


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture()
def tree(spark, tmp_path):
    capture_format.register_format(spark)
    put(tmp_path / "in", "d/capA", build.pcap(list(zip(TIMES, FRAMES)), ">", nanos=True))
    blocks = b"".join(build.enhanced(t, f) for t, f in zip(TIMES, FRAMES))
    put(tmp_path / "in", "d/capN", build.section() + build.interface() + blocks)
    put(tmp_path / "in", "d/capS", build.pcap(list(zip(TIMES[:7], FRAMES[:7])), linktype=101))
    put(tmp_path / "in", "d/capCut", build.pcap(list(zip(TIMES[:9], FRAMES[:9])))[:-5])
    put(tmp_path / "in", "d/capE", build.pcap([]))
    put(tmp_path / "in", "d/capX", b"what is this")
    put(tmp_path / "in", "d/encrypted_1/capZ", build.pcap([(1, b"x")]))
    put(tmp_path / "in", "d/other", build.pcap([(1, b"x")]))
    return tmp_path


def table(df):
    names = ("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", "linktype", "repaired", "error", "frame")
    return sorted((tuple(r[n] if n != "frame" else r.frame and bytes(r.frame) for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("mode", ["STRICT", "REPAIR"])
def test_reads_as_the_scan_does(spark, tree, mode):
    root = str(tree / "in")
    expected = table(read_packets(discovery.read_headers(discovery.discover(spark, root)).withColumn("error", F.lit(None).cast("string")).filter("kind <> 'unknown'"), mode))
    for options in ({}, {"splitBytes": 2048}, {"splitBytes": 100}):
        df = spark.read.format("pcap").options(mode=mode, **options).load(root)
        rows = table(df)
        assert [r for r in rows if r[7] is None] == expected
        assert [(r[0], r[7]) for r in rows if r[7]] == [("d/capX", "ValueError: unknown capture format")]
    assert table(spark.read.format("pcap").load(root + "/d/other"))[0][0] == "other"
    bare = spark.read.format("pcap").option("frames", "false").load(root)
    assert bare.filter("frame is not null").count() == 0 and bare.filter("error is null").count() == len(table(df)) - 1


def test_filters_choose_ranges_of_the_index(spark, tree):
    root, folder = str(tree / "in"), str(tree / "index")
    index.write_index(discovery.discover(spark, root), folder, index_bytes=4096)
    df = spark.read.format("pcap").option("index", folder).load()
    plain = spark.read.format("pcap").load(root)
    assert [r for r in table(df) if r[7] is None] == [r for r in table(plain) if r[7] is None]
    some = df.filter("capture_id = 'd/capN' and packet_no >= 500 and packet_no < 520")
    expected = table(plain.filter("capture_id = 'd/capN' and packet_no between 500 and 519"))
    assert len(expected) == 20 and table(some) == expected
    by_time = (F.col("ts_us") > TIMES[100]) & (F.col("ts_us") <= TIMES[120]) & F.col("capture_id").isin("d/capA", "d/capN")
    assert table(df.filter(by_time)) == table(plain.filter(by_time))
    # Bytes of other ranges may be gone.
    ranges = index.wanted_ranges(index.read_index(spark, folder), (500, 520), captures=["d/capN"]).collect()
    path = tree / "in/d/capN"
    data = bytearray(len(path.read_bytes()))
    for r in ranges:
        data[r.start : r.stop] = path.read_bytes()[r.start : r.stop]
    path.write_bytes(bytes(data))
    assert 0 < len(ranges) < 4 and table(some) == expected


def test_a_large_index_is_planned_by_row_groups(spark, tree, monkeypatch):
    root, folder = str(tree / "in"), str(tree / "index")
    index.write_index(discovery.discover(spark, root), folder, index_bytes=2048)
    reader = capture_format.CaptureReader({"index": folder})
    few = reader.partitions()
    monkeypatch.setattr(capture_format, "PLANNED_RANGES", 3)
    slices = reader.partitions()
    assert few[0].rows and slices[0].rows is None and len(slices) > 2
    rows = lambda parts: sorted((b["capture_id"][i].as_py(), b["packet_no"][i].as_py() or -1) for p in parts for b in reader.read(p) for i in range(b.num_rows))
    assert rows(few) == rows(slices) and len(rows(few)) > 1800


def test_pushed_filters_narrow_the_bounds():
    f = capture_format
    bounds = f.Bounds()
    bounds.narrow([f.In(("capture_id",), ("a", "b")), f.EqualTo(("capture_id",), "b"), f.GreaterThan(("packet_no",), 4), f.LessThan(("packet_no",), 9), f.EqualTo(("ts_us",), 7)])
    assert bounds == f.Bounds({"b"}, (5, 8), (7, 7))


def test_write_and_read_back(spark, tree):
    out = str(tree / "out")
    draw = random.Random(4)
    rows = [(f"day{i % 3}/cap{i % 3}", i // 3, 5_000_000 + 7 * i, draw.randbytes(draw.randint(0, 60))) for i in range(600)]
    df = spark.createDataFrame([(c, n, t, bytearray(f)) for c, n, t, f in rows], "capture_id string, packet_no long, ts_us long, frame binary")
    df = df.repartition(4, "capture_id").sortWithinPartitions("capture_id", "packet_no")
    df.write.format("pcap").mode("append").save(out)
    back = spark.read.format("pcap").load(out)
    assert back.select("capture_id").distinct().count() == 3
    got = [(r.capture_id.split(".")[0], r.packet_no, r.ts_us, bytes(r.frame), r.orig_len) for r in back.collect()]
    assert sorted(got) == sorted((c, n, t, f, len(f)) for c, n, t, f in rows)
    assert not [n for n in os.listdir(out) if n.startswith("_temporary")]
    df.filter("capture_id = 'day1/cap1'").write.format("pcap").mode("overwrite").save(out)
    assert spark.read.format("pcap").load(out).count() == 200
    with pytest.raises(Exception, match="needed to write"):
        df.drop("ts_us").write.format("pcap").mode("append").save(out)


def test_an_aborted_job_leaves_no_file(spark, tree):
    out = tree / "out"
    df = spark.range(0, 400, 1, 4).select(
        F.lit("d/capQ").alias("capture_id"), F.col("id").alias("ts_us"), F.encode(F.col("id").cast("string"), "UTF-8").alias("frame")
    )
    failing = df.withColumn("ts_us", F.when(F.col("ts_us") == 399, F.raise_error(F.lit("no more"))).otherwise(F.col("ts_us")))
    with pytest.raises(Exception, match="no more"):
        failing.write.format("pcap").mode("append").save(str(out))
    assert not out.exists() or not [p for p in out.rglob("*") if p.is_file()]
    df.write.format("pcap").mode("append").save(str(out))
    assert spark.read.format("pcap").load(str(out)).count() == 400
