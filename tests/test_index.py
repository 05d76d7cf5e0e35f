import os

import pytest
from pyspark.sql import functions as F

from framedrift.sources import discovery, index
from framedrift.sources.packets import read_packets
from tests import build

FRAMES = [bytes([i % 251]) * (20 + i % 30) for i in range(900)]
TIMES = [1_000_000_000 + 1000 * i for i in range(900)]


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def ng(order=">", damaged=()):
    blocks = b""
    for i, frame in enumerate(FRAMES):
        block = bytearray(build.enhanced(TIMES[i], frame, order))
        if i in damaged:
            block[4:8] = b"\x7f\xff\xff\xff"
        blocks += bytes(block)
    return build.section(order) + build.interface(order) + blocks


@pytest.fixture()
def tree(tmp_path):
    put(tmp_path / "in", "d/capA", build.pcap(list(zip(TIMES, FRAMES)), ">"))
    put(tmp_path / "in", "d/capN", ng())
    put(tmp_path / "in", "d/capS", build.pcap(list(zip(TIMES[:7], FRAMES[:7]))))
    put(tmp_path / "in", "d/capX", b"what is this")
    return tmp_path


def found(df):
    return sorted((r.capture_id, r.packet_no, r.ts_us, bytes(r.frame)) for r in df.filter("error is null").collect())


def whole(spark, root):
    return found(read_packets(discovery.read_headers(discovery.discover(spark, root)).filter("error is null")))


def test_parts_are_read_from_their_ranges_alone(spark, tree):
    root = str(tree / "in")
    stored = index.write_index(discovery.discover(spark, root), str(tree / "index"), index_bytes=4096)
    everything = whole(spark, root)
    assert found(index.read_indexed(stored)) == everything
    assert sum(r.packets for r in stored.collect()) == len(everything) == 1807
    some = index.read_indexed(stored, packets=(400, 410))
    assert found(some) == [r for r in everything if 400 <= r[1] < 410]
    times = (TIMES[100], TIMES[140])
    assert found(index.read_indexed(stored, times=times)) == [r for r in everything if times[0] <= r[2] < times[1]]
    assert found(index.read_indexed(stored, times=times, packets=(130, 900), captures=["d/capN"])) == [
        r for r in everything if r[0] == "d/capN" and 130 <= r[1] < 140
    ]
    # The ranges in question, of all; a file that cannot be read keeps its error.
    ranges = index.wanted_ranges(stored, packets=(400, 410)).filter("error is null")
    assert ranges.count() <= 4 and stored.filter("capture_id = 'd/capA'").count() > 8
    assert ranges.agg(F.max(F.col("stop") - F.col("start"))).first()[0] < 2 * 4096
    assert [(r.capture_id, r.error) for r in some.filter("error is not null").collect()] == [("d/capX", "unknown capture format")]
    assert index.wanted_ranges(stored, packets=(3, 4), captures=["d/capS"]).count() == 1
    assert index.read_indexed(stored, packets=(5000, 6000)).filter("error is null").count() == 0


def test_only_the_ranges_are_opened(spark, tree):
    """Bytes outside the wanted ranges may be gone."""
    root = str(tree / "in")
    stored = index.write_index(discovery.discover(spark, root), str(tree / "index"), index_bytes=4096)
    expected = [r for r in whole(spark, root) if r[0] == "d/capN" and 500 <= r[1] < 520]
    ranges = index.wanted_ranges(stored, (500, 520), captures=["d/capN"]).collect()
    path = tree / "in/d/capN"
    data = bytearray(len(path.read_bytes()))
    for r in ranges:
        data[r.start : r.stop] = path.read_bytes()[r.start : r.stop]
    path.write_bytes(bytes(data))
    assert found(index.read_indexed(stored, (500, 520), captures=["d/capN"])) == expected


def test_only_new_and_changed_files_are_walked(spark, tree):
    root, folder = str(tree / "in"), str(tree / "index")
    index.write_index(discovery.discover(spark, root), folder, index_bytes=4096)
    times = {p.name: p.stat().st_mtime_ns for p in (tree / "in/d").iterdir()}
    # The same length and time, other bytes: taken as it was.
    (tree / "in/d/capA").write_bytes(b"\0" * (tree / "in/d/capA").stat().st_size)
    os.utime(tree / "in/d/capA", ns=(times["capA"], times["capA"]))
    put(tree / "in", "d/capS", build.pcap(list(zip(TIMES[:9], FRAMES[:9]))))
    put(tree / "in", "e/capNew", build.pcap(list(zip(TIMES[:3], FRAMES[:3]))))
    (tree / "in/d/capX").unlink()
    stored = index.write_index(discovery.discover(spark, root), folder, index_bytes=4096)
    counts = {r.capture_id: r.n for r in stored.groupBy("capture_id").agg(F.sum("packets").alias("n")).collect()}
    assert counts == {"d/capA": 900, "d/capN": 900, "d/capS": 9, "e/capNew": 3}
    assert index.read_index(spark, folder).count() == stored.count()
    assert sorted(discovery.folder_names(folder)) == ["version=0", "version=1"]
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, str(tree / "nowhere"))


def test_damage_and_modes(spark, tmp_path):
    put(tmp_path / "in", "d/capD", ng(damaged=range(5, 900, 60)))
    captures = discovery.discover(spark, str(tmp_path / "in"))
    strict = index.write_index(captures, str(tmp_path / "index"), index_bytes=4096)
    assert "damaged block" in index.read_indexed(strict).first().error
    mended = index.write_index(captures, str(tmp_path / "index"), "REPAIR", index_bytes=4096)
    df = index.read_indexed(mended, packets=(300, 302)).filter("repaired is null")
    numbers = [i for i in range(900) if i % 60 != 5]
    assert found(df) == [("d/capD", n, TIMES[numbers[n]], FRAMES[numbers[n]]) for n in (300, 301)]


@pytest.mark.parametrize("split", [2048, 4096, 1 << 20])
def test_a_capture_damaged_in_all_its_ranges_is_an_error(spark, tmp_path, split):
    """Ranges that cannot be walked have no borders to compare, and must not be dropped for it."""
    put(tmp_path, "d/capD", ng(damaged=range(5, 900, 9)))
    rows = read_packets(discovery.read_headers(discovery.discover(spark, str(tmp_path))), split_bytes=split).filter("error is not null").collect()
    assert len(rows) == 1 and "damaged block at byte" in rows[0].error
