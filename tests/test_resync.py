import random

import pytest

from framedrift.sources import discovery
from framedrift.sources.packets import read_packets
from tests import build


def some_packets(n, seed=1):
    draw = random.Random(seed)
    return [(1_600_000_000_000_000 + i * 1000, draw.randbytes(draw.randint(1, 90))) for i in range(n)]


def records(packets, order=">"):
    whole = build.pcap(packets, order)
    out, at = [], 24
    for _, frame in packets:
        out.append(whole[at : at + 16 + len(frame)])
        at += 16 + len(frame)
    return whole[:24], out


def read(spark, root, data, **options):
    root.mkdir(exist_ok=True)
    (root / "capA").write_bytes(data)
    df = read_packets(discovery.read_headers(discovery.discover(spark, str(root))), "RESYNC", **options)
    return [(r.packet_no, r.ts_us, r.frame and bytes(r.frame), r.repaired) for r in df.orderBy("packet_no", "repaired").collect()]


@pytest.mark.parametrize("split", [700, 3000, 1 << 20])
def test_junk_gaps_and_false_lengths(spark, tmp_path, split):
    packets = some_packets(300)
    head, parts = records(packets)
    lost = set()
    draw = random.Random(3)
    for i in range(10, 300, 17):
        kind = i % 4
        if kind == 0:
            parts[i] += draw.randbytes(draw.randint(1, 200))  # junk behind
        elif kind == 1:
            parts[i] = parts[i][:8] + b"\x7f\xff\xff\xff" + parts[i][12:]  # a length that cannot be
            lost.add(i)
        elif kind == 2:
            parts[i] = parts[i][draw.randint(1, 15) :]  # a cut header
            lost.add(i)
        else:
            parts[i] = b"\xff" * len(parts[i])
            lost.add(i)
    got = read(spark, tmp_path / "x", head + b"".join(parts), split_bytes=split)
    found = [(t, f) for _, t, f, note in got if note is None]
    kept = [p for i, p in enumerate(packets) if i not in lost]
    assert found == kept, [i for i, p in enumerate(kept) if p not in found]
    assert [n for n, *_, note in got if note is None] == list(range(len(kept)))
    assert {note for *_, note in got} == {None, "discarded"}


def test_a_length_that_swallows_others_is_capped(spark, tmp_path):
    packets = some_packets(40)
    head, parts = records(packets, "<")
    parts[20] = parts[20][:8] + (len(packets[20][1]) + 300).to_bytes(4, "little") + (len(packets[20][1]) + 300).to_bytes(4, "little") + parts[20][16:]
    got = read(spark, tmp_path / "x", head + b"".join(parts))
    assert [(t, f) for _, t, f, _ in got] == packets and [note for *_, note in got].count("capped") == 1 and got[20][3] == "capped"


def test_ends_of_files(spark, tmp_path):
    packets = some_packets(20)
    head, parts = records(packets)
    cut = read(spark, tmp_path / "a", head + b"".join(parts)[:-5])
    assert [f for *_, f, _ in cut][:19] == [f for _, f in packets[:19]] and cut[19][2:] == (packets[19][1][:-5], "truncated")
    junk = read(spark, tmp_path / "b", head + b"".join(parts) + b"\xff" * 50)
    assert [f for *_, f, _ in junk[:20]] == [f for _, f in packets] and [n for *_, n in junk[20:]] == ["discarded"]
    assert read(spark, tmp_path / "c", head) == [] and [n for *_, n in read(spark, tmp_path / "d", head + b"\xff" * 99)] == ["discarded"]
    sound = read(spark, tmp_path / "e", head + b"".join(parts))
    assert [(n, t, f) for n, t, f, _ in sound] == [(i, t, f) for i, (t, f) in enumerate(packets)]
