import random
import struct

import pytest
from pyspark.sql import functions as F

from framedrift.functions.frames import forge_length, ip_header_checksum, shift_sequence, with_header
from framedrift.functions.octets import pad_to, word_sum, word_sum_native
from framedrift.operators.content import fix_length
from tests import build


def frames(spark, items, linktype=1):
    data = [(i, bytearray(frame), linktype) for i, frame in enumerate(items)]
    return spark.createDataFrame(data, "i int, frame binary, linktype int").repartition(2).withColumn("flag", F.lit(True))


def edited(df, function, *args, **kwargs):
    done = function(df, "flag", *args, **kwargs)
    return [(bytes(r.frame), r.flag) for r in done.orderBy("i").select("frame", "flag").collect()]


def l4(frame):
    return 14 + (frame[14] & 15) * 4


def test_ip_checksum_of_the_published_example(spark):
    header = bytes.fromhex("450000730000400040110000c0a80001c0a800c7")
    df = spark.createDataFrame([(bytearray(header),)], "h binary")
    assert df.select(F.hex(ip_header_checksum(F.col("h"))).alias("c")).first().c == "B861"


def test_word_sums_agree_with_a_plain_fold(spark):
    draw = random.Random(3)
    data = [draw.randbytes(draw.randint(0, 90)) for _ in range(400)] + [b"\xff" * 7, b"", None, b"\0"]
    df = spark.createDataFrame([(d and bytearray(d) if d != b"" else bytearray(),) for d in data], "d binary")
    got = df.select("d", word_sum(F.col("d")).alias("a"), word_sum_native(F.col("d")).alias("n")).collect()
    assert sum(r.d is None for r in got) == 1
    for r in got:
        if r.d is None:
            assert r.a is None and r.n is None
        else:
            assert r.a == r.n == build.ones_sum(bytes(r.d)) % 65535


def test_header_decoding(spark):
    tcp4 = build.ether(0x800, build.ipv4(6, build.tcp(77, b"hello", b"\1" * 8), b"\1" * 4))
    items = [
        tcp4,
        build.ether(0x86DD, build.ipv6(6, build.tcp(78, b"six"))),
        build.ether(0x800, build.ipv4(17, build.udp(b"odd")), vlans=1),
        build.ether(0x800, build.ipv4(17, build.udp(b"odd!")), vlans=2),
        build.ether(0x806, b"\0" * 28),
        build.ether(0x800, build.ipv4(6, build.tcp(1, b""))) + b"\0" * 6,
        build.ether(0x800, build.ipv4(6, build.tcp(1, b"frag"), flags=5)),
        build.ether(0x800, build.ipv4(1, b"\x08\0\0\0\0\1\0\1ping")),
        build.ether(0x1234, b"other"),
        b"short",
        build.ether(0x800, build.ipv4(6, build.tcp(5, b"zz"))[:25]),
    ]
    got = [r.hdr for r in with_header(frames(spark, items)).orderBy("i").collect()]
    view = lambda h: (h.l3_off, h.l4_off, h.payload_off, h.payload_len, h.has_ip, h.has_tcp, h.has_udp)
    assert view(got[0]) == (14, 38, 66, 5, True, True, False) and got[0].tcp_seq == 77
    assert view(got[1]) == (14, 54, 74, 3, True, True, False) and got[1].ip_total_len == 63
    assert view(got[2]) == (18, 38, 46, 3, True, False, True)
    assert view(got[3]) == (22, 42, 50, 4, True, False, True)
    assert view(got[4]) == (14, None, 42, 0, False, False, False)
    assert view(got[5]) == (14, 34, 54, 0, True, True, False)
    assert view(got[6]) == (14, 34, 34, 24, True, False, False)
    assert view(got[7]) == (14, 34, 42, 4, True, False, False)
    assert view(got[8]) == (14, None, 14, 5, False, False, False)
    assert got[9] is None
    assert view(got[10]) == (14, 34, 34, 5, True, False, False)
    assert with_header(frames(spark, items[:1], linktype=101)).first().hdr is None


@pytest.mark.parametrize("native", [False, True])
def test_sequence_shift(spark, native):
    first = build.ether(0x800, build.ipv4(6, build.tcp(0xFFFFFFFA, b"0123456789")))
    others = [
        build.ether(0x86DD, build.ipv6(6, build.tcp(9, b"odd"))),
        build.ether(0x800, build.ipv4(6, build.tcp(9, b""), b"\1" * 4)) + b"pad",
    ]
    udp = build.ether(0x800, build.ipv4(17, build.udp(b"u")))
    broken = bytearray(first)
    broken[50] ^= 0xFF
    items = [first, *others, udp, bytes(broken)]
    got = edited(frames(spark, items), shift_sequence, 1000, native=native)
    assert got[0][0][38:42].hex() == "000003e2"
    assert got[4][0] == got[0][0], "a wrong checksum is recomputed, not carried along"
    assert got[3] == (udp, False)
    for before, (after, flag) in zip(items[:3], got):
        assert flag and len(after) == len(before) and build.checksums_hold(after)
        changed = [i for i in range(len(before)) if before[i] != after[i]]
        start = l4(before) if before[12:14] == b"\x08\x00" else 54
        assert set(changed) <= {*range(start + 4, start + 8), start + 16, start + 17}
    back = edited(frames(spark, [g for g, _ in got[:3]]), shift_sequence, -1000, native=native)
    assert [b for b, _ in back] == items[:3]


@pytest.mark.parametrize("native", [False, True])
@pytest.mark.parametrize("new_len", [None, 3, 64, 65])
def test_length_forgery(spark, native, new_len):
    items = [
        build.ether(0x800, build.ipv4(6, build.tcp(1, b"0123456789"))),
        build.ether(0x800, build.ipv4(17, build.udp(b"seven77"))),
        build.ether(0x86DD, build.ipv6(17, build.udp(b"six six"))),
        build.ether(0x800, build.ipv4(6, build.tcp(1, b""))) + b"\0" * 6,
    ]
    got = edited(frames(spark, items), forge_length, new_len, b"\xee", native=native)
    heads = [54, 42, 62, 54]
    payloads = [b"0123456789", b"seven77", b"six six", b""]
    for before, (after, flag), head, payload in zip(items, got, heads, payloads):
        size = new_len or (len(payload) * 3 // 2 if payload else 32)
        forged = (payload + b"\xee" * size)[:size]
        assert flag and after[head : head + size] == forged
        assert after[head + size :] == before[head + len(payload) :]
        assert build.checksums_hold(after)
    only = edited(frames(spark, items[1:2]), forge_length, 20, b"\0", lengths="ipv4", native=native)
    assert only[0][0][38:40] == items[1][38:40]


def test_forgery_of_other_frames(spark):
    items = [build.ether(0x806, b"\1" * 28), build.ether(0x1234, b"abcd"), b"tiny"]
    got = edited(frames(spark, items), forge_length, None, b"\0")
    assert got[0] == (items[0] + b"\0" * 32, True)
    assert got[1] == (items[1] + b"\0\0", True)
    assert got[2] == (b"tiny", False)


def test_one_byte_grows_by_nothing_and_huge_totals(spark):
    one = build.ether(0x800, build.ipv4(6, build.tcp(1, b"x")))
    got = edited(frames(spark, [one, one]), forge_length, None)
    assert got[0] == (one, True)
    got = edited(frames(spark, [one]), forge_length, 70_000)
    assert got[0][0][16:18] == b"\0\0" and len(got[0][0]) == 54 + 70_000


def test_udp_checksum_is_never_zero(spark):
    """Payloads run through all values of one word, so one of them sums to zero."""
    base = build.ether(0x800, build.ipv4(17, build.udp(b"\0\0")))
    df = frames(spark, [base])
    df = df.select("linktype", "flag", F.explode(F.sequence(F.lit(0), F.lit(65535))).alias("i"), "frame")
    word = F.unhex(F.lpad(F.hex("i"), 4, "0"))
    df = df.withColumn("frame", F.concat(F.substring("frame", 1, 42), word))
    done = forge_length(df, "flag", 2).select(F.hex(F.substring("frame", 41, 2)).alias("c"))
    assert done.filter("c = '0000'").count() == 0
    assert done.filter("c = 'FFFF'").count() == 1


def test_fixed_frame_length(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"), True), (bytearray(b"ab"), True), (bytearray(b"ab"), False)],
                               "frame binary, selected boolean")
    got = [bytes(r.frame) for r in fix_length(df, 4).collect()]
    assert got == [b"abcd", b"ab\x0f\x0f", b"ab"]
    assert bytes(fix_length(df, 0).first().frame) == b""
    assert bytes(df.select(pad_to(F.col("frame"), 7, b"\0")).first()[0]) == b"abcdef\0"


HOP = (0, b"\1\4" + b"\0" * 4)
STOPS = [bytes([0x20] * 15 + [i]) for i in (1, 2, 3)]
ROUTE = (43, bytes([0, 2]) + b"\0" * 4 + b"".join(STOPS))
ARRIVED = (43, bytes([0, 0]) + b"\0" * 4 + b"".join(STOPS))
SEGMENTS = (43, bytes([4, 1, 2, 0, 0, 0]) + b"".join(STOPS))
WHOLE, LATER = (44, b"\0\0" + b"\0\0\0\7"), (44, b"\0\x10" + b"\0\0\0\7")
SIGNED = (51, b"\0\0" + b"\1" * 8 + b"\2" * 12)
LAST = (60, b"\1" * 14)
CHAINS = [[HOP], [ROUTE], [ARRIVED], [SEGMENTS], [WHOLE], [SIGNED], [LAST], [HOP, LAST, ROUTE, WHOLE, SIGNED, LAST], [HOP] * 30]


def chained(headers, segment=None, proto=6):
    return build.ether(0x86DD, build.chain(headers, proto, segment or build.tcp(50, b"odd")))


def test_extension_headers_are_followed(spark):
    cases = [*CHAINS, [LATER], [HOP, LATER, LAST], [(50, b"\0" * 6)], [(59, b"\0" * 6)]]
    items = [chained(c) for c in cases] + [chained(CHAINS[7], build.udp(b"x"), 17), chained([HOP])[:60]]
    got = [r.hdr for r in with_header(frames(spark, items)).orderBy("i").collect()]
    for headers, hdr, frame in zip(CHAINS, got, items):
        size = len(frame) - 54 - 23
        assert (hdr.l3_off, hdr.ihl, hdr.l4_off, hdr.proto, hdr.has_tcp) == (14, 40 + size, 54 + size, 6, True), headers
        assert (hdr.tcp_seq, hdr.payload_off, hdr.payload_len, hdr.ip_total_len) == (50, 74 + size, 3, len(frame) - 14)
    assert [h.has_tcp for h in got[len(CHAINS) :]] == [False] * 6
    assert (got[9].l4_off, got[9].payload_off) == (62, 62) and got[10].l4_off == 70  # a later fragment holds no header
    assert (got[11].proto, got[12].proto) == (50, 59)
    assert got[13].has_udp and got[13].payload_len == 1
    assert got[14].l4_off == 54 and got[14].proto == 0  # cut within the chain


@pytest.mark.parametrize("options", [{}, {"native": True}, {"checksums": "update"}])
def test_sequence_shift_behind_extension_headers(spark, options):
    got = edited(frames(spark, [*map(chained, CHAINS), chained([LATER])]), shift_sequence, 1000, **options)
    assert got[:-1] == [(chained(c, build.tcp(1050, b"odd")), True) for c in CHAINS]
    assert got[-1] == (chained([LATER]), False)


def test_lengths_behind_extension_headers(spark):
    got = edited(frames(spark, [chained(c, build.udp(b"abc"), 17) for c in CHAINS]), forge_length, 8, b"\xee")
    assert got == [(chained(c, build.udp(b"abc" + b"\xee" * 5), 17), True) for c in CHAINS]


def test_authentication_header_of_version_4(spark):
    segment = build.tcp(50, b"odd")
    inner = build.sealed(segment, 6, bytes([192, 168, 0, 1]), bytes([10, 1, 2, 3]))
    signed = bytes([6, 4]) + SIGNED[1]
    item = build.ether(0x800, build.ipv4(51, signed + inner))
    assert edited(frames(spark, [item]), shift_sequence, 5) == [(item[:58] + build.sealed(build.tcp(55, b"odd"), 6, bytes([192, 168, 0, 1]), bytes([10, 1, 2, 3])), True)]


def test_updated_checksums_equal_full_sums_on_sound_frames(spark):
    draw = random.Random(8)
    items = []
    for i in range(300):
        segment = build.tcp(draw.getrandbits(32), draw.randbytes(draw.randint(0, 40)), draw.choice([b"", b"\1" * 8]))
        items.append(build.ether(0x800, build.ipv4(6, segment)) if i % 2 else build.ether(0x86DD, build.ipv6(6, segment), vlans=i % 3))
    for offset in (1000, 0, -1, 0x10000, 0xFFFF, 1 << 31):
        df = frames(spark, items)
        assert edited(df, shift_sequence, offset, checksums="update") == edited(df, shift_sequence, offset)
    plan = shift_sequence(frames(spark, items), "flag", 9, checksums="update")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        shift_sequence(frames(spark, items), "flag", 9, checksums="guess")


def test_updated_checksums_keep_an_error(spark):
    sound = build.ether(0x800, build.ipv4(6, build.tcp(7, b"payload")))
    wrong = sound[:50] + struct.pack(">H", (struct.unpack(">H", sound[50:52])[0] + 5) % 65535) + sound[52:]
    (fixed, _), (kept, _) = (edited(frames(spark, [wrong]), shift_sequence, 9, checksums=c)[0] for c in ("recompute", "update"))
    right = struct.unpack(">H", fixed[50:52])[0]
    assert build.checksums_hold(fixed) and struct.unpack(">H", kept[50:52])[0] == (right + 5) % 65535
    assert kept[:50] == fixed[:50] and kept[52:] == fixed[52:]
