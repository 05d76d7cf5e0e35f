"""Frames and capture files made by hand, and slow reference arithmetic for them."""

import struct

MAGICS = {
    ("<", False): b"\xd4\xc3\xb2\xa1",
    (">", False): b"\xa1\xb2\xc3\xd4",
    ("<", True): b"\x4d\x3c\xb2\xa1",
    (">", True): b"\xa1\xb2\x3c\x4d",
}
ETHER = bytes.fromhex("020000000001020000000002")


def ones_sum(data: bytes) -> int:
    data += b"\x00" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total > 0xFFFF:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def complement(data: bytes) -> int:
    return 0xFFFF - ones_sum(data)


def pseudo(src: bytes, dst: bytes, proto: int, size: int) -> bytes:
    if len(src) == 16:
        return src + dst + struct.pack(">II", size, proto)
    return src + dst + struct.pack(">BBH", 0, proto, size & 0xFFFF)


def tcp(seq: int, payload: bytes, options: bytes = b"") -> bytes:
    offset = (20 + len(options)) // 4 << 4
    return struct.pack(">HHIIBBHHH", 1234, 80, seq, 7, offset, 0x18, 512, 0, 0) + options + payload


def udp(payload: bytes, size=None) -> bytes:
    return struct.pack(">HHHH", 53, 5353, 8 + len(payload) if size is None else size, 0) + payload


def ipv4(proto: int, segment: bytes, options: bytes = b"", flags: int = 0) -> bytes:
    head = struct.pack(
        ">BBHHHBBH4s4s",
        0x40 | (20 + len(options)) // 4, 0, 20 + len(options) + len(segment), 9, flags, 64, proto, 0,
        bytes([192, 168, 0, 1]), bytes([10, 1, 2, 3]),
    ) + options
    head = head[:10] + struct.pack(">H", complement(head)) + head[12:]
    return head + sealed(segment, proto, head[12:16], head[16:20])


def ipv6(proto: int, segment: bytes) -> bytes:
    src, dst = bytes(range(16)), bytes(range(16, 32))
    head = struct.pack(">IHBB", 6 << 28, len(segment), proto, 64) + src + dst
    return head + sealed(segment, proto, src, dst)


def sealed(segment: bytes, proto: int, src: bytes, dst: bytes) -> bytes:
    at = {6: 16, 17: 6}.get(proto)
    if at is None:
        return segment
    segment = segment[:at] + b"\0\0" + segment[at + 2 :]
    value = complement(pseudo(src, dst, proto, len(segment)) + segment)
    if proto == 17 and value == 0:
        value = 0xFFFF
    return segment[:at] + struct.pack(">H", value) + segment[at + 2 :]


def ether(ethertype: int, payload: bytes, vlans: int = 0) -> bytes:
    tags = b"".join(struct.pack(">HH", 0x8100, 5) for _ in range(vlans))
    return ETHER + tags + struct.pack(">H", ethertype) + payload


def checksums_hold(frame: bytes, l3: int = 14) -> bool:
    """IP, TCP and UDP checksums of an Ethernet frame verify to all ones."""
    ip = frame[l3:]
    if ip[0] >> 4 == 4:
        size = (ip[0] & 15) * 4
        total = struct.unpack(">H", ip[2:4])[0]
        proto, src, dst, segment = ip[9], ip[12:16], ip[16:20], ip[size:total]
        if ones_sum(ip[:size]) != 0xFFFF:
            return False
    else:
        total = 40 + struct.unpack(">H", ip[4:6])[0]
        proto, src, dst, segment = ip[6], ip[8:24], ip[24:40], ip[40:total]
    if proto not in (6, 17):
        return True
    return ones_sum(pseudo(src, dst, proto, len(segment)) + segment) == 0xFFFF


def pcap(packets, order="<", nanos=False, snaplen=65535, linktype=1) -> bytes:
    """``packets``: (ts_us, frame) or (ts_us, frame, incl_len, orig_len)."""
    data = MAGICS[order, nanos] + struct.pack(order + "HHIIII", 2, 4, 0, 0, snaplen, linktype)
    for ts_us, frame, *lengths in packets:
        incl, orig = lengths or (len(frame), len(frame))
        fraction = ts_us % 1_000_000 * (1000 if nanos else 1)
        data += struct.pack(order + "IIII", ts_us // 1_000_000, fraction, incl, orig) + frame
    return data


def block(order, kind, body) -> bytes:
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def section(order="<") -> bytes:
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order="<", linktype=1, tsresol=None, tsoffset=None, snaplen=0) -> bytes:
    body = struct.pack(order + "HHI", linktype, 0, snaplen)
    if tsresol is not None:
        body += struct.pack(order + "HHB3x", 9, 1, tsresol)
    if tsoffset is not None:
        body += struct.pack(order + "HHq", 14, 8, tsoffset)
    return block(order, 1, body)


def enhanced(ticks, frame, order="<", number=0) -> bytes:
    head = struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame))
    return block(order, 6, head + frame + b"\0" * (-len(frame) % 4))


def simple(frame, order="<") -> bytes:
    return block(order, 3, struct.pack(order + "I", len(frame)) + frame)


def read_pcap(data: bytes):
    """(ts_us, incl, orig, frame) of a written capture; strict about its format."""
    assert data[:4] == MAGICS["<", False]
    rows, at = [], 24
    while at < len(data):
        sec, usec, incl, orig = struct.unpack_from("<IIII", data, at)
        rows.append((sec * 1_000_000 + usec, incl, orig, data[at + 16 : at + 16 + incl]))
        at += 16 + incl
    assert at == len(data)
    return rows


def chain(headers, proto: int, segment: bytes) -> bytes:
    """IPv6 packet whose segment follows extension headers (kind, body from its third byte on); checksum as received."""
    src, dst = bytes(range(16)), bytes(range(16, 32))
    kinds = [kind for kind, _ in headers] + [proto]
    body, final, later = b"", dst, False
    for (kind, rest), following in zip(headers, kinds[1:]):
        if kind == 44:
            body += bytes([following, 0]) + rest
            later |= struct.unpack(">H", rest[:2])[0] >= 8
            continue
        unit, less = (4, 2) if kind == 51 else (8, 1)
        assert (2 + len(rest)) % unit == 0
        body += bytes([following, (2 + len(rest)) // unit - less]) + rest
        if kind == 43 and rest[1]:
            final = rest[6:22] if rest[0] == 4 else rest[-16:]
    if not later:
        segment = sealed(segment, proto, src, final)
    head = struct.pack(">IHBB", 6 << 28, len(body) + len(segment), kinds[0], 64) + src + dst
    return head + body + segment
