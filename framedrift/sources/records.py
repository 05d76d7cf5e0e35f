"""Where the packets of a capture lie: a walk over record headers in a block of bytes.

These are the only functions that look at capture bytes row by row; they see one range
of a file at a time and know nothing of Spark.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the two formats.
RECORD_HEADER = 16
SECTION_BLOCK = 0x0A0D0D0A
SECTION_BLOCK_BYTES = b"\x0a\x0d\x0d\x0a"
SECTION_MAGIC_LE = b"\x4d\x3c\x2b\x1a"
SECTION_MAGIC_BE = b"\x1a\x2b\x3c\x4d"
MAGICS = [
    ("<", False, b"\xd4\xc3\xb2\xa1"),
    (">", False, b"\xa1\xb2\xc3\xd4"),
    ("<", True, b"\x4d\x3c\xb2\xa1"),
    (">", True, b"\xa1\xb2\x3c\x4d"),
]
FILE_HEADER = 24
MAX_SNAPLEN = 262_144
INTERFACE_BLOCK = 1
OLD_PACKET_BLOCK = 2
SIMPLE_PACKET_BLOCK = 3
ENHANCED_PACKET_BLOCK = 6
OPTION_TSRESOL = 9
OPTION_TSOFFSET = 14
MICROS = 1_000_000
BLOCK_AROUND_FRAME = 32  # bytes of a packet block beside the frame
LARGEST_FRAME = 128 << 20  # a longer one is no frame, and would not fit a task

# How far and how strictly a split looks for its first record.
GUESS_WINDOW = 1 << 20
GUESS_RUN = 12
RESYNC = "RESYNC"
RESYNC_RUN = 3
FIRST_LOOK = 4 << 10
DAY = 86_400

Packet = tuple[int, int, int, int, int, str | None]


def read_file_header(head: bytes) -> dict:
    """Kind, byte order, time unit, snaplen and linktype of the first 24 bytes, by the rules of ``decode_header``."""
    magic = head[:4]
    if magic == SECTION_BLOCK_BYTES:
        return {"kind": "pcapng", "big_endian": head[8:12] == SECTION_MAGIC_BE, "nanos": False, "snaplen": MAX_SNAPLEN, "linktype": 1}
    found = {m: (order, nanos) for order, nanos, m in MAGICS}.get(magic)
    if found is None:
        return {"kind": "unknown", "big_endian": False, "nanos": False, "snaplen": None, "linktype": None}
    order, nanos = found
    header = {"kind": "pcap", "big_endian": order == ">", "nanos": nanos, "snaplen": MAX_SNAPLEN, "linktype": None}
    if len(head) >= FILE_HEADER:
        snaplen, linktype = struct.unpack_from(order + "II", head, 16)
        header |= {"snaplen": snaplen if 0 < snaplen <= MAX_SNAPLEN else MAX_SNAPLEN, "linktype": linktype}
    return header


class Walk:
    """Position and format state of a walk. ``base`` is the file offset of ``data[0]``."""

    def __init__(self, capture: dict, repair: bool | str, base: int, interfaces: list[str] | None = None):
        self.kind = capture["kind"]
        self.length = capture["length"]
        self.repair = bool(repair)
        self.resync = repair == RESYNC
        self.at = base
        self.order = ">" if capture["big_endian"] else "<"
        self.nanos = capture["nanos"]
        self.snaplen = capture["snaplen"]
        self.linktype = capture["linktype"]
        self.interfaces: list[tuple[int, int, int, int]] = []
        self.found: dict = {}
        for delta in interfaces or []:
            self._adopt(json.loads(delta))

    def _adopt(self, delta: dict) -> None:
        if "order" in delta:
            self.order, self.interfaces = delta["order"], []
        self.interfaces += [tuple(item) for item in delta.get("interfaces", [])]

    def pass_over(self, stop: int, delta: str | None) -> None:
        """Go on at ``stop``, after a range that another walk has read."""
        self.at = stop
        if delta:
            self._adopt(json.loads(delta))

    def delta(self) -> str | None:
        """What a later range must know about the blocks this walk met."""
        return json.dumps(self.found) if self.found else None

    def packets(self, data: bytes, stop: int) -> Iterator[Packet]:
        """(ts_us, begin in data, size, orig_len, linktype, repair note) of records before ``stop``."""
        if self.kind == "pcapng":
            return self._blocks(data, self.at, stop)
        if self.resync:
            return self._resynchronised(data, self.at, stop)
        return self._records(data, self.at, stop)

    def _resynchronised(self, data: bytes, base: int, stop: int) -> Iterator[Packet]:
        """Records before ``stop``; over damage to the next chain of sound ones, noted as one discarded record.

        A record is only as long as to where such a chain begins, if what follows it makes no sense.
        """
        unpack = struct.Struct(self.order + "IIII").unpack_from
        divisor = 1000 if self.nanos else 1
        capture = {"big_endian": self.order == ">", "nanos": self.nanos, "snaplen": self.snaplen}
        moment = None

        def sound(at: int) -> bool:
            """A plausible header, or the end of the file or of what is known of it."""
            if at == self.length or at - base + RECORD_HEADER > len(data):
                return at <= self.length
            return sane_header(*unpack(data, at - base), capture, moment) and at + RECORD_HEADER <= self.length

        while self.at < stop:
            here = self.at - base
            if not sound(self.at) or self.at + RECORD_HEADER > self.length:
                found = next_record(data, here + 1, capture, self.length - base, moment)
                self.at = base + (min(len(data), self.length - base) if found is None else found)
                yield (0, 0, 0, 0, self.linktype, "discarded")
                continue
            seconds, fraction, size, original = unpack(data, here)
            moment, note = seconds, "discarded" if size == 0 else None
            end = self.at + RECORD_HEADER + size
            if end > self.length or not sound(end):
                found = next_record(data, here + RECORD_HEADER, capture, self.length - base, moment)
                if found is not None and base + found < end:
                    end, note = base + found, "capped"
                elif end > self.length:
                    end, note = self.length, "truncated"
            size = end - self.at - RECORD_HEADER
            self.at = end
            yield (
                seconds * MICROS + fraction // divisor, here + RECORD_HEADER, size, original if note is None else max(size, 0), self.linktype, note
            )

    def _records(self, data: bytes, base: int, stop: int) -> Iterator[Packet]:
        unpack = struct.Struct(self.order + "IIII").unpack_from
        divisor = 1000 if self.nanos else 1
        while self.at < stop and self.at + RECORD_HEADER <= self.length:
            seconds, fraction, size, original = unpack(data, self.at - base)
            begin = self.at + RECORD_HEADER
            left = self.length - begin
            note = None
            if self.repair and size > self.snaplen:
                size = original = min(self.snaplen, left)
                note = "capped"
            elif size > left:
                size, note = left, "truncated"
                if self.repair:
                    original = left
            if size > LARGEST_FRAME:
                raise ValueError(f"record of {size} bytes at byte {self.at}")
            if self.repair and size == 0:
                note = "discarded"
            self.at = begin + size
            yield (
                seconds * MICROS + fraction // divisor,
                begin - base,
                size,
                original,
                self.linktype,
                note,
            )

    def _blocks(self, data: bytes, base: int, stop: int) -> Iterator[Packet]:
        while self.at < stop:
            here = self.at - base
            if self.at + 12 > self.length:
                yield self._damage(data, here, base)
                continue
            if data[here : here + 4] == SECTION_BLOCK_BYTES:
                self.order = "<" if data[here + 8 : here + 12] == SECTION_MAGIC_LE else ">"
                self.interfaces = []
                self.found = {"order": self.order, "interfaces": []}
            kind, size = struct.unpack_from(self.order + "II", data, here)
            if size < 12 or size % 4 or self.at + size > self.length:
                yield self._damage(data, here, base)
                continue
            self.at += size
            if kind == INTERFACE_BLOCK:
                interface = self._interface(data[here : here + size])
                self.interfaces.append(interface)
                self.found.setdefault("interfaces", []).append(interface)
            elif kind in (ENHANCED_PACKET_BLOCK, OLD_PACKET_BLOCK):
                fields = "IIIII" if kind == ENHANCED_PACKET_BLOCK else "H2xIIII"
                number, high, low, held, original = struct.unpack_from(
                    self.order + fields, data, here + 8
                )
                note = None
                if held > size - BLOCK_AROUND_FRAME:
                    if not self.repair:
                        raise ValueError(f"frame longer than its block at byte {self.at - size}")
                    held, note = max(0, size - BLOCK_AROUND_FRAME), "capped"
                yield self._timed(number, (high << 32) | low, here + 28, held, original, note)
            elif kind == SIMPLE_PACKET_BLOCK:
                (original,) = struct.unpack_from(self.order + "I", data, here + 8)
                linktype, _, _, snaplen = self._interface_of(0)
                held = min(original, size - 16, snaplen or size)
                yield (0, here + 12, held, original, linktype, None)

    def _damage(self, data: bytes, here: int, base: int) -> Packet:
        """Go to the next sound block; the gap is noted as one discarded record."""
        if not self.repair:
            raise ValueError(f"damaged block at byte {self.at}")
        found = next_block(data, here + 4, self.order)
        # Without one the search goes on at the end of the data, unless that is the end of the file.
        rest = max(here + 4, len(data) - 12) if base + len(data) < self.length else self.length - base
        self.at = base + (rest if found is None else found)
        return (0, 0, 0, 0, self.linktype, "discarded")

    def _interface_of(self, number: int) -> tuple[int, int, int, int]:
        if number < len(self.interfaces):
            return self.interfaces[number]
        return (self.linktype or 1, MICROS, 0, 0)

    def _timed(self, number: int, ticks: int, begin: int, held: int, original: int, note: str | None) -> Packet:
        linktype, per_second, offset, _ = self._interface_of(number)
        moment = ticks * MICROS // per_second + offset * MICROS
        return (moment, begin, held, original, linktype, note)

    def _interface(self, block: bytes) -> tuple[int, int, int, int]:
        """(linktype, ticks per second, offset in seconds, snaplen) of an interface block."""
        linktype, snaplen = struct.unpack_from(self.order + "H2xI", block, 8)
        per_second, offset, at = MICROS, 0, 16
        while at + 4 <= len(block) - 4:
            code, size = struct.unpack_from(self.order + "HH", block, at)
            if code == 0:
                break
            if code == OPTION_TSRESOL and size == 1:
                exponent = block[at + 4]
                per_second = 1 << (exponent & 0x7F) if exponent & 0x80 else 10**exponent
            elif code == OPTION_TSOFFSET and size == 8:
                (offset,) = struct.unpack_from(self.order + "q", block, at + 4)
            at += 4 + size + -size % 4
        return (linktype, per_second, offset, snaplen)


def _looks(begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches that cover ``begin`` to ``end``, each up to four times the one before: what is sought is mostly near."""
    size = FIRST_LOOK
    while begin < end:
        yield begin, min(size, end - begin)
        begin, size = begin + size, min(4 * size, GUESS_WINDOW)


def guess_start(data: bytes, capture: dict) -> int | None:
    """Offset in ``data`` that looks like the first record of a run of sound records.

    Only a proposal: a range is used after it was found to begin where the one before ends.
    """
    octets = np.frombuffer(data, np.uint8)
    order = ">" if capture["big_endian"] else "<"
    for begin, span in _looks(0, min(GUESS_WINDOW, len(octets) - RECORD_HEADER)):
        found = _guess_within(data, octets, begin, span, order, capture)
        if found is not None:
            return found
    return None


def _guess_within(data: bytes, octets: np.ndarray, begin: int, span: int, order: str, capture: dict) -> int | None:
    word = lambda at: _words(octets, begin + at, span, capture["big_endian"])

    if capture["kind"] == "pcapng":
        kind, size = word(0), word(4)
        sound = np.isin(kind, [2, 3, 6]) & (size >= 16) & (size % 4 == 0) & (size <= GUESS_WINDOW)
        chain = _sound_blocks
    else:
        fraction, size, original = word(4), word(8), word(12)
        sound = fraction < (1000 * MICROS if capture["nanos"] else MICROS)
        sound &= (size > 0) & (size <= capture["snaplen"])
        sound &= (original >= size) & (original <= GUESS_WINDOW)
        chain = _sound_records
    for candidate in (np.flatnonzero(sound) + begin).tolist():
        if chain(data, candidate, order, capture):
            return candidate
    return None


def next_block(data: bytes, begin: int, order: str) -> int | None:
    """Offset of the first run of sound packet blocks at or after ``begin``."""
    capture = {"kind": "pcapng", "big_endian": order == ">"}
    for at in range(begin, len(data), GUESS_WINDOW):
        found = guess_start(memoryview(data)[at:], capture)
        if found is not None:
            return at + found
    return None


def sane_header(seconds: int, fraction: int, size: int, original: int, capture: dict, near: int | None) -> bool:
    """Whether the fields of a record header go together; ``near`` is the time of a packet before."""
    limit = 1000 * MICROS if capture["nanos"] else MICROS
    return fraction < limit and size <= capture["snaplen"] and size <= original <= GUESS_WINDOW and (near is None or abs(seconds - near) <= DAY)


def next_record(data: bytes, begin: int, capture: dict, end: int, near: int | None) -> int | None:
    """Offset, from ``begin`` on, of the first chain of RESYNC_RUN sound records, or one that ends at ``end``, the end of the file.

    Without any, of the longest shorter one that has two records or more.
    """
    unpack = struct.Struct((">" if capture["big_endian"] else "<") + "IIII").unpack_from
    best, most = None, 1
    for window, span in _looks(begin, len(data) - RECORD_HEADER):
        for candidate in _plausible(data, window, span, capture):
            at, run, last = candidate, 0, near
            while run < RESYNC_RUN and at + RECORD_HEADER <= len(data):
                seconds, fraction, size, original = unpack(data, at)
                if not size or not sane_header(seconds, fraction, size, original, capture, last) or at + RECORD_HEADER + size > end:
                    break
                at, run, last = at + RECORD_HEADER + size, run + 1, seconds
            if run == RESYNC_RUN or (run and at == end):
                return candidate
            if run > most:
                best, most = candidate, run
    return best


def _plausible(data: bytes, begin: int, span: int, capture: dict) -> list[int]:
    """Those of ``span`` offsets from ``begin`` on whose sixteen bytes may be a header."""
    octets = np.frombuffer(data, np.uint8)
    fraction, size, original = (_words(octets, begin + at, span, capture["big_endian"]) for at in (4, 8, 12))
    sound = fraction < (1000 * MICROS if capture["nanos"] else MICROS)
    sound &= (size > 0) & (size <= capture["snaplen"]) & (original >= size) & (original <= GUESS_WINDOW)
    return (np.flatnonzero(sound) + begin).tolist()


def _words(octets: np.ndarray, at: int, span: int, big_endian: bool) -> np.ndarray:
    """The 32-bit words that begin ``at`` bytes behind each of ``span`` places."""
    total = np.zeros(span, np.uint32)
    for shift, place in enumerate(range(at + 3, at - 1, -1) if big_endian else range(at, at + 4)):
        total |= octets[place : place + span].astype(np.uint32) << (8 * shift)
    return total


def complete_end(data: bytes, capture: dict, base: int, repair: bool) -> tuple[int, str]:
    """Where the last record ends that ``data``, the bytes of a growing file from ``base`` on, holds whole; the byte order there.

    Damage that a walk stops at (without ``repair``) counts as an end of its own, behind which it will
    say so; with ``repair`` it is waited for a sound block behind it.
    """
    order = ">" if capture["big_endian"] else "<"
    at = 0
    if capture["kind"] == "pcap":
        while at + RECORD_HEADER <= len(data):
            (size,) = struct.unpack_from(order + "I", data, at + 8)
            if repair and size > capture["snaplen"]:
                size = capture["snaplen"]
            if size > LARGEST_FRAME:
                return base + len(data), order
            if at + RECORD_HEADER + size > len(data):
                break
            at += RECORD_HEADER + size
        return base + at, order
    while at + 12 <= len(data):
        if data[at : at + 4] == SECTION_BLOCK_BYTES:
            order = "<" if data[at + 8 : at + 12] == SECTION_MAGIC_LE else ">"
        (size,) = struct.unpack_from(order + "I", data, at + 4)
        if size < 12 or size % 4 or size > LARGEST_FRAME:
            if not repair:
                return base + len(data), order
            found = next_block(data, at + 4, order)
            if found is None:
                break
            at = found
            continue
        if at + size > len(data):
            break
        at += size
    return base + at, order


def _sound_records(data: bytes, at: int, order: str, capture: dict) -> bool:
    unpack = struct.Struct(order + "IIII").unpack_from
    limit = 1000 * MICROS if capture["nanos"] else MICROS
    first = None
    for _ in range(GUESS_RUN):
        if at + RECORD_HEADER > len(data):
            break
        seconds, fraction, size, original = unpack(data, at)
        first = seconds if first is None else first
        sane = fraction < limit and 0 < size <= capture["snaplen"] and size <= original
        if not sane or abs(seconds - first) > 86_400:
            return False
        at += RECORD_HEADER + size
    return True


def _sound_blocks(data: bytes, at: int, order: str, capture: dict) -> bool:
    unpack = struct.Struct(order + "I").unpack_from
    for _ in range(GUESS_RUN):
        if at + 12 > len(data):
            break
        (size,) = unpack(data, at + 4)
        if size < 12 or size % 4:
            return False
        if at + size <= len(data) and unpack(data, at + size - 4)[0] != size:
            return False
        at += size
    return True
