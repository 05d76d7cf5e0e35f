"""Ethernet / IPv4 / IPv6 / TCP / UDP frames as columns: decode, edit, repair checksums.

Functions take and return DataFrames with the packet columns ``frame`` (BINARY) and
``linktype``. Offsets are 0-based bytes from the start of the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.functions.octets import (
    hex_uint,
    opaque,
    pad_to,
    put_uint,
    word_sum,
    word_sum_native,
)

# Fixed values of the protocols.
LINKTYPE_ETHERNET = 1
ETHERNET_HEADER = 14
VLAN_TAG = 4
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_ARP = 0x0806
ETHERTYPE_VLAN = 0x8100
ETHERTYPE_QINQ = 0x88A8
ETHERTYPE_IPV6 = 0x86DD
PROTO_ICMP = 1
PROTO_TCP = 6
PROTO_UDP = 17
# Headers that name a next one: hop-by-hop, routing, fragment, authentication, destination, mobility, HIP, shim6.
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION = 0, 43, 44, 51, 60
CHAINED = (HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION, 135, 139, 140)
SEGMENT_ROUTING = 4  # the routing type that lists its last stop first
IPV6_HEADER = 40
UDP_HEADER = 8
TCP_HEADER = 20
ICMP_HEADER = 8
# Two VLAN tags, the longest IPv4 header and a TCP header without options.
HEADER_BYTES = ETHERNET_HEADER + 2 * VLAN_TAG + 60 + TCP_HEADER
DEFAULT_DUMMY = 32
USUAL_CHAIN = 8  # headers of a chain; longer ones are walked as well
CHECKSUM_WAYS = ("recompute", "update")

_DECODING = ["_hex", "_len", "_tags", "_inner", "_eth", "_l3", "_w0", "_w1", "_w2", "_v4", "_v6"]
_DECODING += ["_l4", "_total", "_proto", "_first", "_seq", "_words", "_end", "_tcp", "_udp", "_pay"]
_DECODING += ["_chain", "_dst", "_l4_head"]


def _chain_end(frame: Column, length: Column, start: Column, proto: Column) -> Column:
    """(at, proto, first, dst): where a chain of extension headers ends, and what follows it.

    Each header names the next one and its own size, so this is a fold whose state is the place; it
    stands still once the protocol is no chained header, or the frame ends within one. ``first`` is
    false behind a fragment header with an offset. ``dst`` is where the last stop of a routing header
    with segments left stands, which is the destination that checksums are taken over.
    """

    def step(state: Column, _: Column) -> Column:
        at, kind = state["at"], state["proto"]
        head = F.hex(F.substr(frame, at + 1, F.lit(8)))
        field = lambda offset, width=1: hex_uint(head, offset, width).cast("int")
        size = F.when(kind == FRAGMENT, 8).when(kind == AUTHENTICATION, (field(1) + 2) * 4).otherwise((field(1) + 1) * 8)
        moves = state["first"] & kind.isin(*CHAINED) & (at + 8 <= length)
        moves = moves & (at + F.coalesce(size, F.lit(0)) <= length)
        stops = F.floor((size - 8) / 16).cast("int")
        routed = (kind == ROUTING) & (field(3) > 0) & (stops > 0) & state["dst"].isNull()
        last_stop = at + 8 + F.when(field(2) == SEGMENT_ROUTING, 0).otherwise(16 * (stops - 1))
        later = (kind == FRAGMENT) & (field(2, 2) >= 8)
        return F.when(
            moves,
            F.struct(
                (at + size).cast("int").alias("at"),
                field(0).alias("proto"),
                (~later).alias("first"),
                F.when(routed, last_stop).otherwise(state["dst"]).cast("int").alias("dst"),
            ),
        ).otherwise(state)

    begin = F.struct(
        start.cast("int").alias("at"), proto.cast("int").alias("proto"), F.lit(True).alias("first"), F.lit(None).cast("int").alias("dst")
    )
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(USUAL_CHAIN)), begin, step)
    # No chain has more headers than eights of bytes; the fold only goes that far where the usual one was not enough.
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(length / 8).cast("int"), F.lit(1))), begin, step)
    return F.when(usual["first"] & usual["proto"].isin(*CHAINED), whole).otherwise(usual)


def with_header(df: DataFrame, only: Column | None = None) -> DataFrame:
    """Add ``hdr``: where the layers of each frame lie, and the fields the edits need.

    Null for frames that are not Ethernet or too short for an Ethernet header, and where
    ``only`` is not true. The stages are separate projections, so that each offset is
    computed once; several fields are cut out of one decoded word.
    """
    c = F.col
    decodable = (c("linktype") == LINKTYPE_ETHERNET) & (F.length("frame") >= ETHERNET_HEADER)
    if only is not None:
        decodable = decodable & only
    head = F.hex(F.substring("frame", 1, HEADER_BYTES))
    # Fields beyond the end of a short frame read as zero; the length checks exclude them.
    df = df.withColumns(
        {"_hex": F.when(decodable, F.rpad(head, 2 * HEADER_BYTES, "0")), "_len": F.length("frame")}
    )
    word = lambda offset, width=4: hex_uint(c("_hex"), offset, width)
    low16 = lambda value: value.bitwiseAND(0xFFFF)
    tagged = lambda ethertype: ethertype.isin(ETHERTYPE_VLAN, ETHERTYPE_QINQ)

    df = df.withColumns({"_tags": word(12, 6), "_inner": word(20, 2)})
    outer, second = F.shiftright("_tags", 32), low16(c("_tags"))
    df = df.withColumns(
        {
            "_eth": F.when(~tagged(outer), outer)
            .when(tagged(second), c("_inner"))
            .otherwise(second),
            "_l3": F.when(~tagged(outer), ETHERNET_HEADER)
            .when(tagged(second), ETHERNET_HEADER + 2 * VLAN_TAG)
            .otherwise(ETHERNET_HEADER + VLAN_TAG),
        }
    )
    df = df.withColumns({f"_w{i}": word(c("_l3") + 4 * i) for i in range(3)})
    version = F.shiftright("_w0", 28)
    ihl = F.shiftright("_w0", 24).bitwiseAND(15).cast("int") * 4
    df = df.withColumns(
        {
            "_v4": (c("_eth") == ETHERTYPE_IPV4)
            & (version == 4)
            & (ihl >= 20)
            & (c("_len") >= c("_l3") + ihl),
            "_v6": (c("_eth") == ETHERTYPE_IPV6)
            & (version == 6)
            & (c("_len") >= c("_l3") + IPV6_HEADER),
        }
    )
    df = df.withColumns(
        {
            "_l4": c("_l3") + F.when(c("_v4"), ihl).when(c("_v6"), IPV6_HEADER),
            "_total": F.when(c("_v4"), low16(c("_w0")))
            .when(c("_v6"), F.shiftright("_w1", 16) + IPV6_HEADER)
            .cast("int"),
            "_proto": F.when(c("_v4"), F.shiftright("_w2", 16))
            .when(c("_v6"), F.shiftright("_w1", 8))
            .bitwiseAND(0xFF)
            .cast("int"),
            # Only the first fragment of a datagram has a TCP or UDP header.
            "_first": c("_v6") | (c("_w1").bitwiseAND(0x1FFF) == 0),
        }
    )
    chained = (c("_v6") & c("_proto").isin(*CHAINED)) | (c("_v4") & c("_first") & (c("_proto") == AUTHENTICATION))
    df = df.withColumn("_chain", F.when(chained, _chain_end(c("frame"), c("_len"), c("_l4"), c("_proto"))))
    found = c("_chain").isNotNull()
    df = df.withColumns(
        {
            "_l4": F.when(found, c("_chain.at")).otherwise(c("_l4")),
            "_proto": F.when(found, c("_chain.proto")).otherwise(c("_proto")),
            "_first": F.when(found, c("_chain.first")).otherwise(c("_first")),
            "_dst": c("_chain.dst"),
        }
    )
    beyond = F.rpad(F.hex(F.substr("frame", c("_l4") + 1, F.lit(TCP_HEADER))), 2 * TCP_HEADER, F.lit("0"))
    near = F.substr("_hex", c("_l4") * 2 + 1, F.lit(2 * TCP_HEADER))
    df = df.withColumn("_l4_head", F.when(found, beyond).otherwise(near))
    # A total length that leaves nothing behind its header means "as long as the frame".
    smallest = F.when(c("_v4"), ihl).otherwise(IPV6_HEADER + 1)
    df = df.withColumns(
        {
            "_seq": hex_uint(c("_l4_head"), 4, 4),
            "_words": F.conv(F.substring("_l4_head", 25, 1), 16, 10).cast("int"),
            "_end": F.when(
                c("_total") >= smallest, F.least(c("_len"), c("_l3") + c("_total"))
            ).otherwise(c("_len")),
        }
    )
    room = F.when(c("_first"), c("_end") - c("_l4"))
    df = df.withColumns(
        {
            "_tcp": F.coalesce(
                (c("_proto") == PROTO_TCP) & (room >= TCP_HEADER) & (c("_words") >= 5),
                F.lit(False),
            ),
            "_udp": F.coalesce((c("_proto") == PROTO_UDP) & (room >= UDP_HEADER), F.lit(False)),
        }
    )
    icmp = c("_v4") & c("_first") & (c("_proto") == PROTO_ICMP)
    payload = (
        F.when(c("_tcp"), c("_l4") + c("_words") * 4)
        .when(c("_udp"), c("_l4") + UDP_HEADER)
        .when(icmp, c("_l4") + ICMP_HEADER)
        .when(c("_v4") | c("_v6"), c("_l4"))
        .when(c("_eth") == ETHERTYPE_ARP, c("_len"))
        .otherwise(c("_l3"))
    )
    df = df.withColumn("_pay", F.least(payload, c("_end")))
    header = F.struct(
        c("_eth").cast("int").alias("eth_type"),
        c("_l3").alias("l3_off"),
        (c("_l4") - c("_l3")).alias("ihl"),
        c("_total").alias("ip_total_len"),
        c("_proto").alias("proto"),
        c("_l4").alias("l4_off"),
        F.when(c("_tcp"), c("_seq")).alias("tcp_seq"),
        c("_pay").alias("payload_off"),
        (c("_end") - c("_pay")).alias("payload_len"),
        (c("_v4") | c("_v6")).alias("has_ip"),
        c("_v4").alias("is_v4"),
        c("_tcp").alias("has_tcp"),
        c("_udp").alias("has_udp"),
        F.when(c("_v4"), ihl).when(c("_v6"), IPV6_HEADER).alias("ip_head"),
        c("_dst").alias("dst_off"),
    )
    return df.withColumn("hdr", opaque(F.when(c("_hex").isNotNull(), header))).drop(*_DECODING)


def checksum_of(word_total: Column) -> Column:
    """Complement of a non-empty word sum taken modulo 65535."""
    return (65535 - word_total % 65535) % 65535


def ip_header_checksum(header: Column) -> Column:
    """Checksum of an IPv4 header (BINARY), its checksum field counting as zero."""
    return checksum_of(word_sum_native(header) + 65535 - hex_uint(F.hex(header), 10, 2))


def _repair(df: DataFrame, end: Column, lengths: str | None, native: bool) -> DataFrame:
    """Length and checksum fields of frames flagged ``_edit``; ``end`` is the end of the payload.

    Word sums are taken once, over the IPv4 header and over addresses and segment. They are
    an Arrow UDF that gets nulls for frames not flagged, or SQL expressions if ``native``.
    What the new length fields and the stale checksums change in them is plain arithmetic.
    """
    c = F.col
    l3, l4, is_v4 = c("hdr.l3_off"), c("hdr.l4_off"), c("hdr.is_v4")
    has_l4 = c("hdr.has_tcp") | c("hdr.has_udp")
    summed = word_sum_native if native else word_sum
    frame = c("frame")
    routed = F.concat(F.substr(frame, l3 + 9, F.lit(16)), F.substr(frame, c("hdr.dst_off") + 1, F.lit(16)))
    addresses = (
        F.when(is_v4, F.substr(frame, l3 + 13, F.lit(8)))
        .when(c("hdr.dst_off").isNotNull(), routed)
        .otherwise(F.substr(frame, l3 + 9, F.lit(32)))
    )
    df = df.withColumn("_end", F.when(c("_edit"), end))
    df = df.withColumns(
        {
            "_head": F.when(c("_edit") & is_v4, F.substr(frame, l3 + 1, c("hdr.ip_head"))),
            "_segment": F.when(
                c("_edit") & has_l4,
                F.concat(addresses, F.substr(frame, l4 + 1, c("_end") - l4)),
            ),
            "_field": l4 + F.when(c("hdr.has_tcp"), 16).otherwise(6),
        }
    )
    df = df.withColumns({"_head_sum": summed(c("_head")), "_sum": summed(c("_segment"))})
    stale = lambda data, offset: hex_uint(F.hex(F.substr(data, offset + 1, F.lit(2))), 0, 2)
    df = df.withColumns(
        {
            "_head_stale": stale(c("_head"), F.lit(10)),
            "_stale": stale(c("_segment"), c("_field") - l4 + F.when(is_v4, 8).otherwise(32)),
            "_l4_size": c("_end") - l4,
        }
    )
    sixteen_bits = lambda size: F.when(size > 65535, F.lit(0)).otherwise(size)
    df = df.withColumns({"_total": c("hdr.ip_total_len"), "_udp_len": F.lit(None).cast("int")})
    if lengths is not None:
        total = sixteen_bits(c("_end") - l3)
        v6_total = sixteen_bits(c("_end") - l3 - IPV6_HEADER)
        df = df.withColumn("_total", F.when(is_v4, total).otherwise(v6_total))
        if lengths == "all":
            df = df.withColumns(
                {
                    "_udp_len": F.when(c("hdr.has_udp"), sixteen_bits(c("_l4_size"))),
                    "_stale": c("_stale")
                    + F.when(c("hdr.has_udp"), stale(c("_segment"), 4 + F.when(is_v4, 8).otherwise(32)))
                    .otherwise(0),
                }
            )
    ip_sum = c("_head_sum") - c("_head_stale") - c("hdr.ip_total_len") + c("_total")
    value = c("_sum") - c("_stale") + c("hdr.proto") + c("_l4_size") + F.coalesce("_udp_len", F.lit(0))
    df = df.withColumns(
        {
            "_ip_check": checksum_of(ip_sum + 3 * 65535),
            "_check": checksum_of(value + 3 * 65535),
        }
    )
    udp_zero = c("hdr.has_udp") & (c("_check") == 0)

    def write(df: DataFrame, where: Column, offset: Column, value: Column) -> DataFrame:
        changed = put_uint(frame, offset, value, 2)
        return df.withColumn("frame", F.when(c("_edit") & where, changed).otherwise(frame))

    if lengths is not None:
        rewritten = c("hdr.has_ip") if lengths == "all" else is_v4
        df = write(df, rewritten, l3 + F.when(is_v4, 2).otherwise(4), c("_total"))
        df = write(df, c("_udp_len").isNotNull(), l4 + 4, c("_udp_len"))
    df = write(df, is_v4, l3 + 10, c("_ip_check"))
    df = write(df, has_l4, c("_field"), F.when(udp_zero, 65535).otherwise(c("_check")))
    df = df.withColumn("frame", opaque(frame))
    scratch = ["_end", "_head", "_segment", "_field", "_head_sum", "_sum", "_head_stale", "_stale"]
    return df.drop(*scratch, "_l4_size", "_total", "_udp_len", "_ip_check", "_check")


def payload_end() -> Column:
    """End of the payload; later bytes are link padding."""
    return F.col("hdr.payload_off") + F.col("hdr.payload_len")


def updated_checksum(checksum: Column, old: list[Column], new: list[Column]) -> Column:
    """Checksum after some of the 16-bit words below it changed, from the words alone.

    A right checksum stays right, and a wrong one stays wrong by as much.
    """
    change = sum((n + 65535 - o for o, n in zip(old, new, strict=True)), F.lit(0))
    return checksum_of(65535 - checksum + change + 65535)


def _words(value: Column) -> list[Column]:
    return [F.shiftright(value, 16), value.bitwiseAND(0xFFFF)]


def shift_sequence(df: DataFrame, flag: str, offset: int, native: bool = False, checksums: str = "recompute") -> DataFrame:
    """Add ``offset`` (mod 2^32) to the TCP sequence number of flagged frames, repair checksums.

    ``flag`` is narrowed to the frames that were edited. ``checksums='recompute'`` sums up headers and
    segments, so that wrong checksums become right. ``'update'`` works the new TCP checksum out from the
    old one and the two words that change: it reads no payload and needs no Python, gives the same on
    frames with right checksums, and leaves wrong ones wrong.
    """
    if checksums not in CHECKSUM_WAYS:
        raise ValueError(f"checksums must be one of {CHECKSUM_WAYS}, not {checksums!r}")
    df = with_header(df, F.col(flag))
    shifted = F.pmod(F.col("hdr.tcp_seq") + F.lit(int(offset)), F.lit(1 << 32))
    l4 = F.col("hdr.l4_off")
    edited = put_uint(F.col("frame"), l4 + 4, shifted, 4)
    df = df.withColumn("_edit", F.coalesce(F.col("hdr.has_tcp"), F.lit(False)))
    if checksums == "update":
        held = hex_uint(F.hex(F.substr("frame", l4 + 17, F.lit(2))), 0, 2)
        check = updated_checksum(held, _words(F.col("hdr.tcp_seq")), _words(shifted))
        edited = put_uint(edited, l4 + 16, check, 2)
    df = df.withColumn("frame", F.when(F.col("_edit"), edited).otherwise(F.col("frame")))
    if checksums == "recompute":
        df = _repair(df, payload_end(), None, native)
    return df.withColumn(flag, F.col("_edit")).drop("_edit", "hdr")


def forged_length(length: Column, new_len: int | None) -> Column:
    """Target payload length: ``new_len``, else half as long again; a dummy where there is none."""
    if new_len:
        return F.lit(int(new_len))
    grown = F.greatest(F.lit(1), F.floor(length * 1.5).cast("int"))
    return F.when(length > 0, grown).otherwise(DEFAULT_DUMMY)


def forge_payload(payload: Column, new_len: int | None = None, pad: bytes = b"\x00") -> Column:
    """Payload cut or padded to its forged length."""
    return pad_to(payload, forged_length(F.length(payload), new_len), pad)


def forge_length(
    df: DataFrame,
    flag: str,
    new_len: int | None = None,
    pad: bytes = b"\x00",
    lengths: str = "all",
    native: bool = False,
) -> DataFrame:
    """Forge the payload length of flagged frames, then repair lengths and checksums.

    ``flag`` is narrowed to the frames that were edited. ``lengths='all'`` rewrites the IPv4, IPv6 and UDP length fields, ``'ipv4'`` only the
    first. A length beyond 16 bits is written as 0. Link padding stays at the end.
    """
    if lengths not in ("all", "ipv4"):
        raise ValueError(f"lengths must be 'all' or 'ipv4', not {lengths!r}")
    df = with_header(df, F.col(flag))
    start, frame = F.col("hdr.payload_off"), F.col("frame")
    df = df.withColumns(
        {
            "_edit": F.col("hdr").isNotNull(),
            "_forged": forged_length(F.col("hdr.payload_len"), new_len),
        }
    )
    forged = F.concat(
        F.substr(frame, F.lit(1), start),
        pad_to(F.substr(frame, start + 1, F.col("hdr.payload_len")), F.col("_forged"), pad),
        F.substr(frame, payload_end() + 1, F.length(frame)),
    )
    df = df.withColumn("frame", F.when(F.col("_edit"), forged).otherwise(frame))
    df = _repair(df, start + F.col("_forged"), lengths, native)
    return df.withColumn(flag, F.col("_edit")).drop("_edit", "_forged", "hdr")
