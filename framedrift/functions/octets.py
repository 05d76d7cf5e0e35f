"""Unsigned integers in BINARY columns, and ones' complement sums over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def opaque(column: Column) -> Column:
    """The same value, but never inlined into filters above.

    Spark moves a filter below the projections it depends on by substituting their
    expressions; through a long chain of projections that multiplies. An expression that
    counts as non-deterministic stops it.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def hex_uint(hexed: Column, offset: int | Column, width: int) -> Column:
    """Big-endian unsigned integer at byte ``offset`` of a hex string; null past its end."""
    start = _as_column(offset) * 2 + 1
    return F.conv(F.substr(hexed, start, F.lit(2 * width)), 16, 10).cast("long")


def hex_uint_le(hexed: Column, offset: int, width: int) -> Column:
    """Little-endian counterpart of :func:`hex_uint`."""
    pairs = [F.substring(hexed, 2 * (offset + i) + 1, 2) for i in reversed(range(width))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def put_uint(data: Column, offset: int | Column, value: Column, width: int) -> Column:
    """``data`` with a big-endian integer written over ``width`` bytes at ``offset``."""
    encoded = F.unhex(F.lpad(F.hex(value), 2 * width, "0"))
    return F.overlay(data, encoded, _as_column(offset) + 1, width)


def pad_to(data: Column, length: int | Column, pad: bytes) -> Column:
    """``data`` cut or filled with ``pad`` to exactly ``length`` bytes."""
    return F.rpad(data, _as_column(length).cast("int"), F.lit(bytes(pad)))


def word_sum_native(data: Column) -> Column:
    """Sum of big-endian 16-bit words modulo 65535, as SQL expressions only.

    Six bytes are taken at a time, which is the same sum because 2^16 = 1 mod 65535.
    """
    blocks = F.ceil(F.length(data) / 6).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))),
        F.lit(0).cast("long"),
        lambda acc, i: (
            acc
            + F.conv(
                F.rpad(F.hex(F.substr(data, i * 6 + 1, F.lit(6))), 12, "0"), 16, 10
            ).cast("long")
        )
        % 65535,
    )
    return F.when(F.length(data) > 0, total).when(F.length(data) == 0, F.lit(0).cast("long"))


def _word_sums(data: pa.Array) -> pa.Array:
    """Word sums of a whole Arrow batch with one pass over its byte buffer."""
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    if len(data) == data.null_count:
        return pa.nulls(len(data), pa.int64())
    data = data.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    octets = np.frombuffer(data.buffers()[2], np.uint8, end) if end else np.zeros(0, np.uint8)
    weighted = np.zeros(end - begin + 1, np.uint16)
    weighted[:-1] = octets[begin:]
    weighted[:-1:2] <<= 8
    starts = offsets[:-1] - begin
    sums = np.add.reduceat(weighted, starts, dtype=np.int64) % 65535
    # A row that starts on an odd byte has its high and low bytes exchanged.
    sums = np.where(starts % 2 == 1, sums * 256 % 65535, sums)
    sums[offsets[:-1] == offsets[1:]] = 0
    return pa.array(sums, pa.int64(), mask=np.asarray(data.is_null()) if data.null_count else None)


@F.arrow_udf(T.LongType())
def word_sum(data: pa.Array) -> pa.Array:
    """Sum of big-endian 16-bit words modulo 65535, over Arrow batches."""
    return _word_sums(data)
