"""Token packing by the sum-of-squares rule."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
OPEN_TOKENS = 4_000_000  # of a task's partly filled windows
END_ID = 0
ID = np.dtype("<u4")

#: Letters and marks beyond those that both tokenizer libraries cut alike, whatever their Unicode version.
RARE = re.compile(r"[^\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]")


class Encoder:
    """Token ids by ``tokenizers``; others than rare and special ones take the same vocabulary as ranks, three times faster."""

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.plain = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            pairs = [line.split() for line in open(ranks, "rb")]
            self.plain = tiktoken.Encoding(
                "plain", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self.plain and "<|" not in text and not RARE.search(text):
            return np.array(self.plain.encode_ordinary(text), dtype=ID)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=ID)


class Piece:
    """``ids`` of a document from token ``start`` on; ``row`` is (key, tokens of the document)."""

    __slots__ = ("row", "start", "ids")

    def __init__(self, row: tuple, start: int, ids: np.ndarray):
        self.row, self.start, self.ids = row, start, ids


class Packer:
    """Partly filled windows by fill level.

    ``counts[h]`` windows are filled to level h. A piece goes to the level that leaves the least sum
    of squared counts over the partly filled levels; a full window no longer counts. Level 0 stands
    for a new window. Ties go to the fullest window.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.open_tokens = 0
        self.counts = np.zeros(self.capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.capacity)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """The window of the piece, if that is full now."""
        size, full = len(piece.ids), self.capacity
        if size == full:
            return [piece]
        # Change of the sum for a window of level h: it leaves level h and reaches level h + size.
        change = 2 * self.counts[size : full + 1] + 1
        change[-1] = 0
        change[1:] -= np.where(self.counts[1 : full - size + 1] > 0, 2 * self.counts[1 : full - size + 1] - 1, -(1 << 60))
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.windows[level].pop() if level else []
        self.counts[level] -= level > 0
        window.append(piece)
        self.open_tokens += size
        if level + size == full:
            self.open_tokens -= full
            return window
        self.windows[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def fill_up(self) -> list[list[Piece]]:
        """Full windows made of the open ones by cuts; the one that stays partly filled stays open."""
        left = list(self.finish())
        self.clear()
        if left and sum(len(p.ids) for p in left[-1]) < self.capacity:
            window = left.pop()
            level = self.open_tokens = sum(len(p.ids) for p in window)
            self.windows[level].append(window)
            self.counts[level] += 1
        return left

    def finish(self) -> Iterator[list[Piece]]:
        """The windows left over, the fullest filled up with cuts from the emptiest: one at most stays partly filled."""
        left = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.windows[h]]
        first, last = 0, len(left) - 1
        while first <= last:
            fill, window = left[first]
            while fill < self.capacity and first < last:
                donor = left[last][1]
                piece = donor.pop()
                keep = max(0, len(piece.ids) - (self.capacity - fill))
                if keep:
                    donor.append(Piece(piece.row, piece.start, piece.ids[:keep]))
                moved = Piece(piece.row, piece.start + keep, piece.ids[keep:])
                window.append(moved)
                fill += len(moved.ids)
                last -= not donor
            yield window
            first += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
    open_tokens: int = OPEN_TOKENS,
) -> DataFrame:
    """Pack all documents into windows of ``capacity`` tokens; one row per piece of a document.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read, and ``ranks``, if
    given, that of the same vocabulary as ranks. A document is its tokens and then END_ID. Whole windows are cut off long documents; what is left goes to a partly
    filled window by the sum-of-squares rule. Each task packs the rows it reads, in their order, with
    only its partly filled windows in memory. Where no two pieces fit, these would be all it has read: once
    they hold more than ``open_tokens``, the fullest are filled up with cuts from the emptiest, as at the
    end of the task, so a task pads one window at most. A task that
    is run again packs the same rows the same way; the input should be a stored table.

    Null and empty texts are one END_ID. Repeated rows are packed as often as they occur. Null keys are
    kept. Other columns are not read; an empty table gives no rows. ``sequence_id`` is unique over all
    tasks. Returns (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and token_ids if
    ``with_ids``.
    """
    kind = docs.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", token_ids array<int>" if with_ids else ""

    def rows_of(windows: list[list[Piece]], first: int, key_type: pa.DataType) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for n, window in enumerate(windows):
            offset = 0
            for p in window:
                row = (p.row[0], p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.row[1], first + n, offset, p.ids)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
                offset += len(p.ids)
        arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer, ranks), Packer(capacity)
        number = TaskContext.get().partitionId() << 32
        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            full = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(t or ""), np.array([END_ID], ID))
                for at in range(0, len(ids), capacity):
                    done = packer.place(Piece((k, len(ids)), at, ids[at : at + capacity]))
                    if done:
                        full.append(done)
                if packer.open_tokens > open_tokens:
                    full += packer.fill_up()
            yield rows_of(full, number, key_type)
            number += len(full)
        yield rows_of(list(packer.finish()), number, key_type)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
