"""Exact duplicates: frequent digests found by Misra-Gries are settled without a shuffle."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framedrift.llm.common import settle

COUNTERS = 256


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest): SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256((t or "").encode().lower()).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_key", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, digest binary")


def merge_counters(left: Counter, right: Counter, size: int) -> Counter:
    """Sum of two summaries, cut back to ``size`` counters by subtracting the next largest count."""
    both = left + right
    if len(both) <= size:
        return both
    cut = sorted(both.values(), reverse=True)[size]
    return Counter({k: n - cut for k, n in both.items() if n > cut})


def frequent(rows: DataFrame, column: str, size: int = COUNTERS) -> DataFrame:
    """At most ``size + 1`` values of a binary column, among them each that 2 / (size + 1) of all rows hold.

    A counter is below the true count by at most rows / (size + 1) of its task, so the sums over tasks
    are by at most rows / (size + 1) of all; no more than size + 1 values can reach such a sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            kept = merge_counters(kept, Counter(batch.column(0).to_pylist()), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["item", "low"]
        )

    found = rows.select(column).mapInArrow(run, "item binary, low long")
    return found.groupBy("item").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "item").limit(size + 1)


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: which of the equal texts stays.

    Equal means identical after lower-casing A-Z; null counts as empty. The largest key of a group
    stays. Frequent digests come from a Misra-Gries summary; their exact counts and winners (at most
    ``size + 1`` rows) are broadcast and mark their copies where they lie. All other digests are
    shuffled; none of them has more than about 2 / (size + 1) of the rows.

    Null keys never win over others. Rows that repeat the winning key with the same text are one
    document given twice: all of them count in ``group_size`` and are ``kept``. Long texts are hashed
    whole, an empty table gives no rows, and other columns are not read. Returns (key, keep_id, group_size, kept, text_sha256).
    """
    rows = settle(digests(docs, key, text))
    suspects = frequent(rows, "digest", size).select(F.col("item").alias("digest"))
    totals = [F.count("*").alias("group_size"), F.max("_key").alias("keep_id")]
    winners = settle(rows.join(F.broadcast(suspects), "digest").groupBy("digest").agg(*totals).where("group_size > 1"))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where(F.col("group_size").isNull()).select(
        "_key", "digest", F.count("*").over(same).alias("group_size"), F.max("_key").over(same).alias("keep_id")
    )
    return marked.where(F.col("group_size").isNotNull()).unionByName(rest).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
