"""Collocations: phrases that are frequent beyond their parts, from count streams in prefix and suffix order."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framedrift.llm.common import blank_null, settle
from framedrift.sources.files import broadcast_if_small

LEAST = 100
LONGEST = 5
REPORTED = 2000
NO_LANGUAGE = "und"
SEED = 42
TOKEN = re.compile(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+")
STOP = re.compile(rb"[.,;:!?\x0a-\x0d]")
STOPS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
FILTER_BITS = 24
SLOT_BITS = 40  # of a pair's hash: pairs that share a slot are counted together, and only found frequent too often
BUCKET_BITS = 12  # of a slot, by which its counts are dealt to tasks
SLOTS_HELD = 4_000_000  # by a task, before it hands their counts on
BLOCK_TOKENS = 2_000_000  # counted together
PIECE_BYTES = 1 << 20  # of a long text, cut into tokens at once
CACHED = 1_000_000  # words a task keeps numbers for from one block to the next
WORDS = [f"w{i}" for i in range(LONGEST)]
ABSENT = b""  # of words beyond the end; sorts first


class Numbers:
    """Numbers of the words of one language within a task; 0 is whatever ends a piece."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
        self.index = dict.fromkeys(STOPS, 0)
        self.words = [ABSENT]
        self.hash = np.zeros(1, np.uint64)
        self.held: list[np.ndarray] = []

    def read(self, text: bytes) -> int:
        """Numbers of the tokens of a text, with a piece's end behind; how many there are."""
        begin, size = 0, 0
        while begin < len(text):
            stop = STOP.search(text, begin + PIECE_BYTES)
            end = stop.end() if stop else len(text)
            tokens = TOKEN.findall(text[begin:end].lower())
            begin = end
            for word in set(tokens).difference(self.index):
                self.index[word] = len(self.words)
                self.words.append(word)
            self.held.append(np.fromiter(map(self.index.__getitem__, tokens), np.int32, len(tokens)))
            size += len(tokens)
        self.held.append(np.zeros(1, np.int32))
        return size + 1

    def take(self) -> np.ndarray:
        ids, self.held = np.concatenate(self.held), []
        return ids

    def hashes(self) -> np.ndarray:
        """As ``xxhash64(lang, word)``."""
        new = [xxhash.xxh64_intdigest(w, self.seed) for w in self.words[len(self.hash) :]]
        self.hash = np.append(self.hash, np.array(new, np.uint64))
        return self.hash


def pair_slots(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Slot of each pair of neighbours, by their hashes."""
    return ((h[ids[:-1]] << np.uint64(1)) ^ h[ids[1:]]) >> np.uint64(64 - SLOT_BITS)


def word_pairs(numbers: Numbers, ids: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of pairs of neighbours that both are in the table of frequent words, possibly with others, and their counts."""
    h = numbers.hashes()
    fits = frequent[h >> np.uint64(64 - FILTER_BITS)] & (np.arange(len(numbers.words)) > 0)
    slots = pair_slots(h, ids)[fits[ids[:-1]] & fits[ids[1:]]]
    return np.unique(slots.astype(np.int64), return_counts=True)


def windows(numbers: Numbers, ids: np.ndarray, frequent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """From each word on, the longest run of frequent pairs up to LONGEST words, if it has two or more."""
    goes_on = frequent[pair_slots(numbers.hashes(), ids) >> np.uint64(SLOT_BITS - FILTER_BITS)] & (ids[:-1] > 0) & (ids[1:] > 0)
    goes_on = np.append(goes_on, np.zeros(LONGEST, bool))
    ids = np.append(ids, np.zeros(LONGEST, np.int32)).astype(np.int64)
    at = np.flatnonzero(goes_on)
    columns = [ids[at], ids[at + 1]]
    whole = np.ones(len(at), bool)
    for i in range(2, LONGEST):
        whole &= goes_on[at + i - 1]
        columns.append(np.where(whole, ids[at + i], 0))
    keys = [columns[0] << 32 | columns[1], columns[2] << 32 | columns[3], columns[4]]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(first, append=len(order))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by slot."""
    slots, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])[: len(slots)])
    return slots[first], np.add.reduceat(counts[order], first) if len(first) else counts


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Numbers]]:
    """Languages and numbered words of rows (lang, text), whenever there are BLOCK_TOKENS, and at the end."""
    known: dict[str, Numbers] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if lang not in known:
                known[lang] = Numbers(lang)
            size += known[lang].read(text)
            if size >= BLOCK_TOKENS:
                yield from ((x, n) for x, n in known.items() if n.held)
                size = 0
                if sum(len(n.words) for n in known.values()) > CACHED:
                    known = {}
    yield from ((x, n) for x, n in known.items() if n.held)


def unpacked(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(table, bitorder="little").view(bool)


def counted_rows(lang: str, numbers: Numbers, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Rows (lang, w0 .. w4, n) of word numbers and counts."""
    words = pa.array(numbers.words, pa.binary())
    columns = [words.take(pa.array(c)) for c in columns]
    columns += [pa.array([ABSENT], pa.binary()).take(pa.array(np.zeros(len(counts), np.int64)))] * (LONGEST - len(columns))
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int64)))
    return pa.RecordBatch.from_arrays([langs, *columns, pa.array(counts.astype(np.int64))], ["lang", *WORDS, "n"])


COUNTED = ", ".join(["lang string", *[f"{w} binary" for w in WORDS], "n long"])


def word_counts(rows: DataFrame) -> DataFrame:
    """Partial counts (lang, w0, n) of words: one for each task, as long as it keeps their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, np.ndarray]] = {}

        def counted(lang: str) -> pa.RecordBatch:
            numbers, counts = held[lang]
            found = np.flatnonzero(counts[1:]) + 1
            return counted_rows(lang, numbers, [found], counts[found])

        for lang, numbers in blocks(batches):
            if lang in held and held[lang][0] is not numbers:
                yield counted(lang)
                del held[lang]
            counts = np.bincount(numbers.take(), minlength=len(numbers.words))
            if lang in held:
                before = held[lang][1]
                counts[: len(before)] += before
            held[lang] = numbers, counts
        for lang in held:
            yield counted(lang)

    return rows.select("lang", "text").mapInArrow(run, COUNTED)


def window_counts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Partial counts (lang, w0 .. w4, n) of windows; ``table`` is the packed bit table of pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = unpacked(shared.value)
        for lang, numbers in blocks(batches):
            yield counted_rows(lang, numbers, *windows(numbers, numbers.take(), frequent))

    return rows.select("lang", "text").mapInArrow(run, COUNTED)


def packed(slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted slots and their counts as one row (bucket, slots, counts) for each bucket, by the leading bits of the slot.

    Within a bucket slots are gaps; both are numbers of few bytes, and compressed.
    """
    bucket = slots >> (SLOT_BITS - BUCKET_BITS)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(slots)])
    gaps = np.diff(slots, prepend=0)
    gaps[first] = slots[first] & ((1 << (SLOT_BITS - BUCKET_BITS)) - 1)
    ends = np.append(first[1:], len(slots))[: len(first)]
    cells = [[_squeezed(x[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)] for x in (gaps, counts)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *[pa.array(c, pa.binary()) for c in cells]], ["bucket", "slots", "counts"])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, low bytes first by place, so that the high ones, mostly zero, compress."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def pair_counts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Partial counts, as ``packed``, of the pairs of neighbours of frequent words."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = unpacked(shared.value)
        held, size = [], 0
        for _, numbers in blocks(batches):
            held.append(word_pairs(numbers, numbers.take(), frequent))
            size += len(held[-1][0])
            if size > 2 * SLOTS_HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > SLOTS_HELD:
                    yield packed(*held[0])
                    held, size = [], 0
        if held:
            yield packed(*merged(held))

    return rows.select("lang", "text").mapInArrow(run, "bucket long, slots binary, counts binary")


def frequent_slots(partial: DataFrame, least: int) -> DataFrame:
    """Slots with ``least`` pairs or more, from ``packed`` partial counts: summed bucket by bucket in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def summed() -> pa.RecordBatch:
            slots, counts = merged(held)
            return pa.RecordBatch.from_arrays([pa.array(slots[counts >= least] + (current << (SLOT_BITS - BUCKET_BITS)))], ["slot"])

        for batch in batches:
            for bucket, slots, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and bucket != current:
                    yield summed()
                    held = []
                current = bucket
                held.append((np.cumsum(_unsqueezed(slots)), _unsqueezed(counts)))
                if sum(len(s) for s, _ in held) > 2 * SLOTS_HELD:
                    held = [merged(held)]
        if held:
            yield summed()

    return partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slot long")


def bit_table(slot: Column, bits: int, rows: DataFrame) -> np.ndarray:
    """Packed table of 2^FILTER_BITS bits, set at the leading bits of ``slot``, which has ``bits``: of one size whatever the rows."""
    place = F.shiftrightunsigned(slot, bits - FILTER_BITS)
    words = rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    words = words.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def _changes(columns: list[pa.Array]) -> list[np.ndarray]:
    """For each column, where it or one before it differs from the row before."""
    out, so_far = [], None
    for c in columns:
        new = np.ones(len(c), bool)
        new[1:] = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        so_far = new if so_far is None else so_far | new
        out.append(so_far)
    return out


def prefix_counts(sorted_windows: DataFrame, least: int) -> DataFrame:
    """Phrases of two words and more with ``least`` occurrences, from windows in prefix order.

    Every occurrence of a phrase begins just one window, so a phrase's count is the sum over a run of
    the stream. What may go on in the next batch, the last run of two words, is carried over.
    """

    def summed(rows: pa.Table, size: int) -> pa.RecordBatch:
        columns = [rows[c].combine_chunks() for c in ["lang", *WORDS]]
        first = np.flatnonzero(_changes(columns[: size + 1])[-1])
        n = np.add.reduceat(rows["n"].to_numpy(), first)
        keep = (n >= least) & pc.not_equal(columns[size], ABSENT).to_numpy(zero_copy_only=False)[first]
        at = pa.array(first[keep])
        nothing = pa.array([ABSENT], pa.binary()).take(pa.array(np.zeros(len(at), np.int64)))
        words = [c.take(at) for c in columns[1 : size + 1]] + [nothing] * (LONGEST - size)
        return pa.RecordBatch.from_arrays([columns[0].take(at), *words, pa.array(n[keep])], ["lang", *WORDS, "n"])

    def collapsed(rows: pa.Table) -> pa.Table:
        columns = [rows[c].combine_chunks() for c in ["lang", *WORDS]]
        first = np.flatnonzero(_changes(columns)[-1])
        at = pa.array(first)
        n = pa.array(np.add.reduceat(rows["n"].to_numpy(), first))
        return pa.table([*[c.take(at) for c in columns], n], ["lang", *WORDS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(np.flatnonzero(_changes([rows[c].combine_chunks() for c in ["lang", *WORDS[:2]]])[-1])[-1])
            held = collapsed(rows.slice(last))
            if last:
                for size in range(2, LONGEST + 1):
                    yield summed(rows.slice(0, last), size)
        if held is not None:
            for size in range(2, LONGEST + 1):
                yield summed(held, size)

    return sorted_windows.mapInArrow(run, sorted_windows.schema)


def lockstep(stream: DataFrame, words: list[str], parts: str, longer: str) -> DataFrame:
    """``stream``, sorted by language and ``words``, with counts of its phrases' beginnings and of what goes on from them.

    A phrase's beginning of k words, which is in the stream as it is no rarer, is the last row of k words
    at or before it. Adds ``parts`` 1 to 4, and ``longer``: the largest count of a phrase with one word
    more. Rows that may go on in the next batch, four at most, are carried over.
    """
    sizes = range(1, LONGEST)
    added = [f"{parts}{k}" for k in sizes] + [longer]
    schema = T.StructType([*stream.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])

    def walk(rows: pa.Table, more: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """Rows with counts, and which of them are still open."""
        m, f = rows["m"].to_numpy(), rows["n"].to_numpy()
        place = np.arange(len(m))
        last = {k: np.maximum.accumulate(np.where(m == k, place, -1)) for k in sizes}
        for k in sizes:
            child = np.flatnonzero(m == k + 1)
            np.maximum.at(more, last[k][child], f[child])
            rows = rows.append_column(f"{parts}{k}", pa.array(f[last[k]], mask=m < k))
        still = np.zeros(len(m), bool)
        above = -1
        for k in sizes:
            at = int(last[k][-1])
            if at < above:
                break
            still[at] = True
            above = at
        return rows.append_column(longer, pa.array(more)), still

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            found, still = walk(rows if held is None else pa.concat_tables([held, rows]), np.append(more, np.zeros(len(rows), np.int64)))
            open_rows = found.filter(pa.array(still))
            held, more = open_rows.drop_columns(added), open_rows[longer].to_numpy().copy()
            yield from found.filter(pa.array(~still)).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from walk(held, more)[0].combine_chunks().to_batches()

    return stream.mapInArrow(run, schema)


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``reported`` phrases of 2 to 5 words that go together most.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs. A phrase with ``a >= least`` occurrences within pieces has for each cut in two the
    score floor(1000 a n / (l r)), l and r being the parts' counts and n all words of the language; its
    lowest counts. Phrases that only occur within one longer phrase are left out.

    Counting takes three passes: words, pairs of frequent words by slots of their hash, and windows of
    pairs in frequent slots. Slots, and the bit tables of a fixed size in which all this is looked up, let
    some others through and so only save work; windows are counted by their words. Each task counts its texts in blocks before anything is shuffled. Counts are then kept as
    sorted streams: in prefix order a phrase's first parts stand before it and its extensions right
    behind it; in suffix order, by the words from the last, so do its last parts and what it extends to
    the left. Each stream is walked once, without a join; phrases of one first (or last) word are in one
    task, which holds four of them at a time.

    Null texts are empty, null languages are ``und``. Repeated rows and ids count as they stand. Long texts
    are read in pieces. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), blank_null(text).alias("text"))
    total = F.sum("n").alias("n")
    single = settle(word_counts(rows).groupBy("lang", *WORDS).agg(total))
    sizes = settle(single.groupBy("lang").agg(F.sum("n").alias("total")))
    single = single.where(F.col("n") >= least)
    table = bit_table(F.xxhash64("lang", "w0"), 64, single)
    table = bit_table(F.col("slot"), SLOT_BITS, frequent_slots(pair_counts(rows, table), least))
    found = window_counts(rows, table).repartition("lang", *WORDS[:2]).sortWithinPartitions("lang", *WORDS)
    found = prefix_counts(found, least)

    words_held = sum((F.when(F.col(w) != F.lit(ABSENT), 1).otherwise(0) for w in WORDS), F.lit(0))
    stream = settle(single.unionByName(found).withColumn("m", words_held))
    in_prefix_order = stream.repartitionByRange("lang", "w0").sortWithinPartitions("lang", *WORDS)
    stream = lockstep(in_prefix_order, WORDS, "l", "right")
    backwards = [f"v{i}" for i in range(LONGEST)]
    turned = {v: F.coalesce(F.get(F.array(*WORDS), F.col("m") - 1 - i), F.lit(ABSENT)) for i, v in enumerate(backwards)}
    stream = settle(stream.withColumns(turned))
    in_suffix_order = stream.repartitionByRange("lang", "v0").sortWithinPartitions("lang", *backwards)
    stream = lockstep(in_suffix_order, backwards, "r", "left")

    stream = stream.where((F.col("m") > 1) & (F.greatest("left", "right") < F.col("n")))
    stream = stream.join(broadcast_if_small(sizes, sizes.count()), "lang")
    left_parts = F.array(*[f"l{k}" for k in range(1, LONGEST)])
    right_parts = F.array(*[f"r{k}" for k in range(1, LONGEST)])
    stream = stream.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    stream = stream.withColumns({"l": F.get(left_parts, F.col("_cut") - 1), "r": F.get(right_parts, F.col("m") - F.col("_cut") - 1)})
    score = F.expr(
        "(cast(1000 * n as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    )
    lowest = F.min(F.struct(score.alias("score"), "_cut", "l", "r")).alias("low")
    phrase = F.concat_ws(" ", *[F.when(F.col(w) != F.lit(ABSENT), F.col(w).cast("string")) for w in WORDS]).alias("phrase")
    scored = stream.groupBy("lang", *WORDS, F.col("n").alias("a"), F.col("total").alias("n")).agg(lowest)
    scored = scored.select("lang", phrase, "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reported)
    return ranked.select(F.col("lang").alias(lang), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
