"""Benchmark leaks, also with other numbers, names and units, by windows over templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import settle

WINDOW = 8  # tokens
LITERAL = 0.5  # least share of literal tokens of a window that is joined by template; others are by their values too
COVERED = 0.5  # least share of an item's windows that a leak shows
FILTER_BITS = 22
CACHED = 300_000
GROUP_TOKENS = 50_000  # of texts read together
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
# Words that are units after a number.
UNITS = frozenset(
    "mm cm dm m km mg g kg t ml cl l ms s sec secs min mins h hr hrs kb mb gb tb hz khz mhz ghz w kw v kv "
    "millimeter millimeters centimeter centimeters meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms ton tons tonne tonnes liter liters litre litres milliliter milliliters "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles ounce ounces pound pounds gallon gallons pint pints acre acres "
    "dollar dollars euro euros cent cents pence percent degree degrees celsius fahrenheit mph kph".split()
)
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(x) for x in (NUMBER, NAME, UNIT)], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD, CAPITAL, DIGITS, STOP = range(4)
#: What a token is, by its first character; beyond ASCII the character is asked.
FIRST = np.array([STOP if chr(c) in ".!?\n" else DIGITS if chr(c).isdigit() else CAPITAL if chr(c).isupper() else WORD for c in range(129)], np.int8)
#: With all capitalised words as placeholders, with those within sentences, and with names as they are (in lower case).
LEVELS = ALL_CAPITALS, WITHIN, NO_NAMES = 2, 1, 0


class Numbered(dict):
    """Numbers of tokens; one that is looked up for the first time gets the next number and is listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        return number


class Canon:
    """Templates of texts. Numbers, units after numbers and names become placeholders.

    A name is a run of capitalised words of which the first does not start a sentence; at the level
    ALL_CAPITALS it may, as people often stand first. At NO_NAMES there are none.
    """

    def __init__(self):
        self.index = Numbered()
        self.hash, self.kind, self.unit = (np.zeros(1 << 12, t) for t in (np.uint64, np.int8, bool))

    def _ids(self, tokens: list[str]) -> np.ndarray:
        first = len(self.index)
        ids = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        new, end = self.index.new, len(self.index)
        if new:
            while end > len(self.hash):  # doubled, so that growing costs no more than filling
                self.hash, self.kind, self.unit = (np.append(x, np.zeros_like(x)) for x in (self.hash, self.kind, self.unit))
            lower = " ".join(new).lower().split(" ")  # all at once; no token holds a space
            self.hash[first:end] = np.fromiter(map(xxhash.xxh64_intdigest, lower), np.uint64, len(new))
            letters = np.frombuffer("".join([t[0] for t in new]).encode("utf-32-le"), np.uint32)
            self.kind[first:end] = FIRST[np.minimum(letters, len(FIRST) - 1)]
            for i in np.flatnonzero(letters >= len(FIRST) - 1).tolist():
                self.kind[first + i] = DIGITS if new[i][0].isdigit() else CAPITAL if new[i][0].isupper() else WORD
            self.unit[first:end] = list(map(UNITS.__contains__, lower))
            new.clear()
        return ids

    def read(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) > CACHED:
            self.__init__()
        return self._ids(tokens)

    def template(self, ids: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash of the first token as it is, first token, placeholder or -1) of each template token."""
        kind = self.kind[ids]
        at = np.flatnonzero(kind != STOP)
        starts = np.append(True, kind[:-1] == STOP)[at] if len(ids) else np.zeros(0, bool)
        ids, kind = ids[at], kind[at]
        slot = np.full(len(ids), -1)
        slot[kind == DIGITS] = 0
        if len(ids):
            slot[self.unit[ids] & np.append(False, kind[:-1] == DIGITS) & ~starts] = 2
        if names:
            name = (kind == CAPITAL) & (slot < 0)
            slot[name if names == ALL_CAPITALS else name & ~starts] = 1
            keep = ~((slot == 1) & np.append(False, slot[:-1] == 1)[: len(slot)])
            if names == ALL_CAPITALS:  # a name ends with its sentence
                keep |= starts
            ids, at, slot = ids[keep], at[keep], slot[keep]
        plain = self.hash[ids]
        return np.where(slot >= 0, PLACEHOLDERS[slot], plain), plain, at, slot


def windows(hashes: np.ndarray, plain: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether verbatim) of the windows of ``size`` template tokens, by start.

    Windows with too few literals are verbatim: they are hashed as they are, not as templates.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total = total * BASE + hashes[j : j + n]
    literals = np.append(0, np.cumsum(slot < 0))
    verbatim = literals[size:] - literals[:n] < LITERAL * size
    at = np.flatnonzero(verbatim)
    if len(at):
        own = np.full(len(at), ~np.uint64(size), np.uint64)
        for j in range(size):
            own = own * BASE + plain[at + j]
        total[at] = own
    return total ^ (total >> np.uint64(31)), verbatim


def spelled(tokens: list[str], at: np.ndarray, slot: np.ndarray, start: int, size: int) -> tuple[str, list[str]]:
    """A window's template, and the values in its placeholders."""
    words, values = [], []
    for i in range(start, start + size):
        if slot[i] < 0:
            words.append(tokens[at[i]].lower())
            continue
        words.append((NUMBER, NAME, UNIT)[slot[i]])
        end = at[i] + 1
        while slot[i] == 1 and end < len(tokens) and tokens[end][0].isupper() and (i + 1 == len(at) or end < at[i + 1]):
            end += 1
        values.append(" ".join(tokens[at[i] : end]).lower())
    return " ".join(words), values


FOUND = "names int, size int, hash long, template string, start int, slots array<string>, verbatim boolean"


def _open(rows: DataFrame, sizes: list[int], passing: np.ndarray | None, whole: bool) -> DataFrame:
    """Windows of rows (_id, _text): those in the filter ``passing``; all, and all sizes as they fit, if ``whole``.

    Texts are read in groups of about GROUP_TOKENS tokens with a sentence end between them, so that arrays
    are long; windows over two texts are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(passing)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_()]

    def opened(canon: Canon, keys: list[int], tokens: list[str], ids: np.ndarray, text_of: np.ndarray, fits: np.ndarray | None) -> pa.RecordBatch:
        out: list[list] = [[] for _ in kinds]
        same = None
        for names in LEVELS:
            hashes, plain, at, slot = canon.template(ids, names)
            of = text_of[at]
            first = np.searchsorted(of, np.arange(len(keys)))
            # Without names inside sentences, the last level has the windows of the one before.
            if names == NO_NAMES and same is not None:
                found_by_size = same
            else:
                found_by_size = []
                for size in [min(WINDOW, len(hashes))] if whole else sizes:
                    found, verbatim = windows(hashes, plain, slot, size) if size else (np.zeros(0, np.uint64), np.zeros(0, bool))
                    start = np.flatnonzero(of[: len(found)] == of[size - 1 : size - 1 + len(found)]) if size else np.zeros(0, np.int64)
                    if fits is not None:
                        start = start[fits[(found[start] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
                    found_by_size.append((size, start, found[start].view(np.int64), verbatim[start]))
            if names == WITHIN and not (slot == 1).any():
                same = found_by_size
            for size, start, found, verbatim in found_by_size:
                for s, h, own, text in zip(start.tolist(), found.tolist(), verbatim.tolist(), of[start].tolist(), strict=True):
                    template, values = spelled(tokens, at, slot, s, size)
                    if own:
                        template = f"{template} = {' | '.join(values)}"
                    for c, v in zip(out, (keys[text], names, size, h, template, s - int(first[text]), values, own), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            ["_id", "names", "size", "hash", "template", "start", "slots", "verbatim"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, fits = Canon(), shared.value
        for batch in batches:
            keys, tokens, ends = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                tokens += TOKEN.findall(text or "")
                tokens.append("\n")
                ends.append(len(tokens))
                if whole or len(tokens) >= GROUP_TOKENS:
                    yield opened(canon, keys, tokens, canon.read(tokens), np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0)), fits)
                    keys, tokens, ends = [], [], []
            if keys:
                yield opened(canon, keys, tokens, canon.read(tokens), np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0)), fits)

    return rows.select("_id", "_text").mapInArrow(run, f"_id long, {FOUND}")


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, windows, covered, changed) for each document that shows a benchmark item.

    Texts become templates (see Canon) at three levels: with all capitalised words as placeholders, with
    those within sentences, and with none, item and document alike. Windows of WINDOW
    template tokens are joined by hash and checked by template; an item with fewer tokens is one window.
    On each alignment of document and item, a placeholder value of the item must stand for one value
    throughout; windows of other alignments do not count. A document shows an item if COVERED of the
    item's windows are left. ``changed`` says that a value differs.

    Windows with fewer literals than LITERAL are too alike as templates, and match if their values are
    equal too. COVERED is asked of all windows, or of those joined by template where there are any, as
    with other values no others match; the larger share is given.

    Items with equal texts up to case and spacing between tokens are one item, named by the least id.
    A fixed bit table of the items' hashes keeps other windows of documents from leaving their task; it
    only saves work. Items and documents are joined as tables, so neither has to fit anywhere.

    Null and empty texts have no windows. Items without an id are left out. Rows that repeat key and text give one result; null keys are kept. Other columns are not read.
    """
    spark = docs.sparkSession
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(item_text, F.lit("")), r"\s+", " ")))
    whole = items.where(F.col(item).isNotNull()).groupBy(plain.alias("_plain")).agg(
        F.min(F.struct(F.col(item).alias("id"), F.col(item_text).alias("text"))).alias("_i")
    )
    # Items are known by a hash of their text, as ids may be of any type.
    whole = whole.select(F.xxhash64("_plain").alias("_id"), F.col("_i.id").alias("_name"), F.col("_i.text").alias("_text"))
    known = settle(_open(whole.drop("_name"), [], None, True))
    per_item = known.groupBy("_id", "names").agg(F.count("*").alias("n"), F.count_if(~F.col("verbatim")).alias("n_free"))
    known = known.join(per_item, ["_id", "names"]).select(
        F.col("_id").alias("_item"), "names", "size", "hash", "template", F.col("start").alias("_at"), F.col("slots").alias("_slots"), "verbatim", "n", "n_free"
    )
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    if not sizes:
        sizes = [WINDOW]
    passing = np.zeros(1 << FILTER_BITS, bool)
    slots = known.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("s")).distinct().toArrow()
    passing[slots["s"].to_numpy()] = True

    rows = docs.select(F.xxhash64(F.lit(0), F.col(key), F.col(text)).alias("_id"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    met = _open(rows, sizes, passing, False).join(known, ["names", "size", "hash", "template", "verbatim"])
    # One row per alignment and way (with and without verbatim windows): as many windows and values as the item has.
    pairs = F.zip_with("_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ways = F.when(F.col("verbatim"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    met = met.withColumn("_all", F.explode(ways)).withColumn("n", F.when(F.col("_all"), F.col("n")).otherwise(F.col("n_free")))
    aligned = met.groupBy("_id", "_item", "names", "_all", (F.col("start") - F.col("_at")).alias("_shift")).agg(
        F.collect_set("_at").alias("_ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("_pairs"), F.max("n").alias("n")
    )
    one_value = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["a"]))) == F.size("_pairs")
    differs = F.exists("_pairs", lambda p: p["a"] != p["b"])
    shown = (
        aligned.where(one_value)
        .groupBy("_id", "_item", "names", "_all")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("_ats")))).alias("windows"), F.max("n").alias("n"), F.max(differs).alias("changed"))
        .withColumn("covered", F.col("windows") / F.col("n"))
        .where(F.col("covered") >= COVERED)
        .groupBy("_id", "_item")
        .agg(F.max("windows").alias("windows"), F.max("covered").alias("covered"), F.min("changed").alias("changed"))
    )
    names = rows.select("_id", "_key").distinct()
    shown = shown.join(whole.select(F.col("_id").alias("_item"), "_name"), "_item")
    return shown.join(names, "_id").select(
        F.col("_key").alias(key), F.col("_name").alias(item), F.col("windows").cast("long").alias("windows"), "covered", "changed"
    )
