"""How far the sources of a language differ in their terms, exactly, from counts of packed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framedrift.llm.common import blank_null, settle
from framedrift.sources.files import broadcast_if_small

LEAST_DOCS = 3
TERMS_SHOWN = 200
SCALE = 1_000_000_000
BLOCK_BYTES = 16 << 20  # of texts that are sorted together
PACKED = (4, 8, 12, 16)  # largest sizes of the buckets of packed terms, in bytes: one word up to 8, two up to 16
PAIRS_AT_ONCE = 1 << 21
WIDE = 256  # longer terms are copied one by one

#: What a byte of a term becomes; 0 ends a term. Bytes from 0x80 on belong to characters beyond ASCII.
FOLDED = np.zeros(256, np.uint8)
FOLDED[0x80:] = np.arange(0x80, 0x100)
FOLDED[ord("a") : ord("z") + 1] = FOLDED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: Keeps the first 0 to 8 bytes of a big-endian word.
FIRST_BYTES = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - k)) - 1) if k else 0 for k in range(9)], np.uint64)


def cut_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, size, row) of the terms of all texts, in order."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    octets = np.zeros(bounds[-1] - bounds[0] + 16, np.uint8)  # with room behind, as words are loaded whole
    if raw is not None:
        octets[: bounds[-1] - bounds[0]] = FOLDED[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    inside = octets != 0
    edge = np.unique(bounds[(bounds > 0) & (bounds < bounds[-1])])  # texts end there, terms or not
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    return octets, starts, sizes, np.searchsorted(bounds, starts, side="right") - 1


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` re-sorted, stably, by words of which the first weighs most: 16 bits a pass, least first."""
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _long_keys(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    if width <= WIDE:
        at = np.arange(width)
        held = np.where(at < sizes[:, None], octets[np.minimum(starts[:, None] + at, len(octets) - 1)], 0).astype(np.uint8)
    else:
        held = np.zeros((len(starts), width), np.uint8)
        for row, start, size in zip(held, starts.tolist(), sizes.tolist(), strict=True):
            row[:size] = octets[start : start + size]
    return np.ascontiguousarray(held).view(f"S{width}").ravel()


def sorted_buckets(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per bucket of sizes, (order, new): its terms in byte order, equal ones by ``row``; new where the term changes.

    Terms up to 16 bytes are one or two words, sorted by radix; no byte of a term is 0, so they need no
    size. Longer ones are sorted as bytes, in buckets whose widths double.
    """
    if not len(starts):
        return
    loaded = np.ndarray(len(octets) - 8, ">u8", octets, strides=(1,))
    by_row = np.argsort(row.astype(np.uint16), kind="stable") if row.max() < 1 << 16 else np.argsort(row, kind="stable")
    below = 0
    limits = [*PACKED]
    while limits[-1] < sizes.max():
        limits.append(2 * limits[-1])
    for limit in limits:
        order = by_row[(sizes[by_row] > below) & (sizes[by_row] <= limit)]
        below = limit
        if not len(order):
            continue
        at, size = starts[order], sizes[order]
        if limit <= PACKED[-1]:
            words = [loaded[at].astype(np.uint64) & FIRST_BYTES[np.minimum(size, 8)]]
            if limit > 8:
                words.append(loaded[at + 8].astype(np.uint64) & FIRST_BYTES[size - 8])
            inner = radix_order(words, np.arange(len(order)))
        else:
            words = [_long_keys(octets, at, size, limit)]
            inner = np.argsort(words[0], kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[inner[1:]] != w[inner[:-1]] for w in words])
        yield order[inner], new


def counted(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """(l, g, term, n, docs) of the rows (l, g, text) of a block."""
    groups = block["g"].to_numpy()
    octets, starts, sizes, row = cut_terms(block["text"].combine_chunks() if block["text"].num_chunks != 1 else block["text"].chunk(0))
    # Rows in the order of their groups, so that within a term the groups are runs, too.
    by_group = np.argsort(groups, kind="stable")
    place = np.empty(len(groups), np.int64)
    place[by_group] = np.arange(len(groups))
    place = place[row]
    lang, sorted_groups = block["l"].to_numpy()[by_group], groups[by_group]
    for order, new in sorted_buckets(octets, starts, sizes, place):
        at = place[order]
        of = sorted_groups[at]
        new_group, new_doc = new.copy(), new.copy()
        new_group[1:] |= of[1:] != of[:-1]
        new_doc[1:] |= at[1:] != at[:-1]
        first = np.flatnonzero(new_group)
        n = np.diff(first, append=len(order))
        docs = np.add.reduceat(new_doc, first, dtype=np.int64)
        size, start = sizes[order[first]], starts[order[first]]
        ends = np.cumsum(size)
        letters = octets[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        offsets = np.append(0, ends).astype(np.int64)
        terms = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang[at[first]]), pa.array(of[first]), terms, pa.array(n.astype(np.int64)), pa.array(docs)], ["l", "g", "term", "n", "docs"]
        )


def term_counts(rows: DataFrame) -> DataFrame:
    """Partial counts (l, g, term, n, docs) of rows (l, g, text), one for each block of texts and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from counted(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from counted(pa.Table.from_batches(held))

    return rows.select("l", "g", "text").mapInArrow(run, "l long, g long, term string, n long, docs long")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are below 2^30, so the square fits."""
    return (p - q) ** 2 // q


def met_pairs(terms: DataFrame) -> DataFrame:
    """(a, b, v): what terms that both groups hold add to the pair, beside the sums over either group alone.

    Each row has the list ``held`` of (g, p, z) of a term: group, share, and share of a term that never occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0)
            sizes = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            g, p, z = (flat.field(i).to_numpy() for i in range(3))
            known, code = np.unique(g, return_inverse=True)
            partners = np.repeat(sizes, sizes).astype(np.int64)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            upto = np.cumsum(partners)
            begin = 0
            while begin < len(g):
                done = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
                many = partners[begin:end]
                i = np.repeat(np.arange(begin, end), many)
                j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
                i, j = i[i != j], j[i != j]
                begin = end
                if not len(i):
                    continue
                v = gap(p[i], p[j]) - gap(p[i], z[j]) - gap(z[i], p[j]) + gap(z[i], z[j])
                pair = code[i] * len(known) + code[j]
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
                at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                columns = [known[pair[at] // len(known)], known[pair[at] % len(known)], np.add.reduceat(v[order], at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "v"])

    return terms.select("held").mapInArrow(run, "a long, b long, v long")


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total), beyond 64 bits on the way."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * {SCALE}) div cast({total} as decimal(20, 0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit_sources(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, shown: int = TERMS_SHOWN
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Terms are runs of letters A-Z, in any case, and characters beyond ASCII. A language keeps the V
    terms that ``least_docs`` of its documents hold. Shares are p = 1 + floor(10^9 (count + 1) / (N + V)),
    N being the count's sum over kept terms. Part ``pair``: value is the sum over all kept terms of
    floor((p - q)^2 / q) with the other source's q. Part ``term``: the kept terms of which the source has a
    larger share p than its language's q, by the same measure, the first ``shown`` of them.

    Texts are cut and counted in blocks inside the tasks, so that frequent terms and large sources are a
    few rows each when they are shuffled, by language and term. Pairs are summed from the terms that
    both sources hold and from each source's histogram of shares, as all other terms have the share of a
    term that never occurs; terms that few sources hold cost little however many sources there are.

    Null texts, languages and sources are read as ''. Every (language, source) gives rows even without
    terms; in a language without kept terms all pairs have value 0. Repeated rows and ids are documents of
    their own. A term may be as long as its text. An empty table gives no rows. Other columns are not
    read. Sums must stay below 2^63, which shares do for any count.
    """
    rows = docs.select(blank_null(text).alias("text"), blank_null(lang).alias("lang"), blank_null(source).alias("source"))
    groups = settle(rows.select("lang", "source").distinct())
    groups = settle(groups.withColumn("g", F.monotonically_increasing_id()))  # of a stored table: the same whenever read
    groups = settle(groups.withColumn("l", F.min("g").over(Window.partitionBy("lang"))))
    many = groups.count()

    numbered = rows.join(broadcast_if_small(groups, many), ["lang", "source"])
    # One exchange: sums by group and by term both lie within (language, term).
    counts = term_counts(numbered).repartition("l", "term").groupBy("l", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("l", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("held")
    )
    kept = settle(kept.where(F.col("docs") >= least_docs).drop("docs"))

    flat = kept.select("l", "term", "lang_n", F.inline("held"))
    of_lang = kept.groupBy("l").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    of_group = flat.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    sizes = groups.join(of_lang, "l").join(of_group, "g", "left").fillna(0, ["total", "terms"])
    sizes = settle(sizes.withColumn("sum", F.col("total") + F.col("v")).withColumn("z", _share("0", "sum")))
    near = broadcast_if_small(sizes.drop("lang", "source", "l", "total", "terms"), many)
    shares = flat.join(near, "g").select(
        "l", "term", "g", "z", _share("n", "sum").alias("p"), _share("lang_n", "(lang_total + v)").alias("q")
    )

    above = shares.where("p > q").select("g", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    best = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= shown)

    together = shares.groupBy("l", "term").agg(F.collect_list(F.struct("g", "p", "z")).alias("held")).where(F.size("held") > 1)
    met = met_pairs(together).groupBy("a", "b").agg(F.sum("v").alias("met"))
    # Sums over the terms of x alone, against the share z that the other source has of terms it never holds.
    steps = shares.groupBy("l", "g", "p").agg(F.count("*").alias("k"))
    others = sizes.select("l", F.col("g").alias("y"), F.col("z").alias("zy"))
    alone = steps.join(broadcast_if_small(others, many), "l").where("g <> y").groupBy("g", "y").agg(
        F.sum(F.col("k") * _gap("p", "zy")).alias("as_source"), F.sum(F.col("k") * _gap("zy", "p")).alias("as_item")
    )
    sides = [
        groups.join(sizes.select("g", "z", "v", "terms"), "g", "left").select(
            "l", *[F.col(c).alias(f"{c}_{x}") for c in ("g", "lang", "source", "z", "v", "terms")]
        )
        for x in "ab"
    ]
    pairs = sides[0].join(sides[1].drop("lang_b", "v_b"), "l").where("g_a <> g_b")
    pairs = pairs.join(alone.select(F.col("g").alias("g_a"), F.col("y").alias("g_b"), "as_source"), ["g_a", "g_b"], "left")
    pairs = pairs.join(alone.select(F.col("y").alias("g_a"), F.col("g").alias("g_b"), "as_item"), ["g_a", "g_b"], "left")
    pairs = pairs.join(met.withColumnsRenamed({"a": "g_a", "b": "g_b"}), ["g_a", "g_b"], "left")
    rest = (F.col("v_a") - F.col("terms_a") - F.col("terms_b")) * _gap("z_a", "z_b")
    zero = F.lit(0).cast("long")
    value = F.coalesce(rest, zero) + F.coalesce("as_source", zero) + F.coalesce("as_item", zero) + F.coalesce("met", zero)
    ranked = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.select(F.col("g_a").alias("g"), F.col("source_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    both = pairs.withColumn("part", F.lit("pair")).unionByName(above.withColumn("part", F.lit("term")))
    names = broadcast_if_small(groups.select("g", "lang", "source"), many)
    return both.join(names, "g").select(F.col("lang").alias(lang), F.col("source").alias(source), "part", "item", "value", F.col("rank").cast("int").alias("rank"))
