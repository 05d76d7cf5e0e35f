"""Near duplicates by SimHash fingerprints that differ in at most two bits, or by the share of shingles in common."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import settle, split_join

SEED = 42
BITS = 64
WIDTH = 4  # bits of a segment
SEGMENTS = BITS // WIDTH
AT_ONCE = 1 << 16  # shingles hashed before their bits are added up
BANDS, BAND_ROWS = 24, 5  # a pair at similarity 0.8 shares no band with chance 7e-5
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64, endpoint=False) | np.uint64(1)


def hashed_shingles(text: str | None, words_per_shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles in order, repeats included; a text with fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return
    if len(words) < words_per_shingle:
        words_per_shingle = len(words)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - words_per_shingle + 1], ends[words_per_shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), AT_ONCE):
        pairs = zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


def voted(parts: Iterable[np.ndarray]) -> int:
    """SimHash of hashes; 0 if there are none."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    return voted(hashed_shingles(text, words_per_shingle))


def fingerprints(docs: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()]
            found = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, fp long")


def lattice_points(fp: Column) -> tuple[Column, Column]:
    """The segments' bit counts as a grid point, and the array of (point, segment, step) of it and all points one step away.

    ``point`` packs the counts, three bits each. Steps that no fingerprint can make are left out. The
    array refers to the grid point as column ``_base``.
    """
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))) for s in range(SEGMENTS)]
    base = sum((F.shiftleft(c.cast("long"), 3 * s) for s, c in enumerate(counts)), F.lit(0).cast("long"))

    def point(at: Column, segment: int, step: int) -> Column:
        return F.struct(at.alias("point"), F.lit(segment).alias("segment"), F.lit(step).alias("step"))

    around = [
        x
        for s, c in enumerate(counts)
        for x in (
            F.when(c < WIDTH, point(F.col("_base") + (1 << 3 * s), s, 1)),
            F.when(c > 0, point(F.col("_base") - (1 << 3 * s), s, -1)),
        )
    ]
    return base, F.array_compact(F.array(point(F.col("_base"), -1, 0), *around))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join all pairs of distinct fingerprints within two bits.

    A fingerprint's bit counts per segment are a point of a grid; the Manhattan distance of two points
    is a lower bound of the differing bits. Points within distance two have a grid point that is at
    most one step from both, so each fingerprint is registered at its own point and those one step
    away, and only grid points with two or more fingerprints go on.

    There, pairs are not compared one by one: two fingerprints within two bits have a word in between
    that is at most one bit from both, and its bit counts are one of the shared grid points. Each
    member names the words within one bit of it that lie at the grid point (four at most). All members
    of such a word, 65 at most, are within two bits of each other, and are linked to the least of them.
    """
    base, points = lattice_points(F.col("fp"))
    registered = fps.select("fp").withColumn("_base", base).select("fp", F.explode(points).alias("p")).select("fp", "p.*")
    shared = registered.groupBy("point").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).where("_a < _b")
    members = registered.join(shared.select("point"), "point", "left_semi")

    flips = F.expr(
        f"transform(filter(transform(sequence(0, {WIDTH - 1}), b -> shiftleft(1L, {WIDTH} * segment + b)), "
        "m -> ((fp & m) = 0) = (step > 0)), m -> fp ^ m)"
    )
    words = F.when(F.col("step") == 0, F.array("fp")).otherwise(flips)
    between = members.select("fp", F.explode(words).alias("word"))
    groups = between.groupBy("word").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    links = groups.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a < b")
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable.

    Each round takes the least label among the neighbours, then the label of one's label, so long
    chains halve. Each round is settled in the shared folder. A fingerprint has at most 2,080
    neighbours; a shingle set may have more. Adaptive execution splits the joins by node.
    """
    links = settle(links)
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(
        F.col("a").alias("node"), F.col("b").alias("other")
    ))
    labels = settle(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("_near"))
        nearer = labels.join(offered, "node").select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("_mid"))
        above = labels.select(F.col("node").alias("_mid"), F.col("root").alias("_top"))
        stepped = settle(nearer.join(above, "_mid").select("node", "_was", F.least("_mid", "_top").alias("root")))
        labels = stepped.select("node", "root")
        if not stepped.where("root < _was").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and the least key of its component.

    Texts are lower-cased (A-Z), cut at ASCII white space, and hashed in shingles, repeats included; a
    text with fewer words is one shingle; null, empty and blank texts have fingerprint zero and link
    like any other. Fingerprints that differ in two bits or fewer are linked. Null keys have
    components, but only name one if no other key is in it. Repeated rows share a component. Long texts
    are hashed piece by piece; an empty table gives no rows. Other columns are not read. Returns (key, fingerprint, component_id).
    """
    rows = settle(fingerprints(docs, key, text, words_per_shingle))
    fps = settle(rows.groupBy("fp").agg(F.min("_key").alias("_least"), F.count("*").alias("_copies")))
    roots = components(near_links(fps))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settle(named)
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_members"))
    classes = split_join(named, least, ["root"], "_members", named.count()).select("fp", "_copies", "component_id")
    return split_join(rows, settle(classes), ["fp"], "_copies", rows.count()).select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, words_per_shingle: int) -> tuple[np.ndarray, int, int]:
    """The distinct shingle hashes in order, their digest as a signed long, and the SimHash."""
    parts = list(hashed_shingles(text, words_per_shingle))
    found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
    return found, xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63), voted(parts)


def bands(found: np.ndarray) -> list[int]:
    """Hashes of BANDS groups of BAND_ROWS minima of the shingles, each under an order of its own; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048, None] * MULTIPLIERS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _sketches(docs: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """(_key, _row, fp, node, n, bands): ``node`` names the set of shingles, ``n`` is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words_per_shingle) for t in batch.column(2).to_pylist()]
            fps = np.array([f for _, _, f in found], np.uint64).view(np.int64)
            columns = [
                pa.array(fps), pa.array([d for _, d, _ in found], pa.int64()), pa.array([len(x) for x, _, _ in found], pa.int32()),
                pa.array([bands(x) for x, _, _ in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_key", "_row", "fp", "node", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), _row(key, text), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _row long, fp long, node long, n int, bands array<long>")


def _row(key: str, text: str) -> Column:
    return F.xxhash64(F.lit(0), F.col(key), F.col(text)).alias("_row")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words_per_shingle: int) -> DataFrame:
    """(node, shingles) of the rows whose ``_row`` is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words_per_shingle) for t in batch.column(0).to_pylist()]
            nodes, sets = pa.array([d for _, d, _ in found], pa.int64()), pa.array([x.view(np.int64) for x, _, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, sets], ["node", "shingles"])

    rows = docs.select(_row(key, text), F.col(text).alias("_text")).join(wanted, "_row", "left_semi").select("_text")
    return rows.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common / F.greatest(F.size("_a") + F.size("_b") - common, F.lit(1)) >= least).select("a", "b")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 5, least: float = 0.8
) -> DataFrame:
    """(key, component_id) for each row of ``docs``: the least key among its near copies, and theirs.

    Two texts are near copies if the sets of their shingles (see ``near_duplicates``) have a Jaccard
    similarity of ``least`` or more. It is counted on the whole sets; candidates are pairs whose
    fingerprints are within two bits (``near_links``), and pairs that share one of BANDS bands of minimum
    hashes. A pair at 0.8 shares none with chance 7e-5, a closer one with less.

    Equal sets are one node, so copies never meet. In each band all nodes are first compared to the least,
    which joins most; then all pairs of nodes that lie in different components. None is left out, so the
    second round may grow with the square of a group of texts that share a band and aren't near copies.

    Texts without words are one node. Null keys have components, but only name one if no other key is
    in it. Other columns are not read.
    """
    rows = settle(_sketches(docs, key, text, words_per_shingle))
    nodes = settle(rows.groupBy("node").agg(
        F.min("_key").alias("_least"), F.min("_row").alias("_row"), F.count("*").alias("_copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    ))
    placed = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("node").alias("_first"), F.count("*").alias("_members")).where("_members > 1")
    members = settle(placed.join(shared.drop("_members"), "band"))

    fps = settle(rows.select("fp", "node").distinct())
    first = settle(fps.groupBy("fp").agg(F.min("node").alias("a")))
    same = fps.join(first, "fp").select("a", F.col("node").alias("b"))
    close = near_links(first).select(F.col("a").alias("fp"), F.col("b").alias("_other"))
    close = close.join(first, "fp").drop("fp").withColumnRenamed("_other", "fp").join(fps, "fp").select("a", F.col("node").alias("b"))
    pairs = members.select(F.col("_first").alias("a"), F.col("node").alias("b")).unionByName(same).unionByName(close)
    pairs = settle(_ordered(pairs))

    named = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = settle(_sets(docs, nodes.join(named, "node", "left_semi").select("_row"), key, text, words_per_shingle))
    links = settle(_alike(pairs, sets, least))
    roots = components(links)

    parts = members.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = parts.groupBy("band").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("band")
    parts = settle(parts.join(mixed, "band", "left_semi"))
    sides = [parts.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "node", "n")]) for x in "ab"]
    met = [x.select("band", f"root_{s}").distinct() for x, s in zip(sides, "ab", strict=True)]
    apart = met[0].join(met[1], "band").where("root_a < root_b")
    cross = apart.join(sides[0], ["band", "root_a"]).join(sides[1], ["band", "root_b"])
    cross = cross.where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= least)
    cross = _ordered(cross.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).join(pairs, ["a", "b"], "left_anti")
    more = settle(_alike(settle(cross), sets, least))
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    joined = nodes.select("node", "_least", "_copies").join(roots, "node", "left")
    joined = settle(joined.withColumn("root", F.coalesce("root", "node")))
    groups = joined.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("_members"))
    classes = split_join(joined, groups, ["root"], "_members", joined.count()).select("node", "_copies", "component_id")
    return split_join(rows.select("_key", "node"), settle(classes), ["node"], "_copies", rows.count()).select(F.col("_key").alias(key), "component_id")
