"""Nearest vectors by a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framedrift.llm.common import settle
from framedrift.sources.files import broadcast_if_small

NEAREST = 10
EVERY = 100  # rows whose key it divides are queries
SHARD_ROWS = 16_384
SHARD_BYTES = 64 << 20
LINKS = 16  # of a node in the upper layers; twice as many in the lowest
EF_BUILD = 64
EF_SEARCH = 160
CHOSEN_FROM = 48
AT_ONCE = 256  # nodes inserted, or queries sought, in lockstep
QUERY_BLOCK = 512
SEED = 42


def squared(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``a`` of vectors to the vectors ``b``."""
    gap = vectors[a] - b
    return np.einsum("ij,ij->i", gap, gap)


def beam(vectors: np.ndarray, links: np.ndarray, wanted: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, squared distance) of the ``width`` nodes nearest to each of ``wanted`` that a best-first walk finds, nearest first.

    All walks take a step together: each goes to the nearest node it has met and not yet visited, among
    the ``width`` best, until none is left. Places without a node are -1 and infinitely far.
    """
    rows = np.arange(len(wanted))
    node = np.full((len(wanted), width), -1, np.int32)
    far = np.full((len(wanted), width), np.inf)
    visited = np.ones((len(wanted), width), bool)
    node[:, 0], far[:, 0], visited[:, 0] = entry, squared(vectors, entry, wanted), False
    met = np.zeros((len(wanted), len(links) + 1), bool)
    met[:, -1] = True  # what -1 stands for
    met[rows, entry] = True
    while True:
        ahead = np.where(visited, np.inf, far)
        best = ahead.argmin(axis=1)
        going = np.flatnonzero(ahead[rows, best] < np.inf)
        if not len(going):
            break
        visited[going, best[going]] = True
        around = links[node[going, best[going]]]
        new = ~met[going[:, None], around]
        who, which = np.nonzero(new)
        found = around[who, which]
        met[going[who], found] = True
        step = np.full(around.shape, np.inf)
        step[who, which] = squared(vectors, found, wanted[going[who]])
        all_far = np.concatenate([far[going], step], axis=1)
        kept = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        far[going] = np.take_along_axis(all_far, kept, 1)
        node[going] = np.take_along_axis(np.concatenate([node[going], np.where(new, around, -1)], axis=1), kept, 1)
        visited[going] = np.take_along_axis(np.concatenate([visited[going], ~new], axis=1), kept, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1)


def choose(vectors: np.ndarray, node: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, ``most`` links each: those nearer than to any chosen before, then the nearest others."""
    node, far = node[:, :CHOSEN_FROM], far[:, :CHOSEN_FROM]
    held = vectors[node]
    norms = np.einsum("ijk,ijk->ij", held, held)
    apart = norms[:, :, None] + norms[:, None, :] - 2 * (held @ held.transpose(0, 2, 1))
    shut = np.full(node.shape, np.inf)
    chosen = np.zeros(node.shape, bool)
    count = np.zeros(len(node), int)
    for i in range(node.shape[1]):
        fits = (node[:, i] >= 0) & (far[:, i] < shut[:, i]) & (count < most)
        chosen[:, i] = fits
        count += fits
        np.minimum(shut, np.where(fits[:, None], apart[:, i], np.inf), out=shut)
    rank = np.where(chosen, 0, np.where(node >= 0, 1, 2)) * node.shape[1] + np.arange(node.shape[1])
    first = np.argsort(rank, axis=1)[:, :most]
    out = np.full((len(node), most), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(node, first, 1)
    return out


def link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link the ``chosen`` nodes of each ``new`` node back to it; a full list is chosen anew."""
    most = links.shape[1]
    at, column = np.nonzero(chosen >= 0)
    to, source = chosen[at, column], new[at]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
    nth = np.arange(len(to)) - np.repeat(first, np.diff(first, append=len(to)))
    for begin in range(0, int(nth.max(initial=-1)) + 1, LINKS):  # a node that many chose takes several rounds
        now = (nth >= begin) & (nth < begin + LINKS)
        nodes, row = np.unique(to[now], return_inverse=True)
        added = np.full((len(nodes), LINKS), -1, np.int32)
        added[row, nth[now] - begin] = source[now]
        for chunk in range(0, len(nodes), AT_ONCE):
            some = nodes[chunk : chunk + AT_ONCE]
            around = np.concatenate([links[some], added[chunk : chunk + AT_ONCE]], axis=1)
            far = np.full(around.shape, np.inf)
            who, which = np.nonzero(around >= 0)
            far[who, which] = squared(vectors, around[who, which], vectors[some[who]])
            nearest = np.argsort(far, axis=1, kind="stable")
            around, far = np.take_along_axis(around, nearest, 1), np.take_along_axis(far, nearest, 1)
            full = np.flatnonzero(around[:, most] >= 0)
            picked = around[:, :most]
            if len(full):
                picked[full] = choose(vectors, around[full], far[full], most)
            links[some] = picked


def build(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): the graph of ``vectors[order]``.

    Nodes are put in by descending level, so that a layer holds the first nodes and is one flat array
    of neighbour numbers, -1 where there is none; layer 0 comes first. Nodes of a batch are sought in
    lockstep in the graph before it, and besides know the ones before them in the batch.
    """
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(1 - draws) / math.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    vectors, level = vectors[order], level[order]
    sizes = [int((level >= k).sum()) for k in range(level[0] + 1)]
    layers = [np.full((size, LINKS * (1 if k else 2)), -1, np.int32) for k, size in enumerate(sizes)]
    begin = 1
    while begin < n:
        end = min(n, begin + min(AT_ONCE, begin))
        wanted = vectors[begin:end]
        entry = np.zeros(end - begin, np.int32)
        for k in range(len(layers) - 1, -1, -1):
            links = layers[k]
            high = np.flatnonzero(level[begin:end] >= k)
            low = np.flatnonzero(level[begin:end] < k)
            graph = links[: min(begin, len(links))]
            if len(low):
                entry[low] = beam(vectors, graph, wanted[low], entry[low], 1)[0][:, 0]
            if len(high):
                node, far = beam(vectors, graph, wanted[high], entry[high], EF_BUILD)
                entry[high] = node[:, 0]
                own = wanted[high]
                peers = np.repeat((begin + high).astype(np.int32)[None], len(high), 0)
                gaps = np.array([squared(own, np.arange(len(own)), own[i]) for i in range(len(own))])
                before = np.tri(len(high), k=-1, dtype=bool)
                node = np.concatenate([node, np.where(before, peers, -1)], axis=1)
                far = np.concatenate([far, np.where(before, gaps, np.inf)], axis=1)
                nearest = np.argsort(far, axis=1, kind="stable")[:, :CHOSEN_FROM]
                chosen = choose(vectors, np.take_along_axis(node, nearest, 1), np.take_along_axis(far, nearest, 1), LINKS)
                new = (begin + high).astype(np.int32)
                links[new, : chosen.shape[1]] = chosen
                link_back(vectors, links, new, chosen)
        begin = end
    return order, layers


def seek(vectors: np.ndarray, layers: list[np.ndarray], wanted: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, nodes) of each AT_ONCE queries: down the layers, then a beam of ``width`` in the lowest."""
    for begin in range(0, len(wanted), AT_ONCE):
        some = wanted[begin : begin + AT_ONCE]
        entry = np.zeros(len(some), np.int32)
        for links in layers[:0:-1]:
            entry = beam(vectors, links, some, entry, 1)[0][:, 0]
        yield begin, beam(vectors, layers[0], some, entry, width)[0]


INDEX = "dim int, shard long, ids array<array<long>>, vectors binary, sizes array<int>, links binary"


def build_shards(nodes: DataFrame) -> DataFrame:
    """One row per shard of nodes (dim, shard, vector, ids): vectors in the graph's order, and its layers as flat arrays."""

    def run(shard: pa.Table) -> pa.Table:
        dim, number = shard["dim"][0].as_py(), shard["shard"][0].as_py()
        ids = shard["ids"].to_pylist()
        rows = np.array(sorted(range(len(ids)), key=ids.__getitem__))  # the same graph whatever the order of rows
        vectors = shard["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[rows]
        order, layers = build(vectors / np.abs(vectors).max())
        flat = np.concatenate([links.ravel() for links in layers])
        row = [dim, number, [ids[i] for i in rows[order]], vectors[order].tobytes(), [len(x) for x in layers], flat.tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.int32()), pa.binary()]
        names = ["dim", "shard", "ids", "vectors", "sizes", "links"]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return nodes.select("dim", "shard", "vector", "ids").groupBy("dim", "shard").applyInArrow(run, INDEX)


def search_shards(met: DataFrame, nearest: int, width: int) -> DataFrame:
    """(query_id, vec_id, score) for rows of an index row and a block of queries: the ``nearest`` + 1 best each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("dim", "ids", "vectors", "sizes", "links", "queries")}
                dim, ids = row["dim"].as_py(), row["ids"].as_py()
                vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dim)
                flat = np.frombuffer(row["links"].as_buffer(), np.int32)
                layers, at = [], 0
                for k, size in enumerate(row["sizes"].as_py()):
                    layers.append(flat[at : at + size * LINKS * (1 if k else 2)].reshape(size, -1))
                    at += layers[-1].size
                queries = row["queries"].values
                names = queries.field("id").to_pylist()
                wanted = queries.field("vector").flatten().to_numpy().reshape(-1, dim)
                scale = np.abs(vectors).max()
                out: list[list] = [[], [], []]
                for begin, found in seek(vectors / scale, layers, wanted / scale, width):
                    for name, vector, nodes in zip(names[begin:], wanted[begin:], found, strict=False):
                        nodes = nodes[nodes >= 0]
                        gap = vectors[nodes] - vector
                        score = np.sqrt((gap * gap).sum(axis=1))
                        best = np.flatnonzero(score <= np.partition(score, min(nearest, len(score) - 1))[min(nearest, len(score) - 1)])
                        hits = sorted((s, v) for s, node in zip(score[best].tolist(), nodes[best].tolist(), strict=True) for v in ids[node])
                        for s, v in hits[: nearest + 1]:
                            for column, value in zip(out, (name, v, s), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, nearest: int = NEAREST,
    shard_rows: int = SHARD_ROWS, width: int = EF_SEARCH,
) -> DataFrame:
    """(query_id, rank, key, score): for each row whose key ``every`` divides, its ``nearest`` other rows by Euclidean distance.

    Equal vectors are one node, which keeps its least ``nearest + 1`` keys, as no more can be asked of
    it. Nodes are dealt by hash into shards of about ``shard_rows`` (fewer if they take more than
    SHARD_BYTES), each of which becomes a graph of its own: a row of flat arrays in the shared folder.
    Blocks of queries are then sought in every shard and the results merged. Candidates of a beam are
    measured in double precision on the original vectors. The graphs are approximate; tests hold
    their recall against brute force. A beam of ``width`` must not be below ``nearest + 1``.

    Keys are whole numbers. Rows without a key, and vectors that are null, empty, zero, or hold null or
    other than finite components, take no part. Only vectors of the query's own length are candidates.
    Rows that repeat a key are one row with several vectors, of which the nearest counts; they are no
    candidates of their own. Ties go to the smaller key. A query without candidates gives no rows, nor
    does an empty table. Other columns are not read.
    """
    if width <= nearest:
        raise ValueError(f"width must be above {nearest}, not {width}")
    sound = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        "id is not null and vector is not null and exists(vector, x -> x <> 0) "
        "and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    held = settle(sound.groupBy("id", "vector").agg(F.lit(1).alias("_one")).drop("_one").withColumn("dim", F.size("vector")))
    by_id = Window.partitionBy("vector").orderBy("id")
    least = held.withColumn("_nth", F.row_number().over(by_id)).where(F.col("_nth") <= nearest + 1)
    nodes = settle(least.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    dims = settle(nodes.groupBy("dim").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / most)))
    lengths = dims.count()
    dims = dims.select("dim", "shards")
    dealt = nodes.join(broadcast_if_small(dims, lengths), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))
    index = settle(build_shards(dealt))

    asked = held.where(F.col("id") % every == 0)
    sizes = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    asked = asked.join(broadcast_if_small(sizes, lengths), "dim").withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")))
    blocks = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    # A block goes to every shard of its length, and meets it by an ordinary join.
    blocks = blocks.join(broadcast_if_small(dims, lengths), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    met = index.join(blocks.select("dim", "shard", "queries"), ["dim", "shard"])
    found = search_shards(met, nearest, width).where("query_id <> vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    merged = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")
