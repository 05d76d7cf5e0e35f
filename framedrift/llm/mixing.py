"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import copy
import math
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import fold, settle

END = b"\n"  # no word holds white space
WORD_END = 0x20
CHUNK = 48  # bytes; longer words are coded in chunks, each from the starting context
TABLE_BITS = 18
TABLE = 1 << TABLE_BITS
ORDERS = 6  # none, one to four bytes, and the whole chunk so far
PLACES = np.arange(7, -1, -1, dtype=np.uint64)  # of a byte's bits, in the order of coding
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
PRIOR = 0.4  # added to either count of a context
GATES = 12
CURVE = 33  # points of a refinement curve over the stretched chance, -8 to 8
TALLIED = 300_000
SHARD = 200_000  # distinct words that fit one mixer, about
HOT_SHARE = 250_000  # words with over 1 / HOT_SHARE of all tokens are broadcast: at most so many
WORDS_AT_ONCE = 32_000  # words whose common beginnings are coded once
BYTES_AT_ONCE = 4 << 20  # of words, before fewer are taken
NODES_AT_ONCE = 4096
FITTED_AT_ONCE = 1000  # words between which the mixer learns, bit by bit
BEFORE = 3  # words before a word that its bits are predicted from
MOST_BITS = 21  # of a slot's number, for each of these contexts
FINE = 1025  # points of the mixed stretched chance, -8 to 8
STEPS_AT_ONCE = 32_000  # bits of words in order that are predicted together; between them the mixer learns
PIECE = 1 << 14  # slots of the tables that are added up as one row
TOKENS_A_TASK = 20_000_000  # about; below twice the cores, tables are not shared by tasks
TOKENS_AT_ONCE = 50_000  # of texts that are read together, but for longer ones
START = 0x5851F42D4C957F2D  # stands for the words before a text
CACHES = (10.0, 100.0, 1000.0, 1e6)  # weight of the corpus model against the text so far, in tokens
LN10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split() + [END]


def portions(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The tokens of the texts, about TOKENS_AT_ONCE at a time."""
    held, n = [], 0
    for t in texts:
        held.append(tokens(t))
        n += len(held[-1])
        if n >= TOKENS_AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _chunks(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    """The bytes to code, in chunks, and the word of each chunk."""
    chunks, of = [], []
    for i, w in enumerate(words):
        if w != END:
            w += b" "
        for at in range(0, len(w), CHUNK):
            chunks.append(w[at : at + CHUNK])
            of.append(i)
    return chunks, of


def _laid_out(chunks: list[bytes], order: list[int] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([chunks[i].ljust(CHUNK, b"\0") for i in order]), np.uint8).reshape(len(chunks), CHUNK)


def _contexts(before: list[np.ndarray], sofar: np.ndarray) -> np.ndarray:
    """[order, chunk]: the contexts of a byte, from the four bytes before, the last first, and the whole chunk so far."""
    context = np.empty((ORDERS, len(sofar)), np.uint64)
    context[0] = 1
    for k in range(4):
        context[k + 1] = (context[k] + before[k] + np.uint64(1)) * MIX[0]
    context[5] = sofar * MIX[1]
    context ^= context >> np.uint64(29)
    return context


def _slots(context: np.ndarray, byte: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots [order, bit, chunk] and the bits [bit, chunk] of a byte at the places, 7 the first bit and 0 the last."""
    at = places[:, None]
    node = (byte | np.uint64(256)) >> (at + np.uint64(1))
    slots = context[:, None] + node * MIX[2]
    slots *= MIX[1]
    slots >>= np.uint64(64 - TABLE_BITS)
    slots += (np.arange(ORDERS, dtype=np.uint64) * np.uint64(TABLE))[:, None, None]
    return slots.view(np.int64), ((byte >> at) & np.uint64(1)).view(np.int64)


class Coded:
    """Words as bytes to code, the chunks with most bytes first. ``of`` is the word of each chunk."""

    def __init__(self, words: list[bytes]):
        chunks, of = _chunks(words)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-sizes, kind="stable")
        self.sizes, self.of = sizes[order], np.array(of, np.int64)[order]
        self.codes = _laid_out(chunks, order)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(slots [order, bit, chunk], bits [bit, chunk], previous byte) for each byte of the chunks that have it.

        All bits of a byte come at once, or one by one where there are many chunks.
        """
        sofar = np.full(len(self.sizes), 7, np.uint64)
        before = [np.full(len(self.sizes), WORD_END, np.uint64)] * 4
        for j in range(int(self.sizes[0]) if len(self.sizes) else 0):
            n = int(np.searchsorted(-self.sizes, -j, side="left"))
            byte = self.codes[:n, j].astype(np.uint64)
            before, sofar = [b[:n] for b in before], sofar[:n]
            context = _contexts(before, sofar)
            for places in [PLACES] if n <= NODES_AT_ONCE else PLACES[:, None]:
                yield *_slots(context, byte, places), before[0].view(np.int64)
            before = [byte, *before[:3]]
            sofar = (sofar + byte + np.uint64(1)) * MIX[0]

    def decisions(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(slots [order, chunk], bit, previous byte) for each bit of each byte of the chunks that have it."""
        for slots, bits, last in self.steps():
            for k, bit in enumerate(bits):
                yield slots[:, k], bit, last


class Beginnings:
    """Words as bytes to code, in chunks sorted as bytes. Chunks that begin alike have these bytes coded once."""

    def __init__(self, words: list[bytes]):
        chunks, of = _chunks(words)
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        self.of = np.array(of, np.int64)[order]
        self.sizes = np.fromiter((len(chunks[i]) for i in order), np.int64, len(chunks))
        codes = _laid_out(chunks, order)
        # Bytes shared with the chunk before; equal ones share all.
        self.shared = np.zeros(len(chunks), np.int64)
        differs = codes[1:] != codes[:-1]
        self.shared[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), CHUNK), self.sizes[:-1])
        self.codes = np.ascontiguousarray(codes.T)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(slots [order, bit, node], bits [bit, node], previous byte, chunks of each node, their places in ``of``).

        A node is a byte with all that comes before it in a chunk; the chunks that have it lie side by side.
        """
        sofar = np.full(len(self.sizes), 7, np.uint64)
        for j in range(int(self.sizes.max(initial=0))):
            alive = np.flatnonzero(self.sizes > j)
            first = np.flatnonzero(self.shared[alive] <= j)
            ends = np.append(first[1:], len(alive))
            for at in range(0, len(first), NODES_AT_ONCE):
                some, last = first[at : at + NODES_AT_ONCE], ends[at : at + NODES_AT_ONCE]
                nodes = alive[some]
                byte = self.codes[j, nodes].astype(np.uint64)
                before = [
                    self.codes[j - k, nodes].astype(np.uint64) if j >= k else np.full(len(nodes), WORD_END, np.uint64) for k in range(1, 5)
                ]
                slots, bits = _slots(_contexts(before, sofar[nodes]), byte, PLACES)
                yield slots, bits, before[0].view(np.int64), last - some, alive[some[0] : last[-1]]
            sofar[alive] = (sofar[alive] + self.codes[j, alive] + np.uint64(1)) * MIX[0]


def tally(words: list[bytes]) -> np.ndarray:
    """Counts [slot, bit] of all contexts of the words."""
    out = np.zeros(2 * ORDERS * TABLE, np.int64)
    for at in range(0, len(words), WORDS_AT_ONCE):
        for slots, bits, _, times, _ in Beginnings(words[at : at + WORDS_AT_ONCE]).steps():
            slots += slots
            slots += bits
            np.add.at(out, slots.ravel(), np.broadcast_to(times, slots.shape).ravel())
    return out.astype(np.float32)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about WORDS_AT_ONCE, or fewer once these have BYTES_AT_ONCE; no batch is empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS_AT_ONCE or sum(b.nbytes for b in held) >= BYTES_AT_ONCE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _point(x: np.ndarray) -> np.ndarray:
    """The point of a refinement curve next to a stretched chance."""
    return np.rint((x + 8) * ((CURVE - 1) / 16)).astype(np.int64)


class BitMixer:
    """Chance of a word that may be new: each bit of its bytes, mixed from the contexts' counts.

    ``weights[gate]`` mix the contexts' stretched chances; the gate is how often the chunk so far and
    the last three bytes have been seen. ``curve`` then refines the mixed chance by the byte before.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(-1, 2)
        self.weights = np.full((GATES, ORDERS), 0.3)
        self.squares = np.full((GATES, ORDERS), 1e-2)
        self.seen = BitMixer.before()
        self.freeze()

    @staticmethod
    def before() -> np.ndarray:
        """The curve's outcomes [previous byte, point, bit] before any word: twenty that fit the mixed chance."""
        points = _squash(np.linspace(-8, 8, CURVE))
        return np.stack([1 - points, points], axis=1)[None].repeat(256, axis=0) * 20

    def freeze(self) -> None:
        total = self.counts.sum(axis=1)
        self.stretched = np.log((self.counts[:, 1] + PRIOR) / (self.counts[:, 0] + PRIOR)).astype(np.float32)
        level = np.searchsorted([1, 3, 16], total, side="right").astype(np.int8)
        level[: 5 * TABLE] = np.minimum(level[: 5 * TABLE], 2)
        self.level = level
        self.curve = self.seen[:, :, 1] / self.seen.sum(axis=2)

    def _mixed(self, inputs: np.ndarray, gate: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = sum(self.weights[:, i].take(gate) * inputs[i] for i in range(ORDERS))
        x = np.clip(x, -8, 8)
        point = _point(x)
        mixed = _squash(x)
        return mixed, point, np.clip((mixed + self.curve.take(last * CURVE + point)) / 2, 1e-6, 1 - 1e-6)

    def fit(self, words: list[bytes]) -> None:
        """Online: after each bit, the weights of its gate follow the error, and the curve its outcome.

        The words are among those counted, so each is taken out of the counts it is predicted from.
        """
        # [bit, slot]: stretched chance and level without one occurrence of the bit.
        fewer = [np.stack([np.maximum(self.counts[:, k] - (k == bit), 0) for k in (0, 1)]) for bit in (0, 1)]
        stretched = np.concatenate([np.log((n[1] + PRIOR) / (n[0] + PRIOR)) for n in fewer]).astype(np.float32)
        level = np.concatenate([np.searchsorted([1, 3, 16], n.sum(axis=0), side="right") for n in fewer]).astype(np.int8)
        del fewer
        for at in range(0, len(words), FITTED_AT_ONCE):
            for slots, bits, last in Coded(words[at : at + FITTED_AT_ONCE]).steps():
                slots = slots + bits * len(self.counts)
                inputs = stretched.take(slots).astype(np.float64)  # [order, bit, chunk]
                gates = np.minimum(level.take(slots[3]), 2).astype(np.int64) * 4 + level.take(slots[5])
                chunks = np.arange(len(last))
                x = np.empty(bits.shape)
                for k, (gate, bit) in enumerate(zip(gates, bits, strict=True)):
                    x[k] = (self.weights @ inputs[:, k])[gate, chunks].clip(-8, 8)
                    chosen = np.zeros((GATES, len(gate)))
                    chosen[gate, chunks] = bit - _squash(x[k])
                    slope = chosen @ inputs[:, k].T
                    self.squares += slope**2
                    self.weights += 0.05 * slope / np.sqrt(self.squares)
                cells = (last * CURVE + _point(x)) * 2 + bits
                self.seen += np.bincount(cells.ravel(), minlength=self.seen.size).reshape(self.seen.shape)
        self.freeze()

    def learned(self, words: int) -> np.ndarray:
        """What ``fit`` has learned from so many words, as an array that may be added up over mixers."""
        return np.concatenate([[words], (self.weights * words).ravel(), (self.seen - BitMixer.before()).ravel()])

    def take(self, learned: np.ndarray) -> None:
        """The mean weights, by words, of the mixers in the sum, and all that their curves have seen."""
        words, weights, seen = np.split(learned, [1, 1 + self.weights.size])
        if words[0]:
            self.weights = (weights / words[0]).reshape(self.weights.shape)
            self.seen = BitMixer.before() + seen.reshape(self.seen.shape)
        self.freeze()

    def log10_chance(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), WORDS_AT_ONCE):
            coded = Beginnings(words[at : at + WORDS_AT_ONCE])
            logs = np.zeros(len(coded.of))
            for slots, bits, last, times, chunks in coded.steps():
                gate = self.level.take(slots[3]).astype(np.int64) * 4 + self.level.take(slots[5])
                chance = self._mixed(self.stretched.take(slots), gate, last)[2]
                of_byte = np.where(bits == 1, chance, 1 - chance).prod(axis=0)
                logs[chunks] += np.repeat(np.log10(of_byte), times)
            np.add.at(out, at + coded.of, logs)
        return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series after eight steps up."""
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log10_rising(log10_a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of a (a + 1) ... (a + n - 1), n at least 1; a may be tiny."""
    one_up = 10.0**log10_a + 1
    return log10_a + np.where(n > 1, (_log_gamma(one_up + n - 1) - _log_gamma(one_up)) / LN10, 0)


def count_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, c, n): tokens of training rows, and of all rows. Partial counts leave a task at bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            held, trained = both
            words = list(held.keys() | trained.keys())
            c = [trained[w] for w in words]
            n = [held[w] + x for w, x in zip(words, c, strict=True)]
            held.clear()
            trained.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for batch in batches:
            for t, trained in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[trained].update(tokens(t))
                if len(both[0]) + len(both[1]) > TALLIED:
                    yield rows()
        yield rows()

    found = docs.select(F.col(text).alias("_text"), (fold(key) != 1).alias("_train")).mapInArrow(run, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learn(words: DataFrame, distinct: int) -> BitMixer:
    """Context counts over all distinct training words, and a mixer fitted on all of them.

    Each word counts once, as the mixer is there for words that the corpus does not hold. The counts
    are tables of fixed size, added up over the tasks in a tree. Words are dealt by hash to shards of
    about SHARD; each fits a mixer of its own, in the order of their hashes, and the weights of these
    are averaged, what their curves have seen added up, in a tree as well.
    """
    known = words.where("c > 0").select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * ORDERS * TABLE, np.float32)
        for batch in joined(batches):
            out += tally(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["counts"])

    if not distinct:
        return BitMixer(np.zeros(2 * ORDERS * TABLE, np.float32))
    parts = known.mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.float32))
    mixer = BitMixer(parts.treeReduce(np.add, 3))
    counts = words.sparkSession.sparkContext.broadcast(mixer.counts)

    def fit(shard: pa.Table) -> pa.Table:
        own = BitMixer(counts.value)
        ordered = shard.sort_by([("_h", "ascending"), ("word", "ascending")]).column("word").to_pylist()
        own.fit(ordered)
        return pa.table({"learned": pa.array([own.learned(len(ordered)).tobytes()], pa.binary())})

    shards = -(-distinct // SHARD)
    dealt = known.withColumn("_h", F.xxhash64("word")).withColumn("_shard", F.pmod("_h", F.lit(shards)))
    fitted = dealt.repartition(shards, "_shard").groupBy("_shard").applyInArrow(fit, "learned binary")
    mixer.take(fitted.rdd.map(lambda r: np.frombuffer(r[0], np.float64)).treeReduce(np.add, 3))
    return mixer


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Huffman tree over symbols by their counts: (where each symbol's steps start, twice a node plus its bit for each step)."""
    order = np.argsort(counts, kind="stable")
    size = len(counts)
    above, side = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.int64)
    leaves, inner = deque(zip(counts[order].tolist(), order.tolist(), strict=True)), deque()
    for node in range(size, 2 * size - 1):
        least = [(inner if not leaves or (inner and inner[0][0] < leaves[0][0]) else leaves).popleft() for _ in range(2)]
        for bit, (_, x) in enumerate(least):
            above[x], side[x] = node, bit
        inner.append((least[0][0] + least[1][0], node))
    symbols, at, levels = np.arange(size), np.arange(size), []
    while size > 1 and len(symbols):
        levels.append((symbols, (above[at] - size) * 2 + side[at]))
        at = above[at]
        below = at < 2 * size - 2
        symbols, at = symbols[below], at[below]
    starts = np.zeros(size + 1, np.int64)
    for some, _ in levels:
        starts[some + 1] += 1
    starts = np.cumsum(starts)
    steps = np.zeros(starts[-1], np.int32)
    for depth, (some, step) in enumerate(levels):
        steps[starts[some] + depth] = step
    return starts, steps


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched chances in 1/256, and in the last two bits how often the slot was seen."""
    level = np.searchsorted([1, 3, 16], zeros + ones, side="right")
    stretched = np.log((ones + PRIOR) / (zeros + PRIOR)).clip(-16, 16)
    return ((np.rint(stretched * 256).astype(np.int64) << 2) + level).astype(np.int16)


def with_fewer(counts: np.ndarray) -> list[np.ndarray]:
    """Tables of counts [slot, bit], and those without one zero and without one one."""
    zeros, ones = counts.T
    return [packed(zeros, ones), packed(np.maximum(zeros - 1, 0), ones), packed(zeros, np.maximum(ones - 1, 0))]


class Frequent:
    """Words that every task holds. The first ``coded`` of them have a symbol of their own, all others share the last one."""

    def __init__(self, words: list[bytes], c: np.ndarray, p: np.ndarray, coded: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.c, self.p, self.coded = c, p, coded
        self.end = self.index.get(END, Frequent.unknown(END))

    @staticmethod
    def unknown(word: bytes) -> int:
        return -1 - (xxhash.xxh64_intdigest(word) & 0xFFFF)

    def numbers(self, flat: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Tokens as numbers, those of other words by hash and below zero, and the places of these."""
        found = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int32, len(flat))
        others = np.flatnonzero(found < 0).tolist()
        found[others] = [Frequent.unknown(flat[i]) for i in others]
        return found, others

    def sequence(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens of whole texts, one after the other: symbol, contexts [word before, token], text."""
        symbols = np.where((numbers < 0) | (numbers >= self.coded), self.coded, numbers)
        ends = np.flatnonzero(numbers == self.end)
        firsts = np.append(0, ends[:-1] + 1)
        names = (numbers.astype(np.int64).view(np.uint64) + MIX[1]) * MIX[2]
        contexts = np.empty((BEFORE, len(numbers)), np.uint64)
        sofar = np.ones(len(numbers), np.uint64)
        for k in range(BEFORE):
            names[1:] = names[:-1].copy()
            names[firsts] = START
            sofar += names
            sofar *= MIX[0]
            sofar ^= sofar >> np.uint64(29)
            contexts[k] = sofar * MIX[1]
        return symbols, contexts, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))


class OrderMixer:
    """Chance of a symbol after the words before it: each bit of its way down a Huffman tree, mixed from contexts' counts.

    A bit is predicted from its node alone and from its node after one, two and three words, whatever
    these are. ``weights[gate]`` mix the stretched chances; the gate is how often the node has been
    seen after one word and after two. ``curve`` then refines the mixed chance by the gate.
    """

    GATES = 16

    def __init__(self, counts: np.ndarray, bits: int):
        self.starts, self.steps = tree(counts)
        self.sizes = np.diff(self.starts)
        self.nodes, self.bits = len(counts) - 1, bits
        self.size = self.nodes + (BEFORE << bits)
        self.alone = np.bincount(self.steps, np.repeat(counts, self.sizes), 2 * self.nodes).reshape(-1, 2)
        self.forget()

    def forget(self) -> None:
        self.weights = np.full((self.GATES, BEFORE + 1), 0.3)
        self.squares = np.full((self.GATES, BEFORE + 1), 1e-2)
        self.bits_seen = 0
        self.seen = OrderMixer.before()
        self.freeze()

    def fresh(self) -> OrderMixer:
        """One for the same symbols that has learned nothing."""
        other = copy.copy(self)
        other.forget()
        return other

    @staticmethod
    def before() -> np.ndarray:
        """The curve's outcomes [gate, point, bit] before any text: twenty that fit the mixed chance."""
        points = _squash(np.linspace(-8, 8, CURVE))
        return np.stack([1 - points, points], axis=1)[None].repeat(OrderMixer.GATES, axis=0) * 20

    def freeze(self) -> None:
        curve = self.seen[:, :, 1] / self.seen.sum(axis=2)
        x = np.linspace(-8, 8, FINE)
        self.chances = ((_squash(x) + curve[:, _point(x)]) / 2).clip(1e-6, 1 - 1e-6)

    def blocks(self, symbols: np.ndarray, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
        """(slots [context, step], bits, first step of each token, tokens), about STEPS_AT_ONCE steps at once."""
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        at = 0
        while self.nodes and at < len(symbols):
            done = ends[at - 1] if at else 0
            some = slice(at, max(at + 1, int(np.searchsorted(ends, done + STEPS_AT_ONCE, side="right"))))
            n = sizes[some]
            firsts = ends[some] - n - done
            step = self.steps.take(np.repeat(self.starts[symbols[some]] - firsts, n) + np.arange(n.sum()))
            slots = np.empty((BEFORE + 1, len(step)), np.int64)
            node = slots[0]
            np.right_shift(step, 1, out=node)
            hashed = np.repeat(contexts[:, some], n, axis=1)
            hashed += node.view(np.uint64) * MIX[2]
            hashed >>= np.uint64(64 - self.bits)
            slots[1:] = hashed.view(np.int64)
            slots[1:] += (self.nodes + (np.arange(BEFORE) << self.bits))[:, None]
            yield slots, step & 1, firsts, some
            at = some.stop

    def tally(self, counts: np.ndarray, symbols: np.ndarray, contexts: np.ndarray) -> None:
        """Adds to counts [slot, bit] of nodes after words; those of nodes alone follow from the symbols'."""
        flat = counts.reshape(-1)
        for slots, bits, _, _ in self.blocks(symbols, contexts):
            at = slots[1:] - self.nodes
            at += at
            at += bits
            np.add.at(flat, at.ravel(), np.int32(1))  # a Python number would be several times slower

    def _mixed(self, table: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched chances of the contexts in 1/256, gate, and the mixed one as one of FINE points."""
        found = table.take(slots)
        gate = (((found[1] & 3) << 2) + (found[2] & 3)).astype(np.int64)
        inputs = (found >> 2).astype(np.float32)
        weights = (self.weights.T * ((FINE - 1) / 16 / 256)).astype(np.float32)
        x = sum(w.take(gate) * i for w, i in zip(weights, inputs, strict=True))
        x += (FINE - 1) / 2
        return inputs, gate, np.rint(x.clip(0, FINE - 1)).astype(np.int64)

    def fit(self, fewer: np.ndarray, symbols: np.ndarray, contexts: np.ndarray) -> None:
        """Online. ``fewer`` [bit * slots]: the tables without one occurrence of the bit, as the texts are among those counted."""
        squashed = _squash(np.linspace(-8, 8, FINE)).astype(np.float32)
        points = _point(np.linspace(-8, 8, FINE)) * 2
        for slots, bits, _, _ in self.blocks(symbols, contexts):
            inputs, gate, x = self._mixed(fewer, slots + bits * self.size)
            error = bits - squashed.take(x)
            slope = np.stack([np.bincount(gate, error * i, self.GATES) for i in inputs], axis=1) / 256
            self.squares += slope**2
            self.weights += 0.05 * slope / np.sqrt(self.squares)
            gate *= 2 * CURVE
            gate += points.take(x)
            gate += bits
            self.seen += np.bincount(gate, minlength=self.seen.size).reshape(self.seen.shape)
            self.bits_seen += len(bits)

    def learned(self) -> np.ndarray:
        """What ``fit`` has learned, as an array that may be added up over mixers."""
        return np.concatenate([[self.bits_seen], (self.weights * self.bits_seen).ravel(), (self.seen - OrderMixer.before()).ravel()])

    def take(self, learned: np.ndarray) -> None:
        """The mean weights, by bits, of the mixers in the sum, and all that their curves have seen."""
        bits, weights, seen = np.split(learned, [1, 1 + self.weights.size])
        if bits[0]:
            self.weights = (weights / bits[0]).reshape(self.weights.shape)
            self.seen = OrderMixer.before() + seen.reshape(self.seen.shape)
        self.freeze()

    def chance(self, table: np.ndarray, symbols: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols))
        for slots, bits, firsts, some in self.blocks(symbols, contexts):
            _, gate, x = self._mixed(table, slots)
            gate *= FINE
            gate += x
            one = self.chances.take(gate)
            out[some] = np.multiply.reduceat(np.abs(one - (1 - bits)), firsts)
        return out


def learn_order(texts: DataFrame, frequent: Broadcast, counts: np.ndarray, total: int) -> tuple[OrderMixer, np.ndarray]:
    """A mixer for the symbols of texts in order, and its tables, from all ``texts``, whose tokens are ``total``.

    Tables are of a size that follows the tokens up to MOST_BITS. Tasks add to tables of their own;
    these are added up piece by piece. Then each task fits a mixer along its texts, whose weights are
    averaged, what their curves have seen added up, in a tree.
    """
    mixer = OrderMixer(counts, min(MOST_BITS, max(PIECE.bit_length() - 1, total.bit_length())))
    pieces = (BEFORE << mixer.bits) // PIECE
    context = texts.sparkSession.sparkContext
    bare = context.broadcast(mixer)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for some in portions(batch.column(0).to_pylist()):
                numbers, _ = frequent.value.numbers([w for words in some for w in words])
                rows.append(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())  # packs better by places
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["numbers"])

    numbered = settle(texts.mapInArrow(number, "numbers binary")).coalesce(max(2 * context.defaultParallelism, total // TOKENS_A_TASK))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.column(0):
                numbers = np.ascontiguousarray(np.frombuffer(row.as_buffer(), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
                yield frequent.value.sequence(numbers)[:2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((pieces * PIECE, 2), np.int32)
        for symbols, contexts in sequences(batches):
            bare.value.tally(sums, symbols, contexts)
        for i, piece in enumerate(sums.reshape(pieces, -1)):
            if piece.any():
                large = np.flatnonzero(piece > 255).astype(np.int32)
                columns = [np.minimum(piece, 255).astype(np.uint8), large, piece[large] - 255]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], ["piece", "counts", "large", "over"])

    def add(found: pa.Table) -> pa.Table:
        sums = np.zeros(2 * PIECE, np.int64)
        for x, large, over in zip(*[found.column(n) for n in ("counts", "large", "over")], strict=True):
            sums += np.frombuffer(x.as_buffer(), np.uint8)
            sums[np.frombuffer(large.as_buffer(), np.int32)] += np.frombuffer(over.as_buffer(), np.int32)
        return pa.table({"piece": found.column("piece")[:1]} | {n: pa.array([t.tobytes()], pa.binary()) for n, t in zip(names, with_fewer(sums.reshape(-1, 2)), strict=True)})

    names = ["whole", "less0", "less1"]
    added = numbered.mapInArrow(count, "piece int, counts binary, large binary, over binary").groupBy("piece")
    added = added.applyInArrow(add, "piece int, whole binary, less0 binary, less1 binary").toArrow()
    tables = np.zeros((3, mixer.size), np.int16)
    tables[:, : mixer.nodes] = with_fewer(mixer.alone)
    for k, name in enumerate(names):
        after = tables[k, mixer.nodes :].reshape(pieces, PIECE)
        for i, table in zip(added.column("piece").to_pylist(), added.column(name), strict=True):
            after[i] = np.frombuffer(table.as_buffer(), np.int16)
    fewer = context.broadcast(tables[1:].reshape(-1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bare.value.fresh()
        for symbols, contexts in sequences(batches):
            own.fit(fewer.value, symbols, contexts)
        yield pa.RecordBatch.from_arrays([pa.array([own.learned().tobytes()], pa.binary())], ["learned"])

    fitted = numbered.mapInArrow(fit, "learned binary").rdd.map(lambda r: np.frombuffer(r[0], np.float64))
    mixer.take(fitted.treeReduce(np.add, 2))
    fewer.unpersist()
    bare.unpersist()
    return mixer, tables[0].copy()


def _times_before(of: np.ndarray, symbols: np.ndarray, coded: int) -> np.ndarray:
    """How often the symbol of each token came before in its text."""
    keys = of * (coded + 1) + symbols
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    at = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", in_order: bool = False) -> DataFrame:
    """One row per row of ``docs``: its unigram baseline and the model's log10 chance of its text.

    Tokens are words between ASCII white space, A-Z lower-cased, and an end; null texts are one end.
    Rows whose crc32(key) mod 5 is not 1 are learned from. A word the corpus holds c times of N has
    its count less a discount; what the discounts of all words leave goes to the bit mixer, which
    codes any word bit by bit (see BitMixer). A text's chance is adaptive: a token has chance
    (a P + k) / (a + t), P being that model, k its own count among the t tokens before; the chances
    under several a are averaged over whole texts, so the better a gains weight as it is read. This
    does not depend on the order of tokens, so a text is a sum over its distinct words.

    With ``in_order``, P depends on the words before. Words with over 1 / HOT_SHARE of the training
    tokens have symbols of their own, the others share one; the bits of the symbols of a text are mixed
    in order from contexts of up to BEFORE words (see OrderMixer), learned from all training texts. A
    word without a symbol of its own then has its chance among those by counts and letters, as above,
    and is counted among those of its text in the same way.

    Words with over 1 / HOT_SHARE of all tokens, at most HOT_SHARE, are broadcast; texts are joined to
    the others by word, and none of these is frequent. Repeated rows are scored one by one; null keys
    count as ''. Other columns are not read; without training rows all chances are even. Returns
    (key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).
    """
    spark = docs.sparkSession
    # Sorted, as neighbours then share most of their bytes.
    counted = settle(count_words(docs, key, text).sortWithinPartitions("word"))
    sums = counted.agg(F.sum("c").alias("N"), F.sum((F.col("c") > 0).cast("long")).alias("V"), F.sum("n").alias("n"),
        *[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2)]).first()
    total, distinct, everything = sums.N or 0, sums.V or 0, sums.n or 0
    # Absolute discounting; the mass it leaves sums all chances to one.
    discount = min(0.95, max(0.1, sums.n1 / max(1, sums.n1 + 2 * sums.n2)))
    left = math.log10(discount * distinct / total) if total else 0.0
    shared = spark.sparkContext.broadcast(learn(counted, distinct))

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            new = left + shared.value.log10_chance(batch.column(0).to_pylist())
            held = np.maximum(batch.column(1).to_numpy() - discount, 0) / max(1, total)
            found = np.log10(held + 10.0 ** np.maximum(new, -300))
            found = np.where(held > 0, found, new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["word", "c", "n", "p"])

    words = settle(counted.mapInArrow(chances, "word binary, c long, n long, p double"))
    hot_at = max(2, everything // HOT_SHARE + 1)
    coded_at = max(2, total // HOT_SHARE + 1)
    is_hot = (F.col("n") >= hot_at) | F.lit(in_order) & (F.col("c") >= coded_at)
    hot_rows = words.where(is_hot).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    hot_c, hot_p = hot_rows["c"].to_numpy(), hot_rows["p"].to_numpy()
    coded = int((hot_c >= coded_at).sum()) if in_order else 0
    hot = spark.sparkContext.broadcast(Frequent(hot_rows["word"].to_pylist(), hot_c, hot_p, coded))
    # Of the model of single words: log10 of what the words without a symbol of their own have.
    others = math.log10(max(1e-9, 1 - float((10.0 ** hot_p[:coded]).sum()))) if coded else 0.0
    ordered = None
    if in_order:
        symbols = np.append(hot_c[:coded], max(1, total - int(hot_c[:coded].sum())))
        training = docs.where(fold(key) != 1).select(F.col(text).alias("_text"))
        ordered = spark.sparkContext.broadcast(learn_order(training, hot, symbols, total))
    names = [f"s{i}" for i in range(len(CACHES))]
    kind = docs.schema[key].dataType.simpleString()

    def laid_out(batch: pa.RecordBatch, row: int, rare: tuple, sizes, bytes_of, known, base, per_cache) -> pa.RecordBatch:
        rows = batch.num_rows
        # A key of its own spreads these rows; it is no word, so it meets none.
        own = [b"\n" + xxhash.xxh64_digest((row + i).to_bytes(8, "little")) for i in range(rows)]
        (rows_of, words_of, times_of), r = rare, np.arange(row, row + rows)
        n = len(words_of)
        nothing = lambda kind: pa.nulls(n, kind)
        many = lambda a, b: pa.concat_arrays([a, b])
        return pa.RecordBatch.from_arrays(
            [
                many(pa.array(rows_of, pa.int64()), pa.array(r, pa.int64())),
                many(pa.array(words_of, pa.binary()), pa.array(own, pa.binary())),
                many(pa.array(times_of, pa.int32()), pa.array(np.zeros(rows, np.int32))),
                many(nothing(batch.column(0).type), batch.column(0)),
                many(nothing(pa.bool_()), batch.column(2)),
                many(nothing(pa.int64()), pa.array(np.array(sizes, np.int64), pa.int64())),
                many(nothing(pa.int64()), pa.array(np.array(bytes_of, np.int64), pa.int64())),
                many(nothing(pa.int64()), pa.array(known)),
                many(nothing(pa.float64()), pa.array(base)),
                *[many(nothing(pa.float64()), pa.array(s)) for s in per_cache],
            ],
            ["row", "word", "times", "_key", "held_out", "n_tokens", "n_bytes", "n_known", "base", *names],
        )

    def along(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        """What ``split`` returns, the chances of symbols taken in order."""
        texts, done, frequent = batch.column(1).to_pylist(), 0, hot.value
        mixer, table = ordered.value
        for some in portions(texts):
            rows = len(some)
            flat = [w for words in some for w in words]
            numbers, unknown = frequent.numbers(flat)
            symbols, contexts, of = frequent.sequence(numbers)
            chance = mixer.chance(table, symbols, contexts)
            times_before = _times_before(of, symbols, frequent.coded)
            add = lambda i, v: np.bincount(of[i], v, minlength=rows)
            size, met = np.bincount(of, minlength=rows).astype(np.float64), np.flatnonzero(numbers >= 0)
            known = add(met, frequent.c[numbers[met]] > 0).astype(np.int64)
            base = add(met, np.log10(frequent.c[numbers[met]] + 0.5))
            # Words without a symbol of their own: those held here, by text and number, and the rare ones.
            shared = np.flatnonzero(symbols == frequent.coded)
            n_shared = np.bincount(of[shared], minlength=rows)
            held, times = np.unique(np.stack([of, numbers])[:, shared[numbers[shared] >= 0]], axis=1, return_counts=True)
            per_cache = []
            for a in CACHES:
                gained = np.bincount(of, np.log10(a * chance + times_before), minlength=rows) - log10_rising(np.full(rows, math.log10(a)), size)
                gained += np.bincount(held[0], log10_rising(math.log10(a) + frequent.p[held[1]] - others, times), minlength=rows)
                gained -= np.where(n_shared, log10_rising(np.full(rows, math.log10(a)), n_shared), 0)
                per_cache.append(gained)
            rare_words, rare_times, kinds = [], [], np.empty(rows, np.int64)
            others_of = map(flat.__getitem__, unknown)
            for i, n in enumerate(np.bincount(of[unknown], minlength=rows).tolist()):
                found = Counter(islice(others_of, n))
                rare_words += found
                rare_times += found.values()
                kinds[i] = len(found)
            rare = np.repeat(np.arange(row + done, row + done + rows), kinds), rare_words, rare_times
            bytes_of = [len((t or "").encode()) for t in texts[done : done + rows]]
            yield laid_out(batch.slice(done, rows), row + done, rare, size, bytes_of, known, base, per_cache)
            done += rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, word, times) of rare words, and one row of each text with the sums over its hot words."""
        row = TaskContext.get().partitionId() << 32
        index, hot_c, hot_p = hot.value.index, hot.value.c, hot.value.p
        for batch in batches:
            if in_order:
                yield from along(batch, row)
                row += batch.num_rows
                continue
            rare: tuple[list, list, list] = [], [], []
            at, of, times, sizes, bytes_of = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = tokens(t)
                sizes.append(len(words))
                bytes_of.append(len((t or "").encode()))
                for w, n in Counter(words).items():
                    j = index.get(w)
                    if j is None:
                        for column, value in zip(rare, (row + i, w, n), strict=True):
                            column.append(value)
                    else:
                        at.append(j)
                        of.append(i)
                        times.append(n)
            size, rows = np.array(sizes, np.float64), batch.num_rows
            at, of, times = np.array(at, np.int64), np.array(of, np.int64), np.array(times, np.int64)
            add = lambda v: np.bincount(of, v, minlength=rows)
            known = add(np.where(hot_c[at] > 0, times, 0)).astype(np.int64) if len(at) else np.zeros(rows, np.int64)
            base = add(times * np.log10(hot_c[at] + 0.5)) if len(at) else np.zeros(rows)
            per_cache = []
            for a in CACHES:
                gained = add(log10_rising(math.log10(a) + hot_p[at], times)) if len(at) else np.zeros(rows)
                per_cache.append(gained - log10_rising(np.full(rows, math.log10(a)), size))
            yield laid_out(batch, row, rare, sizes, bytes_of, known, base, per_cache)
            row += rows

    schema = f"row long, word binary, times int, _key {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, base double"
    schema += "".join(f", {n} double" for n in names)
    parts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (fold(key) == 1).alias("_held")).mapInArrow(split, schema)
    met = parts.join(words.where(~is_hot).select("word", "c", (F.col("p") - F.lit(others)).alias("p")).hint("shuffle_hash"), "word", "left")

    def rare_gain(a: float) -> Column:
        first = F.col("p") + math.log10(a)
        rest = F.expr(f"aggregate(sequence(1, times - 1), 0D, (x, j) -> x + log10({a!r}D * power(10D, p) + j))")
        return F.when(F.col("times") == 1, first).when(F.col("times") > 1, first + rest)

    gained = met.select(
        "row", "_key", "held_out", "n_tokens", "n_bytes",
        F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times").cast("long"))).alias("n_known"),
        F.coalesce("base", F.col("times") * F.log10(F.col("c") + 0.5)).alias("base"),
        *[F.coalesce(n, rare_gain(a)).alias(n) for n, a in zip(names, CACHES, strict=True)],
    )
    sums_of = ["n_tokens", "n_bytes", "n_known", "base", *names]
    texts = gained.groupBy("row").agg(
        F.max("_key").alias("_key"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in sums_of]
    )
    best = F.greatest(*names)
    score = best + F.log10(sum((F.pow(F.lit(10.0), F.col(n) - best) for n in names), F.lit(0.0)) / len(names))
    per_token = math.log10(total + 0.5 * (distinct + 1))
    return texts.withColumn("score", score).select(
        F.col("_key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
