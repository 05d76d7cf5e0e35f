import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framedrift.llm import mixing, queries
from tests.llm.material import ODD, prose, table


def trained_mixer():
    words = sorted({w.encode() for i in range(40) for w in prose(i, 50).split()} | {mixing.END})
    mixer = mixing.BitMixer(mixing.tally(words))
    mixer.fit(words)
    return mixer, words


def test_chances_of_all_continuations_sum_to_one():
    """Over all bytes that may follow, the chances of the one-byte chunks sum to one."""
    mixer, _ = trained_mixer()
    coded = mixing.Coded([])
    chunks = [bytes([b]) for b in range(256)]
    coded.sizes, coded.of = np.ones(256, np.int64), np.arange(256)
    coded.codes = np.frombuffer(b"".join(c.ljust(mixing.CHUNK, b"\0") for c in chunks), np.uint8).reshape(256, -1)
    logs = np.zeros(256)
    for slots, bit, last in coded.decisions():
        gate = mixer.level[slots[3]].astype(np.int64) * 4 + mixer.level[slots[5]]
        chance = mixer._mixed(mixer.stretched[slots], gate, last)[2]
        logs += np.log(np.where(bit == 1, chance, 1 - chance))
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-6)


def test_mixer_prefers_words_like_those_it_knows():
    mixer, words = trained_mixer()
    like = [w.encode() for w in prose(999, 200).split()]
    unlike = [bytes(reversed(w)) + b"q" for w in like]
    assert mixer.log10_chance(like).mean() > mixer.log10_chance(unlike).mean() + 3
    single = [mixer.log10_chance([w])[0] for w in like[:20]]
    assert np.allclose(single, mixer.log10_chance(like[:20]))
    assert np.isfinite(mixer.log10_chance([b"x" * 5000, b"", mixing.END])).all()


def test_rising_factorial():
    for a in (1e-9, 0.3, 10.0, 1e5):
        for n in (1, 2, 7, 300):
            exact = sum(math.log10(a + j) for j in range(n))
            assert math.isclose(mixing.log10_rising(np.array([math.log10(a)]), np.array([n]))[0], exact, rel_tol=1e-9, abs_tol=1e-7)


@pytest.mark.parametrize("hot_share", [10, 250_000])
def test_scores_against_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(mixing, "HOT_SHARE", hot_share)
    texts = ODD + [prose(i, 30) + " the the the" for i in range(60)] + ["The THE the"]
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    count, every = Counter(), Counter()
    for i, t in pairs:
        every.update(mixing.tokens(t))
        if fold(i) != 1:
            count.update(mixing.tokens(t))
    total, distinct = sum(count.values()), len(count)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    words = sorted(every)
    counts = mixing.tally(sorted(count))
    mixer = mixing.BitMixer(counts)
    rows = mixing.score_texts(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    # The words fit the mixer in the order of their hashes, as the operator draws them.
    order = spark.createDataFrame([(bytearray(w),) for w in count], "word binary").selectExpr("word", "xxhash64(word) h").orderBy("h", "word")
    mixer.fit([bytes(r.word) for r in order.collect()])
    new = dict(zip(words, mixer.log10_chance(words), strict=True))
    chance = {w: max(count[w] - discount, 0) / total + discount * distinct / total * 10 ** new[w] for w in words}
    want = []
    for i, t in pairs:
        tokens = mixing.tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        sums = []
        for a in mixing.CACHES:
            seen, s = Counter(), 0.0
            for n, w in enumerate(tokens):
                s += math.log10((a * chance[w] + seen[w]) / (a + n))
                seen[w] += 1
            sums.append(s)
        score = max(sums) + math.log10(sum(10 ** (s - max(sums)) for s in sums) / len(sums))
        want.append((str(i), fold(i) == 1, len(tokens), sum(count[w] > 0 for w in tokens), total, base, score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5), (g, w)


def test_empty_tables(spark):
    assert mixing.score_texts(table(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = mixing.score_texts(table(spark, [(held, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score < 0


def test_mixer_is_fitted_on_every_training_word(spark, monkeypatch):
    """Shards of the words fit mixers of their own; their weights are averaged, and no word is left out."""
    monkeypatch.setattr(mixing, "SHARD", 60)
    words = sorted({w.encode() for i in range(40) for w in prose(i, 50).split()} | {mixing.END, b"long" * 40})
    rows = [(bytearray(w), 1) for w in words] + [(bytearray(b"heldout"), 0)]
    mixer = mixing.learn(spark.createDataFrame(rows, "word binary, c long"), len(words))
    counts = mixing.tally(words)
    order = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").selectExpr("word", "xxhash64(word) h").orderBy("h", "word").collect()
    shards = -(-len(words) // 60)
    assert shards > 1
    weights, seen, bits = 0, mixing.BitMixer.before(), 0
    for shard in range(shards):
        own, some = mixing.BitMixer(counts), [bytes(r.word) for r in order if r.h % shards == shard]
        own.fit(some)
        weights, seen = weights + own.weights * len(some), seen + own.seen - mixing.BitMixer.before()
    for w in words:
        bits += 8 * (1 if w == mixing.END else len(w) + 1)
    assert np.isclose((mixer.seen - mixing.BitMixer.before()).sum(), bits)
    assert np.allclose(mixer.weights, weights / len(words)) and np.allclose(mixer.seen, seen)
    assert mixing.learn(spark.createDataFrame([], "word binary, c long"), 0).log10_chance([b"a"])[0] < 0


ALIKE = [b"a", b"ab", b"ab\0", b"ab\0c", b"abc", b"abc", b"", mixing.END, b"x" * 47, b"x" * 48, b"x" * 49, b"x" * 500, b"\xff" * 5, b"ab" * 30]


def counted_one_by_one(words):
    out = np.zeros(2 * mixing.ORDERS * mixing.TABLE)
    for w in words:
        for slots, bit, _ in mixing.Coded([w]).decisions():
            np.add.at(out, slots.ravel() * 2 + np.tile(bit, mixing.ORDERS), 1)
    return out


@pytest.mark.parametrize("nodes", [3, 4096])
def test_bytes_that_words_begin_with_are_coded_once(monkeypatch, nodes):
    """Each byte after the same beginning is coded once, for tables and chances, which are those of single words."""
    monkeypatch.setattr(mixing, "NODES_AT_ONCE", nodes)
    words = ALIKE + sorted({w.encode() for i in range(20) for w in prose(i, 50).split()})
    coded, slots_of = [], mixing._slots
    monkeypatch.setattr(mixing, "_slots", lambda context, byte, places: coded.append(len(byte)) or slots_of(context, byte, places))
    counts = mixing.tally(words)
    beginnings = set()
    for w in words:
        w = w if w == mixing.END else w + b" "
        for at in range(0, len(w), mixing.CHUNK):
            beginnings |= {w[at : at + n] for n in range(1, min(mixing.CHUNK, len(w) - at) + 1)}
    assert sum(coded) == len(beginnings) < sum(len(w) for w in words) / 2
    assert max(coded) <= nodes
    assert np.array_equal(counts, counted_one_by_one(words))
    mixer = mixing.BitMixer(counts)
    mixer.fit(words)
    coded.clear()
    together = mixer.log10_chance(words)
    assert sum(coded) == len(beginnings)
    for w, chance in zip(words, together, strict=True):
        alone = 0.0
        for slots, bit, last in mixing.Coded([w]).decisions():
            gate = mixer.level[slots[3]].astype(np.int64) * 4 + mixer.level[slots[5]]
            one = mixer._mixed(mixer.stretched[slots], gate, last)[2]
            alone += np.log10(np.where(bit == 1, one, 1 - one)).sum()
        assert math.isclose(chance, alone, rel_tol=1e-9)


def test_fit_is_the_same_bit_by_bit(monkeypatch):
    """Bits prepared a byte at a time or one by one: the mixer learns the same, after each bit, in order."""
    words = ALIKE + [w.encode() for w in prose(5, 300).split()]
    counts = mixing.tally(words)
    mixers = []
    for nodes in (1, 4096):
        monkeypatch.setattr(mixing, "NODES_AT_ONCE", nodes)
        mixers.append(mixing.BitMixer(counts))
        mixers[-1].fit(words)
    assert np.allclose(mixers[0].weights, mixers[1].weights) and np.array_equal(mixers[0].seen, mixers[1].seen)
    assert not np.allclose(mixers[0].weights, 0.3)


def test_small_batches_are_joined(monkeypatch):
    monkeypatch.setattr(mixing, "WORDS_AT_ONCE", 5)
    monkeypatch.setattr(mixing, "BYTES_AT_ONCE", 1000)
    sizes = [2, 0, 2, 2, 4, 0, 1, 3]
    batches = [pa.RecordBatch.from_arrays([pa.array([b"w"] * n, pa.binary())], ["word"]) for n in sizes]
    batches.append(pa.RecordBatch.from_arrays([pa.array([b"w" * 2000], pa.binary())], ["word"]))
    got = list(mixing.joined(iter(batches)))
    assert [b.num_rows for b in got] == [6, 5, 4] and list(mixing.joined(iter([]))) == []


def in_turn(seed, words=60):
    """Words of which each mostly follows one other, so that order tells much."""
    r, out = random.Random(seed), []
    for i in range(words):
        out.append(f"w{r.randrange(40)}" if i % 6 == 0 else f"w{(int(out[-1][1:]) * 7 + 3) % 40}")
    return " ".join(out)


HELD = [i for i in range(100_000, 100_200) if zlib.crc32(str(i).encode()) % 5 == 1]


def test_query_scores_words_in_order(spark, monkeypatch):
    """The same words in the order of the corpus are likelier than in another; each word's chance depends on those before."""
    turned = " ".join(sorted(in_turn(1000).split()))
    texts = [(i, in_turn(i)) for i in range(300)] + [(HELD[0], in_turn(1000)), (HELD[1], turned)]
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: table(spark, texts))
    rows = {r.doc_id: r for r in queries.op9_mixing(spark, "").collect()}
    assert len(rows) == len(texts) and rows[HELD[0]].held_out and rows[HELD[1]].held_out
    assert math.isclose(rows[HELD[0]].base_score, rows[HELD[1]].base_score, rel_tol=1e-9)
    assert rows[HELD[0]].score > rows[HELD[1]].score + 20


@pytest.mark.parametrize("counts", [[5], [1, 1], [9, 4, 4, 2, 1, 1, 1], list(range(1, 60)), [1] * 33])
def test_tree_is_a_shortest_prefix_code(counts):
    starts, steps = mixing.tree(np.array(counts))
    paths = [frozenset(steps[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)]
    sizes = np.diff(starts)
    if len(counts) > 1:
        assert sum(0.5 ** int(n) for n in sizes) == 1
        for i, p in enumerate(paths):
            assert all(any(s ^ 1 in p for s in q) for q in paths[:i])  # they part at some node
    left, cost = sorted(counts), 0
    while len(left) > 1:
        both = left.pop(0) + left.pop(0)
        cost += both
        left = sorted([*left, both])
    assert (sizes * counts).sum() == cost


def test_chances_of_all_symbols_sum_to_one():
    frequent, mixer, whole = small_mixer()
    _, contexts, _ = frequent.sequence(frequent.numbers(b"w1 w3 new w5 \n".split(b" "))[0])
    for at in range(contexts.shape[1]):
        chances = mixer.chance(whole, np.arange(len(frequent.index) + 1), np.repeat(contexts[:, [at]], len(frequent.index) + 1, axis=1))
        assert math.isclose(chances.sum(), 1, rel_tol=1e-9) and chances.min() > 0


def small_mixer():
    texts = [mixing.tokens(in_turn(i)) for i in range(50)]
    count = Counter(w for t in texts for w in t)
    words = sorted(count)
    c = np.array([count[w] for w in words])
    frequent = mixing.Frequent(words, c, np.log10(c / c.sum()), len(words))
    mixer = mixing.OrderMixer(np.append(c, 1), 14)
    counts = np.zeros((mixing.BEFORE << 14, 2), np.int32)
    symbols, contexts, _ = frequent.sequence(frequent.numbers([w for t in texts for w in t])[0])
    mixer.tally(counts, symbols, contexts)
    whole, *fewer = (np.concatenate(x) for x in zip(mixing.with_fewer(mixer.alone), mixing.with_fewer(counts), strict=True))
    mixer.fit(np.concatenate(fewer), symbols, contexts)
    mixer.take(mixer.learned())
    return frequent, mixer, whole


@pytest.mark.parametrize(("hot_share", "at_once"), [(60, 100), (250_000, 50_000)])
def test_scores_in_order_against_brute_force(spark, monkeypatch, hot_share, at_once):
    """Each token after those before it, one by one; all training tokens are counted and fit the mixer."""
    monkeypatch.setattr(mixing, "HOT_SHARE", hot_share)
    monkeypatch.setattr(mixing, "TOKENS_AT_ONCE", at_once)
    kept, learn_order = [], mixing.learn_order
    monkeypatch.setattr(mixing, "learn_order", lambda *a: kept.append((*a, *learn_order(*a))) or kept[-1][-2:])
    texts = ODD + [in_turn(i) for i in range(80)] + [prose(5, 20) + " w1 w2", "THE the"] + [(h, "both held and " * 3) for h in HELD[:3]]
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    training = [mixing.tokens(t) for i, t in pairs if fold(i) != 1]
    count = Counter(w for t in training for w in t)
    total, distinct = sum(count.values()), len(count)
    singles = {(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in mixing.score_texts(table(spark, texts)).collect()}
    rows = mixing.score_texts(table(spark, texts), in_order=True).collect()
    assert {(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows} == singles
    _, shared, symbols, _, mixer, whole = kept[0]
    frequent = shared.value
    coded = {w: i for w, i in frequent.index.items() if i < frequent.coded}
    assert set(coded) == {w for w, n in count.items() if n >= max(2, total // hot_share + 1)} and len(coded) < distinct
    assert symbols.sum() == total and symbols[:-1].tolist() == [count[w] for w in sorted(coded, key=coded.get)]
    # Tables: all training texts, one at a time.
    counts = np.zeros((mixing.BEFORE << mixer.bits, 2), np.int32)
    sizes, bits = np.diff(mixer.starts), 0
    for t in training:
        some, contexts, _ = frequent.sequence(frequent.numbers(t)[0])
        mixer.tally(counts, some, contexts)
        bits += sizes[some].sum()
    assert np.array_equal(whole, np.concatenate([mixing.with_fewer(mixer.alone)[0], mixing.with_fewer(counts)[0]]))
    assert counts.sum() == mixing.BEFORE * bits == mixing.BEFORE * (mixer.seen - mixing.OrderMixer.before()).sum()
    # Words without a symbol: their share of the model of single words.
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    spelled = mixing.learn(spark.createDataFrame([(bytearray(w), 1) for w in count], "word binary, c long"), distinct)
    words = sorted({w for _, t in pairs for w in mixing.tokens(t)})
    single = {w: max(count[w] - discount, 0) / total + discount * distinct / total * 10**p for w, p in zip(words, spelled.log10_chance(words), strict=True)}
    left = 1 - sum(single[w] for w in coded)
    want = []
    for i, t in pairs:
        tokens, sums = mixing.tokens(t), []
        after = [mixer.chance(whole, s[-1:], c[:, -1:])[0] for s, c in (sequence_so_far(frequent, tokens[: n + 1]) for n in range(min(len(tokens), 400)))]
        if len(tokens) > 400:
            continue
        for a in mixing.CACHES:
            seen, among, s = Counter(), Counter(), 0.0
            for n, (w, p) in enumerate(zip(tokens, after, strict=True)):
                symbol = coded.get(w, -1)
                s += math.log10((a * p + seen[symbol]) / (a + n))
                if symbol < 0:
                    s += math.log10((a * single[w] / left + among[w]) / (a + seen[symbol]))
                    among[w] += 1
                seen[symbol] += 1
            sums.append(s)
        want.append((str(i), max(sums) + math.log10(sum(10 ** (s - max(sums)) for s in sums) / len(sums))))
    got = sorted((str(r.doc_id), r.score) for r in rows if r.n_tokens <= 400)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-5), (g, w)


def sequence_so_far(frequent, tokens):
    """Of a text's first tokens, whose end is made up where it is missing."""
    end = [] if tokens[-1] == mixing.END else [mixing.END]
    symbols, contexts, of = frequent.sequence(frequent.numbers(tokens + end)[0])
    assert not of.any()
    return symbols[: len(tokens)], contexts[:, : len(tokens)]


def test_in_order_without_training_rows(spark):
    assert mixing.score_texts(table(spark, []), in_order=True).count() == 0
    row = mixing.score_texts(table(spark, [(HELD[0], "a b a")]), in_order=True).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score < 0
    one = mixing.score_texts(table(spark, [(2, None), (HELD[0], "a")]), in_order=True).collect()
    assert all(r.train_tokens == 1 and r.score < 0 for r in one) and len(one) == 2
