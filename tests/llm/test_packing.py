import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framedrift.llm import packing
from tests.llm.material import ODD, prose, table

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
TEXTS = [t[1] if isinstance(t, tuple) else t for t in ODD] + [prose(i, 20 + 37 * i) for i in range(40)] + ["a<|endoftext|>b", "n b"]


@pytest.mark.parametrize("paths", [PATHS, PATHS[:1]])
def test_pieces_are_the_documents(spark, paths):
    rows = packing.pack(table(spark, TEXTS), *paths, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATHS[0])
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(of[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.token_ids] == ids
        at = 0
        for p in pieces:
            assert (p.start, p.length, p.doc_tokens) == (at, len(p.token_ids), len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(p.token_ids, "<u4").tobytes())
            at += p.length
    short = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        short += at < 1024
    assert short <= 3  # one for each task


def test_repeated_and_missing_rows(spark):
    assert packing.pack(table(spark, []), *PATHS).count() == 0
    rows = packing.pack(table(spark, [(None, "a"), (5, "a"), (5, "a")]), *PATHS).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("5", 2), ("5", 2), ("None", 2)]


def test_level_choice_is_the_least_sum_of_squares():
    packer, rng = packing.Packer(16), np.random.default_rng(1)
    for _ in range(500):
        size = int(rng.integers(1, 16))
        counts = packer.counts.copy()
        sums = {}
        for h in range(16 - size + 1):
            if h and not counts[h]:
                continue
            after = counts.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            sums[h] = int((after**2).sum())
        best = max(h for h, s in sums.items() if s == min(sums.values()))
        done = packer.place(packing.Piece((0, size), 0, np.zeros(size, packing.ID)))
        after = counts.copy()
        after[best] -= best > 0
        after[best + size] += best + size < 16
        assert (packer.counts == after).all() and (done is not None) == (best + size == 16)
        assert [len(w) for w in packer.windows] == packer.counts[:16].tolist()


def test_open_windows_are_bounded(spark):
    """Pieces of which no two fit into a window: they are cut once too many wait."""
    packer = packing.Packer(100)
    pieces = [packing.Piece((i, 60), 0, np.full(60, i, packing.ID)) for i in range(500)]
    full, most = [], 0
    for piece in pieces:
        if done := packer.place(piece):
            full.append(done)
        most = max(most, packer.open_tokens)
        if packer.open_tokens > 1000:
            full += packer.fill_up()
    assert most <= 1060 and packer.open_tokens == sum(len(p.ids) for level in packer.windows for w in level for p in w)
    left = list(packer.finish())
    assert all(sum(len(p.ids) for p in w) == 100 for w in [*full, *left[:-1]])
    parts = sorted((p.row[0], p.start, len(p.ids)) for w in [*full, *left] for p in w)
    for i in range(500):
        mine = [(s, n) for row, s, n in parts if row == i]
        assert sum(n for _, n in mine) == 60 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    docs = table(spark, [prose(i, 150) for i in range(40)])
    few, many = (packing.pack(docs, *PATHS, open_tokens=x).groupBy("doc_id").sum("length").collect() for x in (1500, 1 << 40))
    assert sorted(few) == sorted(many)
