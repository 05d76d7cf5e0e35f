import hashlib
import random
import zlib
from collections import Counter, defaultdict

from framedrift.llm import exact, sharding
from framedrift.llm.common import split_join
from tests.llm.material import ODD, table


def pairs(texts):
    return [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]


def test_copies_against_brute_force(spark):
    texts = ODD + ["Hot"] * 40 + ["hOT"] * 40 + [f"t{i % 30}" for i in range(90)] + ["É", "é"]
    groups = defaultdict(list)
    for i, t in pairs(texts):
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(i)
    expected = Counter()
    for h, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        expected.update((i, best, len(ids), i == best, h) for i in ids)
    for size in (2, 256):
        rows = exact.mark_copies(table(spark, texts), size=size).collect()
        assert Counter(map(tuple, rows)) == expected
    assert exact.mark_copies(table(spark, [])).count() == 0


def test_summary_keeps_every_frequent_value():
    r = random.Random(5)
    stream = ["a"] * 300 + ["b"] * 150 + [str(i) for i in range(550)]
    r.shuffle(stream)
    kept = Counter()
    for at in range(0, 1000, 37):
        kept = exact.merge_counters(kept, Counter(stream[at : at + 37]), 9)
    assert len(kept) <= 9 and kept["a"] >= 200 and kept["b"] >= 50


def test_split_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 2 else str(i), i) for i in range(3000)], "k string, i int")
    right = left.groupBy("k").count().withColumnRenamed("count", "c")
    joined = split_join(left, right, ["k"], "c", 3000)
    assert joined.count() == 3000 and joined.where("k = 'hot' and c > 1000").count() == joined.where("k = 'hot'").count() > 1000
    assert joined.where("k is null and c = 429").count() == 429


def test_shards(spark):
    texts = ODD + [f"{'w' * (i % 50)}é" for i in range(400)]
    rows = sharding.shard_by_bytes(table(spark, texts), 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs(texts))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    total, before, slots = sum(r.size for r in rows), 0, Counter()
    seen = defaultdict(list)
    for r in ordered:
        shard = min(23, (2 * before + r.size) * 24 // (2 * total))
        slots[shard] += 1
        before += r.size
        seen[r.shard].append(r.slot)
        assert r.shard == shard
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())
    assert sharding.shard_by_bytes(table(spark, []), 24).count() == 0
    assert [r.slot for r in sharding.shard_by_bytes(table(spark, ["one"]), 24).collect()] == [0]
