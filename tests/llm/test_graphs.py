import os
from collections import defaultdict

import numpy as np
import pytest

from framedrift.llm import graphs
from framedrift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, shard long, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every, nearest):
    """query -> [(distance, key)] over all rows."""
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v]
    sound = [(i, v) for i, v in sound if np.isfinite(v).all() and v.any()]
    out = {}
    for q, a in sound:
        if q % every == 0:
            near = defaultdict(lambda: np.inf, out.get(q, {}))
            for i, b in sound:
                if i != q and len(a) == len(b):
                    near[i] = min(near[i], float(np.sqrt(((a - b) ** 2).sum())))
            out[q] = near
    return {q: sorted((d, i) for i, d in near.items())[:nearest] for q, near in out.items() if near}


def found(spark, rows, **options):
    out = defaultdict(list)
    for r in graphs.nearest_vectors(table(spark, rows), **options).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for _, i in a[q]] == [i for _, i in b[q]]
        assert np.allclose([d for d, _ in a[q]], [d for d, _ in b[q]], rtol=1e-12)


def test_odd_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(90, 6, 1))]
    copy = rows[10][1]
    rows += [(1000 + i, copy) for i in range(40)]  # more copies than are asked for
    rows += [(200, copy), (201, copy), (10, copy), (10, copy), (30, rows[31][1])]  # repeated rows, and a key with two vectors
    nan, inf = float("nan"), float("inf")
    rows += [(None, copy), (300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (340, [nan] * 6), (350, [inf] + [1.0] * 5)]
    rows += [(400, [1.0, 2.0]), (401, [1.0, 3.0]), (402, [1.0, 1.0]), (500, [1.0] * 9)]  # other lengths: ties, and one alone
    for options in ({}, {"shard_rows": 20}):
        same(found(spark, rows, every=10, **options), brute(rows, 10, 10))
    same(found(spark, rows, every=10, nearest=3), brute(rows, 10, 3))
    assert graphs.nearest_vectors(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        graphs.nearest_vectors(table(spark, rows), width=10)


def test_values_of_any_size(spark):
    rows = [(i, (v * 10.0 ** (i % 3 * 12 - 12)).tolist()) for i, v in enumerate(clustered(60, 4, 2))]
    assert found(spark, rows, every=10).keys() == brute(rows, 10, 10).keys()


def test_recall_over_shards(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000, 24, 3))]
    wanted, got = brute(rows, 50, 10), found(spark, rows, every=50, shard_rows=800, width=64)
    assert wanted.keys() == got.keys()
    recall = np.mean([len({i for _, i in wanted[q]} & {i for _, i in got[q]}) / 10 for q in wanted])
    assert recall >= 0.95
    for q, near in got.items():  # scores are exact
        at = dict(rows)
        assert all(abs(d - np.sqrt(((np.float64(np.float32(at[q])) - np.float64(np.float32(at[i]))) ** 2).sum())) < 1e-12 for d, i in near)


def test_every_node_can_be_reached():
    vectors = clustered(2000, 8, 4).astype(float)
    order, layers = graphs.build(vectors)
    assert sorted(order) == list(range(2000))
    reached, ahead = {0}, [0]
    while ahead:
        new = {int(i) for i in layers[0][ahead.pop()] if i >= 0} - reached
        reached |= new
        ahead += new
    assert len(reached) == 2000
    for links in layers:
        for i, row in enumerate(links):
            held = row[row >= 0]
            assert len(set(held.tolist())) == len(held) and i not in held and (held < len(links)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    wanted = brute(rows, 100, 10)
    hits = sum(r.vec_id in {i for _, i in wanted[r.query_id]} for r in QUERIES["op12_graphs"](spark, sf).collect())
    assert hits >= 0.9 * sum(map(len, wanted.values()))
