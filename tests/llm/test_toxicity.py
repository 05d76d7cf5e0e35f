import random
import zlib

import numpy as np

from framedrift.llm import toxicity
from tests.llm.material import ODD, prose, table


def test_label_model_discounts_voters_that_err_together():
    """Three voters are copies of one poor voter; two others are good and independent."""
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    flip = lambda p: truth ^ (rng.random(len(truth)) < p)
    poor = flip(0.35)
    columns = [flip(0.08), flip(0.1), poor, poor, poor]
    mask = sum((c.astype(int) << i for i, c in enumerate(columns)), np.zeros(len(truth), int))
    masks, at = np.unique(mask, return_inverse=True)
    n = np.bincount(at)
    known = np.stack([np.bincount(at[:600], ~truth[:600], len(masks)), np.bincount(at[:600], truth[:600], len(masks))], axis=1)
    model = toxicity.LabelModel(masks, n.astype(float), known)
    assert ((model.posterior[at] >= 0.5) == truth).mean() > 0.9
    assert model.accuracy[0] > 0.85 and model.accuracy[2] < 0.75
    good_only, poor_only = 0b00011, 0b11100
    assert model.posterior[list(masks).index(good_only)] > 0.8 > 0.2 > model.posterior[list(masks).index(poor_only)]


def test_linear_fit():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(800)]
    target = np.array([0.95 if 2 in r else 0.05 for r in rows])
    weights = toxicity.fit_linear(rows, target, 6)
    assert weights[2] > 3 and np.abs(np.delete(weights[:6], 2)).max() < 0.5 and weights[-1] < -1


def toxic_table(spark):
    r, texts, labels = random.Random(1), list(ODD), []
    for i in range(len(ODD), 700):
        words = prose(i, 40).split()
        if i % 4 == 0:
            for w in r.sample(["grumbly", "snotface", "blargoid", "wretchy"], 2):
                words.insert(r.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    return table(spark, texts), labels


def test_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    odd = [(None, 1), (5000, 1), (30, None), (31, 0), (31, 0)]
    rows = toxicity.score_toxicity(docs, spark.createDataFrame(labels + odd, "doc_id long, toxic int")).collect()
    assert len(rows) == docs.count()
    truth = dict(labels)
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = toxic_table(spark)
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [
        sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
        for x in (labels, wrong)
    ]
    assert scores[0] == scores[1]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(table(spark, []), none).count() == 0
    rows = toxicity.score_toxicity(table(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1 and rows[0].predicted == 0
