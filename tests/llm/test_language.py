import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from framedrift.llm import language
from tests.llm.material import ODD, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab", "é"]


def enumerate_chance(model, word):
    """Sum over all segmentations, one by one."""
    chance = {p: model.chance[i] for i, p in enumerate(model.pieces)}

    def rest(s):
        if not s:
            return np.ones(model.chance.shape[1])
        total = np.zeros(model.chance.shape[1])
        for k in range(1, len(s) + 1):
            piece = chance.get(s[:k], model.chance[-2] if k == 1 else None)
            if piece is not None:
                total = total + piece * rest(s[k:])
        return total

    return rest("▁" + word)


def some_model():
    rng = np.random.default_rng(0)
    return language.PieceModel.start(PIECES, 3).learned(rng.random((len(PIECES) + 2, 3)))


def test_forward_sums_all_segmentations():
    model = some_model()
    words = ["a", "ab", "abab", "babé", "xyz", "bbabab", "é"]
    assert np.allclose(model.log_chance(words), np.log([enumerate_chance(model, w) for w in words]))
    long = "ab" * 14
    by_block = np.log(model._block([long])[4][0])
    assert len(long) > language.LONGEST_IN_BLOCK and np.allclose(model.log_chance([long])[0], by_block)
    assert np.isfinite(model.log_chance(["xab" * 3000])).all()


def test_expected_counts_are_the_slope_of_the_log_chance():
    model, words, times = some_model(), ["abab", "baxé"], np.array([2, 3])
    counts = model.expected(words, np.array([0, 2]), times)
    for piece in range(len(PIECES) + 1):
        for lang, word, n in ((0, "abab", 2), (2, "baxé", 3)):
            up = language.PieceModel(PIECES, model.chance.copy())
            up.chance[piece, lang] *= 1 + 1e-6
            slope = (up.log_chance([word])[0, lang] - model.log_chance([word])[0, lang]) / 1e-6
            assert math.isclose(counts[piece, lang], n * slope, abs_tol=1e-3)


def test_expected_counts_of_long_words(monkeypatch):
    model = some_model()
    words = ["ab" * 14 + "xé", "bab" * 30, "a" * 25, "ab" * 14 + "xé"]
    lang, times = np.array([0, 2, 1, 1]), np.array([2, 3, 1, 5])
    sums = model.expected(words, lang, times)
    for step in (1 << 14, 7):
        monkeypatch.setattr(language, "LETTERS_AT_ONCE", step)
        assert np.allclose(model.expected(words, lang, times), sums)
    monkeypatch.setattr(language, "LONGEST_IN_BLOCK", 1000)
    assert np.allclose(model.expected(words, lang, times), sums)
    # Each letter, and the mark of the start, is in just one piece.
    held = np.array([len(p) for p in PIECES] + [1, 0])
    for x in range(3):
        assert math.isclose(held @ sums[:, x], sum(n * (len(w) + 1) for w, n, of in zip(words, times, lang) if of == x))


def test_words_without_spaces_are_learned(spark):
    """Sentences that are one word each: thousands of letters, and the languages differ in nothing else."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, "".join(rng.choice(["the", "and", "ing", "ion"] if lang == "aa" else ["der", "und", "sch", "ein"], 60)), lang))
    rows.append((1000, "".join(rng.choice(["der", "sch", "ein"], 7000)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, MODEL).collect()}
    assert all(r.lang_pred == r.lang for i, r in found.items() if i < 1000) and found[1000].lang_pred == "bb"


def test_clashing_names(spark):
    docs = table(spark, ["some words here", "more of them"]).withColumn("_found", F.lit("mine")).withColumn("LANG_PRED", F.lit("x"))
    rows = language.identify(docs, MODEL, per_language=50).collect()
    assert {r._found for r in rows} == {"mine"} and all(r.score > 0 for r in rows)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language.identify(docs, MODEL, per_language=50).where("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_odd_rows(spark):
    docs = table(spark, ODD + ["Das ist ein deutscher Satz", "123 ²", None])
    rows = language.identify(docs, MODEL, per_language=100).collect()
    assert len(rows) == len(ODD) + 3 and all("_key" in r.asDict() for r in rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred, r.score) == ("en", 1.0) if letters else (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(table(spark, []), MODEL).count() == 0
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in language.identify(unknown, MODEL).collect()} == {("und", 0.0)}
