import re
from collections import Counter, defaultdict

import numpy as np

from framedrift.llm import phrases
from tests.llm.material import ODD, prose, table


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, reported=2000):
    """Result rows of (text, lang) pairs; all runs of words are counted, and compared with all longer ones."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for longer, a in candidates.items():
            for m in range(2, len(longer)):
                for i in range(len(longer) - m + 1):
                    inside[longer[i : i + m]] = max(inside[longer[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "x", "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, w0 string, phrase string, n long")
    return sorted(tuple(r) for r in phrases.mine_phrases(docs.repartition(3), **options).collect())


def material():
    rng = np.random.default_rng(5)
    words = prose(9, 14).split() + ["Étude", "\x01odd\x00", "ba\x01", "日本", "d'or"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words, rng.integers(0, 50), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))
        text = text.replace(words[3], words[3] + [",", ".", "\n", "\x0b", "!?", "\t "][i % 6])
        rows.append((text + " always the SAME five words here", ["en", "de", None, "fr"][i % 4]))
    rows += [(t if not isinstance(t, tuple) else t[1], "en") for t in ODD]
    rows += [("again again again again again again again " * 9, "en"), (None, None), ("one. two", "only"), ("hot pair " * 300, "en"), ("hot pair " * 300, "hot")]
    return rows


def test_against_brute_force(spark):
    rows = material()
    for least in (2, 5, 30):
        assert mined(spark, rows, least=least) == brute(rows, least)
    assert mined(spark, rows, least=3, reported=4) == brute(rows, 3, 4)


def test_runs_over_batches(spark):
    rows = material()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert mined(spark, rows, least=4) == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_bit_table_that_lets_all_through_changes_nothing(spark, monkeypatch):
    rows = material()
    wanted = mined(spark, rows, least=5)
    whole = np.full(1 << (phrases.FILTER_BITS - 3), 255, np.uint8)
    monkeypatch.setattr(phrases, "bit_table", lambda slot, bits, rows: whole)
    assert mined(spark, rows, least=5) == wanted


def test_counts_that_tasks_hand_on_early(spark, monkeypatch):
    rows = material()
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(phrases, "SLOTS_HELD", 20)
    monkeypatch.setattr(phrases, "CACHED", 30)
    assert mined(spark, rows, least=5) == brute(rows, 5)


def test_empty_table(spark):
    assert phrases.mine_phrases(table(spark, [])).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (prose(3, 3000).replace("ba", "ba,") + " no end at all " * 20).encode()
    whole, cut = phrases.Numbers("en"), phrases.Numbers("en")
    whole.read(text)
    monkeypatch.setattr(phrases, "PIECE_BYTES", 100)
    cut.read(text)
    assert [whole.words[i] for i in whole.take()] == [cut.words[i] for i in cut.take()]


def test_packed_counts_come_back():
    rng = np.random.default_rng(6)
    slots = np.unique(rng.integers(0, 1 << phrases.SLOT_BITS, 5000))
    counts = rng.integers(1, 1 << 40, len(slots))
    rows = phrases.packed(slots, counts).to_pylist()
    assert len({r["bucket"] for r in rows}) == len(rows)
    back = [np.cumsum(phrases._unsqueezed(r["slots"])) + (r["bucket"] << (phrases.SLOT_BITS - phrases.BUCKET_BITS)) for r in rows]
    assert np.array_equal(np.concatenate(back), slots)
    assert np.array_equal(np.concatenate([phrases._unsqueezed(r["counts"]) for r in rows]), counts)
    assert phrases.packed(slots[:0], counts[:0]).num_rows == 0
