import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from framedrift.llm import divergence
from tests.llm.material import ODD, prose, table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, shown=200):
    """Result rows of (text, lang, source) triples, each kept term against each group."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [folded(w) for w in TERM.findall(text)]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in counts if g == lang)

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, shown)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return sorted(out)


def audit(spark, rows, **options):
    docs = spark.createDataFrame(
        [(i, *r, "x", 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, g long, l string"
    ).repartition(3)
    return sorted(tuple(r) for r in divergence.audit_sources(docs, **options).collect())


def test_against_brute_force(spark):
    words = prose(1, 60).split() + ["Straße", "日本語", "naïve", "x" * 17, "y" * 40, "Z" * 300, "abcdefgh", "abcdefghi", "abcdefghijklmnop"]
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), ["en", "de", None][i % 3], [None, "a", "b", "c"][int(rng.integers(0, 4)) * (i % 5 > 0)]) for i in range(80)]
    rows += [(t if not isinstance(t, tuple) else t[1], "en", "odd") for t in ODD]
    rows += [(None, "zz", "only"), ("", "zz", "other"), ("one-two_three4five", "zz", "third"), ("AB ab aB\x00Ab", "", "")]
    rows += [("hot hot hot " + words[0], "en", "hot")] * 60
    for least in (1, 3):
        assert audit(spark, rows, least_docs=least) == brute(rows, least)
    assert audit(spark, rows, shown=2) == brute(rows, shown=2)
    assert [r for r in audit(spark, rows) if r[0] == "zz" and r[2] == "pair"] == [r for r in brute(rows) if r[0] == "zz" and r[2] == "pair"]


def test_empty_table(spark):
    assert divergence.audit_sources(table(spark, [])).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(0, 10), (10**11, 3 * 10**11 + 7), (9 * 10**17, 9 * 10**17 + 1)]
    df = spark.createDataFrame(rows, "n long, total long").select("n", "total", divergence._share("n", "total").alias("p"))
    assert {(r.n, r.total): r.p for r in df.collect()} == {(n, t): 1 + 10**9 * (n + 1) // t for n, t in rows}


def test_terms_of_texts_and_their_buckets():
    texts = ["a bb", None, "", "Ccc", "d" * 9 + "-" + "e" * 16, "f" * 17 + "é", "ab", "b", "ab"]
    octets, starts, sizes, row = divergence.cut_terms(pa.array([t or "" for t in texts]).slice(0))
    words = [bytes(octets[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    assert list(zip(words, row.tolist(), strict=True)) == [(folded(w).encode(), i) for i, t in enumerate(texts) for w in TERM.findall(t or "")]
    seen = []
    for order, new in divergence.sorted_buckets(octets, starts, sizes, row):
        found = [(words[i], row[i]) for i in order.tolist()]
        assert found == sorted(found)
        assert [x for x, n in zip(found, new, strict=True) if n] == [x for i, x in enumerate(found) if not i or found[i - 1][0] != x[0]]
        seen += found
    assert len(seen) == len(words)
