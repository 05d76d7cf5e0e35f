import random
import re

import xxhash

from framedrift.llm import simhash
from tests.llm.material import ODD, prose, table


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    """Least index reachable over values that differ in two bits or fewer."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components(spark):
    base = prose(9, 300).split()
    near = []
    for i in range(25):
        words = list(base)
        words[10 * i] = "changed"
        near.append(" ".join(words))
    texts = ODD + near + [" ".join(base)] * 3
    rows = simhash.near_duplicates(table(spark, texts)).collect()
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    prints = [slow_fingerprint(t, 3) for _, t in pairs]
    label = slow_components(prints)
    least = {}
    for (i, _), root in zip(pairs, label, strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = sorted((str(i), f"{p:016x}", str(least.get(root))) for (i, _), p, root in zip(pairs, prints, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == expected
    assert len(set(label)) < len(set(prints))  # some texts are linked, not equal
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_no_link_is_lost(spark):
    """Chains, clusters in one grid cell, and the outermost bits."""
    r = random.Random(3)
    values = {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for _ in range(15):
        v = r.getrandbits(64)
        values.add(v)
        for _ in range(20):
            for _ in range(r.randint(1, 3)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = dict(simhash.components(links).collect())
    label = slow_components(values)
    groups = {}
    for v, root in zip(signed, label, strict=True):
        groups.setdefault(root, []).append(v)
    for members in groups.values():
        assert {roots.get(v, v) for v in members} == {min(members)}


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_copies_down_to_the_least_similarity(spark):
    """Pairs from 0.7 to 1, chains of them, and texts with shared passages, against all pairs of sets."""
    texts = [t for t in ODD if not isinstance(t, tuple)]
    for base in range(12):
        words = prose(200 + base, 100 + 20 * base).split()
        for steps in range(1, 8):
            changed = list(words)
            for j in range(steps if base % 2 else 1):
                changed[(17 * steps * (j + 1)) % len(words)] = f"other{steps}{j}"
            texts.append(" ".join(changed))
        for _ in range(3):  # a chain
            words = words[len(words) // 15 :] + prose(300 + base, 4).split()
            texts.append(" ".join(words))
    docs = table(spark, texts)
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i, a in enumerate(sets):
            for j in range(i):
                union = len(a | sets[j])
                if not union or len(a & sets[j]) / union >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    prints = [slow_fingerprint(t, 5) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if a != sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in links) > 50
    rows = simhash.near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(label))
    assert simhash.near_copies(table(spark, [])).count() == 0
