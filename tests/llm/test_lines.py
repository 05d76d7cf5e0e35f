import re
from collections import Counter

from pyspark.sql import functions as F

from framedrift.llm import lines
from tests.llm.material import ODD, prose, table

P = [prose(100 + i, 25) + "." for i in range(12)]
SHORT = ["one two.", "three four.", "five.", "six seven.", "eight."]
TEXTS = ODD + [
    P[0] + " " + P[1] + "\n" + P[2],
    "start of it\n" + P[1] + "\n\n  " + P[2] + "\nown words",
    "mid " + P[3] + " " + P[1] + " " + P[4] + " and more",
    P[5] + "\n" + P[5] + "\n" + P[5],
    "\n".join(SHORT),
    "before\n" + "\n".join(SHORT[:4]) + "\nafter",
    "\n".join(SHORT[:3]) + "\nother",
    "x.\n" * 12,
    "\n".join(P),
    "no end " + P[6] + " " + P[7][:-1] + "! " + P[8],
] + [P[9] + " tail " + str(i) for i in range(6)]


def brute_force(pairs, least_words, most_lines):
    """Every window spelled out; {(id, text): (kept text, deleted lines)}."""
    segments, first, windows = {}, {}, []
    for pair in set(pairs):
        cut = re.split(r"(?<=\n)|(?<=[.!?]\x20)", pair[1] or "")
        segments[pair] = cut
        filled = [(i, s.strip(lines.BLANKS), len(re.findall(r"[^\x20\x09-\x0D]+", s))) for i, s in enumerate(cut)]
        filled = [x for x in filled if x[2]]
        for at in range(len(filled)):
            for m in range(1, most_lines + 1):
                run = filled[at : at + m]
                if len(run) == m and (m == most_lines or sum(x[2] for x in run) >= least_words):
                    windows.append((tuple(x[1] for x in run), pair, run[0][0], run[-1][0]))
                    break
    place = lambda w: (w[1][0] is not None, w[1][0] or 0, row_number[w[1]], w[2])
    row_number = {pair: i for i, pair in enumerate(sorted(set(pairs), key=str))}
    for w in windows:
        if w[0] not in first or place(w) < place(first[w[0]]):
            first[w[0]] = w
    gone = {pair: set() for pair in segments}
    for w in windows:
        if first[w[0]] is not w:
            gone[w[1]].update(range(w[2], w[3] + 1))
    return {p: ("".join(s for i, s in enumerate(cut) if i not in gone[p]), sorted(gone[p])) for p, cut in segments.items()}


def test_against_every_window(spark):
    docs = table(spark, TEXTS).dropDuplicates(["doc_id", "text"]).where("doc_id is not null and doc_id <> 77")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for least, most in ((20, 4), (8, 2)):
        want = brute_force(pairs, least, most)
        rows = lines.drop_repeated_lines(docs.withColumnRenamed("text", "body"), text="body", least_words=least, most_lines=most)
        assert {"_key", "score", "fp"} <= set(rows.columns)
        got = {r.doc_id: (r.body, r.removed) for r in rows.collect()}
        for pair, (text, gone) in want.items():
            assert got[pair[0]] == ((text if pair[1] is not None else None), gone), pair
        assert any(g for _, g in want.values())


def test_repeated_rows_and_empty_table(spark):
    rows = lines.drop_repeated_lines(table(spark, [(None, P[0]), (7, P[0]), (7, P[0]), (9, P[1]), (9, P[1])])).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == {(None, P[0]): 1, (7, ""): 2, (9, P[1]): 2}
    assert lines.drop_repeated_lines(table(spark, [])).count() == 0


def test_own_columns_of_the_operators_names_are_kept(spark):
    text = prose(400, 30) + ". "
    docs = table(spark, [text + prose(401, 5), text + prose(402, 5)])
    for name in ("gone", "_row", "_cut", "GONE", "_lines"):
        docs = docs.withColumn(name if name != "GONE" else "gone_", F.lit(name))
    rows = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert rows[1].removed == [0] and rows[0].removed == []
    assert all((r.gone, r._row, r._cut, r.gone_, r._lines) == ("gone", "_row", "_cut", "GONE", "_lines") for r in rows.values())
