"""Documents for the tests: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, score string, fp string, removed string, n string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ke", "lo", "mi", "tu", "sta", "ren"]) for _ in range(r.randint(1, 4))) for _ in range(words))


def table(spark, texts):
    """``texts``: texts, or pairs of id and text."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


ODD = [
    None,
    "",
    "   \n\t ",
    "ÄÖÜ straße İstanbul 日本語のテキスト",
    "a",
    "😀 mixed 😀 text",
    "x" * 3000,
    prose(1, 4000),
    prose(2, 60),
    prose(2, 60),
    prose(2, 60).upper(),
    "\x1c odd \x85 spaces here \v\f",
    (None, "no id " + prose(3, 40)),
    (None, "no id " + prose(3, 40)),
    (77, prose(4, 50)),
    (77, prose(4, 50)),
    (77, prose(5, 50)),
]
