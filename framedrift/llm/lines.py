"""Repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framedrift.llm.common import blank_null, settle, split_join, unused

#: A line ends at a line feed, or at the end of a sentence, as a paragraph is often one physical line.
LINE_END = r"(?<=\n)|(?<=[.!?]\x20)"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\r\x0b\x0c"
LEAST_WORDS = 20
MOST_LINES = 4


def cut_lines(text: Column) -> Column:
    """Lines with their ends: joined, they are the text."""
    return F.split(text, LINE_END, -1)


def _windows(h: Column, n: Column, line: Column, least_words: int, most_lines: int) -> Column:
    """Array of (minimum hash, window hash, hash of the first line, its number, number of the last line).

    ``h``, ``n`` and ``line`` are columns with the hash, words and number of each line. From each line
    on, the window is the shortest run with ``least_words`` words, ``most_lines`` lines at most; what
    follows the window does not change it, so equal runs have equal windows.
    """

    def lines_of(i: Column) -> Column:
        size, words, steps = F.lit(most_lines), F.lit(0), []
        for m in range(1, most_lines):
            words = words + F.coalesce(F.get(n, i + (m - 1)), F.lit(0))
            steps.append((words >= least_words, m))
        for condition, m in reversed(steps):
            size = F.when(condition, m).otherwise(size)
        return size

    sized = F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda i: F.struct(i.alias("i"), lines_of(i).alias("m")))
    whole = F.filter(sized, lambda x: x["i"] + x["m"] <= F.size(n))
    cut = F.transform(whole, lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"), F.slice(h, x["i"] + 1, x["m"]).alias("hs")))
    least = F.transform(
        cut,
        lambda x: F.struct(
            F.array_min(x["hs"]).alias("least"),
            F.xxhash64(x["hs"]).alias("window"),
            F.get(h, x["i"]).alias("start"),
            F.get(line, x["i"]).alias("first"),
            F.get(line, x["i"] + x["m"] - 1).alias("last"),
        ),
    )
    return F.when(F.size(n) > 0, least)


def repeated_lines(
    docs: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS, most_lines: int = MOST_LINES
) -> DataFrame:
    """(_row, gone): for each row with lines that an earlier run repeats, the numbers of these lines.

    ``_row`` is ``row_hash`` of the row. See ``drop_repeated_lines`` for what counts.
    """
    lines = F.transform(
        cut_lines(blank_null(text)),
        lambda s, i: F.struct(
            i.alias("line"), F.xxhash64(F.btrim(s, F.lit(BLANKS))).alias("h"), F.regexp_count(s, F.lit(WORD)).alias("n")
        ),
    )
    rows = docs.select(F.col(key).alias("_key"), row_hash(key, text), F.filter(lines, lambda x: x["n"] > 0).alias("_lines"))
    # Columns of their own, as lambdas would work out whatever stands in them for each line again.
    parts = [
        F.transform("_lines", lambda x: x["h"]).alias("_h"),
        F.transform("_lines", lambda x: x["n"]).alias("_n"),
        F.transform("_lines", lambda x: x["line"]).alias("_line"),
    ]
    rows = rows.select("_key", "_row", *parts)
    found = _windows(F.col("_h"), F.col("_n"), F.col("_line"), least_words, most_lines)
    rows = rows.select("_key", "_row", found.alias("_windows"))

    # Fingerprints: a window has a new one unless it shares the minimum of the window before, which does
    # not begin with it (if it did, the same hash would stand a second time).
    w = F.col("_windows")
    before = lambda i: F.get(w, i - 1)
    fresh = lambda x, i: (i == 0) | (before(i)["least"] != x["least"]) | (before(i)["start"] == x["least"])
    flagged = F.transform(
        w,
        lambda x, i: F.struct(
            x["least"].alias("h"), x["window"].alias("window"), x["first"].alias("first"), x["last"].alias("last"), fresh(x, i).alias("fresh")
        ),
    )
    # The outer form of explode, as the plain one tests first whether there is anything, by the whole
    # expression put together. Settled, as working out the windows is most of the work.
    opened = rows.select("_key", "_row", F.explode_outer(flagged).alias("x")).where("x is not null")
    opened = settle(opened.select("_key", "_row", "x.*"))
    again = opened.where("fresh").groupBy("h").count().where("count > 1").select("h")

    # Only windows around fingerprints that occur again go on; adaptive execution splits frequent ones.
    members = settle(opened.drop("fresh").join(again, "h", "left_semi"))

    # Around a fingerprint the match goes on to both sides as far as the window, then window by window:
    # all windows of a run that occurred earlier are found, and their union is the run.
    at = F.struct("_key", "_row", "first")
    origins = members.groupBy("h", "window").agg(F.min(at).alias("_origin"), F.count("*").alias("_times")).where("_times > 1")
    later = split_join(members, origins, ["h", "window"], "_times", members.count()).where(at > F.col("_origin"))
    gone = later.select("_row", F.explode(F.sequence("first", "last")).alias("line"))
    return gone.groupBy("_row").agg(F.collect_set("line").alias("gone"))


def row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.lit(0), F.col(key), F.col(text)).alias("_row")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, most_lines: int = MOST_LINES
) -> DataFrame:
    """``docs`` with the lines deleted that belong to a later copy of a run; adds n_lines and removed.

    Lines end at line feeds and sentence ends, and are equal if they are after trimming ASCII white
    space. Lines without words are skipped over and never deleted. A run counts if it has
    ``least_words`` words or ``most_lines`` lines; every such run that occurs again, in the same
    document or another, stays where it is first in the order of (key, row, line) and is deleted
    elsewhere. A line with fewer words that occurs again among different neighbours stays.

    ``removed`` are the numbers of the deleted lines, from 0, ascending. Null and empty texts have no
    line to delete. Rows that repeat key and text are one document: they get the same result, and are
    no copies of each other. Null keys come first. Columns named n_lines or removed are replaced; all
    others are kept.
    """
    _row, _cut, _gone = unused(docs.columns, "_row", "_cut", "gone")
    gone = repeated_lines(docs, key, text, least_words, most_lines).withColumnsRenamed({"_row": _row, "gone": _gone})
    rows = docs.drop("n_lines", "removed").withColumn(_row, row_hash(key, text)).join(gone, _row, "left")
    # A column of its own, as a lambda would cut the text anew for each line.
    rows = rows.withColumn(_cut, cut_lines(F.col(text)))
    left = F.array_except(F.sequence(F.lit(0), F.size(_cut) - 1), F.col(_gone))
    cleaned = F.array_join(F.transform(left, lambda i: F.get(_cut, i)), "")
    return rows.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(_cut)),
            "removed": F.coalesce(F.array_sort(_gone), F.array().cast("array<int>")),
            text: F.when(F.col(_gone).isNull(), F.col(text)).otherwise(cleaned),
        }
    ).drop(_row, _cut, _gone)
