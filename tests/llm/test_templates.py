import re

from framedrift.llm import templates
from tests.llm.material import ODD, prose, table

ITEMS = {
    1: "If Anna Smith buys 12 apples for 3 dollars each, then how much money will she pay in all for the 12 apples?",
    2: prose(500, 40),
    3: "In a town the train to Berlin takes 45 minutes and the bus to Berlin takes 70 minutes, so which one is faster and by how much",
    4: "tiny four word item",
    5: None,
    6: "",
    7: "  " + prose(500, 40).upper() + "\n",  # item 2 in other letters
}


def items(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ITEMS.items()] + [(None, "no id here at all", "x")], "item_id long, text string, _key string")


def leaks(spark, texts):
    rows = templates.find_leaks(table(spark, texts), items(spark)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_plain_and_reparameterised_leaks(spark):
    texts = [
        "so. " + ITEMS[1],
        "Quiz: If Bob buys 25 apples for 4 dollars each, then how much money will she pay in all for the 25 apples? End",
        "Quiz: If Bob buys 25 apples for 4 euros each, then how much money will she pay in all for the 99 apples? End",
        prose(1, 50) + " " + ITEMS[2].upper() + " " + prose(2, 50),
        "In a town the train to Paris takes 5 hours and the bus to Paris takes 70 hours, so which one is faster and by how much",
        prose(3, 300),
        " ".join(ITEMS[2].split()[:12]) + " " + prose(4, 60),
        "x tiny four word item y",
        "tiny four other word item",
    ] + ODD
    found = leaks(spark, texts)
    # In the third text 12 would stand for 25 and for 99; the seventh shows less than half.
    assert set(found) == {(0, 1), (1, 1), (3, 2), (4, 3), (7, 4)}
    assert [found[k].changed for k in sorted(found)] == [False, True, False, True, False]
    assert found[3, 2].covered == 1.0


def test_exact_leaks_against_substring_search(spark):
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = [prose(i, 80) + (" " + ITEMS[2] + " " if i % 3 == 0 else " ") + prose(i + 50, 20) for i in range(30)]
    found = {k[0] for k in leaks(spark, texts)}
    assert found == {i for i, t in enumerate(texts) if plain(ITEMS[2]) in plain(t)}


def test_repeated_rows_and_empty_tables(spark):
    found = templates.find_leaks(table(spark, [(None, ITEMS[2]), (7, ITEMS[2]), (7, ITEMS[2])]), items(spark)).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("7", 2), ("None", 2)]
    assert templates.find_leaks(table(spark, []), items(spark)).count() == 0
    assert templates.find_leaks(table(spark, [ITEMS[2]]), items(spark).limit(0)).count() == 0


def test_names_that_start_sentences(spark):
    item = "Tom has 3 apples. Tom buys 5 pears. Tom eats 2 plums."
    rows = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [
        item,
        item.replace("Tom", "Ann").replace("5", "7"),
        item.replace("Tom", "Mary Ann"),
        "Ann has 3 apples. Bob buys 5 pears. Eve eats 2 plums.",  # Tom would stand for three
        item.replace("Tom", "Ann").replace("apples", "figs").replace("pears", "nuts"),
    ]
    found = {r.doc_id: r for r in templates.find_leaks(table(spark, texts), rows).collect()}
    assert {i: r.changed for i, r in found.items()} == {0: False, 1: True, 2: True}
    assert found[1].covered == 1.0


def test_windows_of_placeholders_match_verbatim(spark):
    few = "Compute 12 + 7 * 3 - 44"
    series = "Next in line: 2, 3 ; 5 ; 7 ; 11 ; 13 ; 17 ; 19 ; 23 ; 29 ; 31"
    rows = spark.createDataFrame([(1, few), (2, series), (3, "The sum of 4 and 5 and 6 is what number here now")], "item_id long, text string")
    texts = [
        "so " + few + " or what",
        few.replace("44", "45"),
        prose(1, 30) + " " + series.lower() + " " + prose(2, 30),
        " ; ".join(map(str, range(40))),
        "The sum of 5 and 6 and 7 is what number here now",
    ]
    found = {(r.doc_id, r.item_id): r for r in templates.find_leaks(table(spark, texts), rows).collect()}
    assert {k: r.changed for k, r in found.items()} == {(0, 1): False, (2, 2): False, (4, 3): True}
    assert found[2, 2].covered == 1.0


def test_items_named_by_texts(spark):
    rows = spark.createDataFrame([("gsm-1", ITEMS[2]), ("gsm-2", ITEMS[1]), (None, ITEMS[3])], "item_id string, text string")
    found = templates.find_leaks(table(spark, [prose(1, 20) + " " + ITEMS[2], ITEMS[3]]), rows)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(0, "gsm-1")]


def test_texts_read_together_do_not_meet(spark, monkeypatch):
    half = ITEMS[2].split()
    texts = [" ".join(half[:20]) + " x", "", " ".join(half[20:]), None, " ".join(half[:25]), " ".join(half[25:])] * 3
    found = set(leaks(spark, texts))
    monkeypatch.setattr(templates, "GROUP_TOKENS", 1)
    assert set(leaks(spark, texts)) == found
