"""The registered queries against their SQL, and the pipeline's stages against what they must keep."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from checks.compare import TABLES, rows_of
from framedrift.llm.oracle import ORACLE
from framedrift.llm.queries import QUERIES
from tests.llm.material import ODD, prose, table

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@needs_data
def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows.select("doc_id").distinct().count() > 0.9 * whole.dropDuplicates(["text"]).count() - 10
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


@needs_data
def test_stages_keep_clean_rows_and_columns(spark):
    clean = [(1000 + i, prose(200 + i, 60 + i) + ".") for i in range(12)]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    texts = [*[t for t in ODD if isinstance(t, str)], *clean, (2000, clean[3][1]), (2001, "x " + item + " y")]
    docs = table(spark, texts).withColumnRenamed("n", "n_lines")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        assert docs.schema.names == before.schema.names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
        assert {i for i, _ in clean} <= kept[name], name
    assert not {0, 1} & kept["language"]  # no letters
    assert 2000 not in kept["lines"]  # nothing of its own
    assert 2001 in kept["near_copies"] and 2001 not in kept["leaks"]


def test_line_stage_cuts_each_text_once(spark):
    docs = table(spark, [prose(300, 50) + ". " + prose(301, 50)])
    plan = corpus_pipeline.drop_lines(spark, docs, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # One cut of the text in each of its two uses; none stands inside a lambda.
    assert not re.search(r"lambdafunction\([^)]*split\(", plan)
    assert all("split(" not in line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter"))


@needs_data
def test_stages_on_an_empty_table(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_near_copy_stage_drops_pairs_at_its_similarity(spark):
    words = prose(70, 200).split()
    near = [*words[:50], "one", *words[51:120], "two", *words[121:]]  # 186 of 206 shingles in common
    far = [w if i % 40 else "other" for i, w in enumerate(words)]  # 165 of 227
    far[20:100:20] = ["more"] * 4
    docs = table(spark, [" ".join(words), " ".join(near), " ".join(far), prose(71, 200)])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()} == {0, 2, 3}
