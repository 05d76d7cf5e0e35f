"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import framedrift
from framedrift.functions.octets import opaque
from framedrift.llm import language, lines, packing, simhash, templates
from framedrift.llm.common import read_table, shared_folder

# Functions travel to the workers by value, wherever those were started.
cloudpickle.register_pickle_by_value(framedrift)

LEAST_SCORE = 0.5
WORDS = 5
LEAST_SIMILARITY = 0.8


def _with_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_semi) or isn't (left_anti) in ``ids``; null ids are equal."""
    ids = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with LEAST_SCORE or more.

    The score is a posterior over the languages learned, so it says which of them fits best, not that it
    fits well: texts in a language that was never learned mostly stay. Null and empty texts go. Rows with
    null ids or languages are judged by their text like all others. Long texts are read whole. An empty
    table, or one to learn nothing from, gives no rows; columns of any name are kept.
    """
    kept = docs.columns
    found = language.identify(
        docs.withColumn("_docs", F.struct(*kept)), public_tokenizers.path("piece_bpe_32k.model")
    )
    certain = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(certain).select("_docs.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later copies of runs of lines; those with no word left go.

    ``n_chars`` follows the text where there is such a column. Null, empty and blank texts go; repeated
    rows get the same result. A text is cut into lines once, however long. An empty table gives no rows;
    columns of any name are kept.
    """
    kept = docs.columns
    # Columns that carry the names of the operator's results are set aside.
    aside = {c: f"_own_{c}" for c in ("n_lines", "removed") if c in kept}
    cleaned = lines.drop_repeated_lines(docs.withColumnsRenamed(aside))
    # Opaque, as a filter moved below it would cut the whole text anew for each of its lines.
    cleaned = cleaned.withColumn("text", opaque(F.col("text")))
    cleaned = cleaned.withColumns({c: F.col(own) for c, own in aside.items()}) if aside else cleaned
    if "n_chars" in kept:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.where(_has_words(F.col("text"))).select(*kept)


def _has_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(lines.WORD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of WORDS words, LEAST_SIMILARITY or more) the document with the least id.

    Rows that repeat an id stay or go together. Rows without an id go if all of them have a near copy
    with one, and otherwise stay. Texts without words are one group. Whole texts are compared; an empty
    table gives no rows; columns of any name are kept.
    """
    groups = simhash.near_copies(docs, words_per_shingle=WORDS, least=LEAST_SIMILARITY)
    return _with_id(docs, groups.select(F.col("component_id").alias("doc_id")).distinct(), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that show no benchmark item. Rows that repeat an id go together; null ids are one id.

    Null and empty texts stay. Whole texts are searched; without documents or items nothing goes; columns of
    any name are kept.
    """
    leaks = templates.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return _with_id(docs, leaks.select("doc_id").distinct(), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids.

    Null and empty texts are one end token; repeated rows are packed as often as they stand; long texts
    take several sequences. An empty table gives no rows. Other columns than id and text are not read.
    """
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack(docs, *map(public_tokenizers.path, names), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("packing", pack),
]

# The language model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
