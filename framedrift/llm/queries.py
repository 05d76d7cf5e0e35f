"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framedrift.llm import divergence, exact, graphs, language, lines, mixing, packing, phrases, secrets, sharding, simhash, templates, toxicity
from framedrift.llm.common import read_table, shared_folder

SHARDS = 24


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    ledger = f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    secrets.scan_new(docs, ledger, rules)
    found = secrets.findings(docs, ledger, rules, ["doc_id"])
    found = found.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    base = [r.kind for r in secrets.BASE_RULES]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *[count(k) for k in base], F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(documents(spark, sf_dir))
    removed = F.array_join(F.col("removed").cast("array<string>"), ",")
    return cleaned.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), removed.alias("removed"), "text"
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words_per_shingle=3)


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack(documents(spark, sf_dir), *map(public_tokenizers.path, names))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(documents(spark, sf_dir), in_order=True)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


def op12_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nearest_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


QUERIES = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_toxicity": op2_toxicity,
    "op3_line_winnow": op3_line_winnow,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_templates": op7_templates,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_phrases": op11_phrases,
    "op12_graphs": op12_graphs,
    "op13_divergence": op13_divergence,
}
