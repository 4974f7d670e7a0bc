"""The registered query of each operator: production parameters, whole tables.

Each query is thin: it calls its operator and derives the digest columns. ``ORACLE``
holds DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagbill.llm import (bpe, divergence, html_extract, manifest, ngram_join, packing, quality_model, quality_rules,
                         secrets, simhash, topk, urls)
from tagbill.llm import toxicity as tox
from tagbill.llm.common import held_out, load


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(load(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), keep_text=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = tox.toxicity(docs, labels, held_out(F.col("doc_id"), 5, 0))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents")).drop("failed")


def op4_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("weights"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.span_text(F.concat("base", "added")).alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages")).drop("block_score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    found = quality_model.quality(docs, labels, held_out(F.col("doc_id"), 4, 2))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"), least=10, top_terms=10)


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"), width=3, percent=90)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {c: F.col(c) for c in manifest.COLUMNS}
    lowered = values | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    leaves = load(spark, sf_dir, "documents").select(
        F.col("source"), F.col("doc_id").alias("key"), manifest.leaf(*values.values()).alias("digest"),
        F.when(held_out(F.col("doc_id"), 5, 0), manifest.leaf(*lowered.values())).alias("tampered"))
    folded = manifest.fold(F.coalesce("tampered", "digest"), F.col("witness"))
    return (manifest.manifest(leaves)
            .select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                    F.sha2(manifest.proof_text(F.col("witness")).cast("binary"), 256).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_chunk_reuse": op1_bpe_chunk_reuse,
    "op2_toxicity_neighbours": op2_toxicity_neighbours,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_suffix_array": op4_html_suffix_array,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_secret_scan": op6_secret_scan,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op3_quality_rules": quality_rules.duckdb_sql(),
    "op5_exact_top_k": topk.DUCKDB_SQL,
    "op11_source_divergence": divergence.DUCKDB_SQL,
    "op12_ngram_jaccard_join": ngram_join.DUCKDB_SQL,
    "op13_merkle_manifest": manifest.DUCKDB_SQL,
}
