"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

* quality rules: documents that fail a rule go.
* toxicity: the model learns from ``labels`` and from what is left of the labelled
  documents; documents that score 0.5 or more go.
* near duplicates: of each SimHash group the document with the smallest id stays.
* secrets: every span found is replaced in the text; no document goes.
* packing: one row a piece of a document, with its bucket, batch and slot.

``run`` keeps its intermediate tables in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagbill.llm import packing, quality_rules, secrets, simhash, toxicity
from tagbill.llm.common import held_out, load, prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, load(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_distance=4)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Nearest neighbours, XXH64 fingerprints and randomness tests have no SQL form;
#: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
