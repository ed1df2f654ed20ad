"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage but the last returns the columns of documents. Decisions: quality rules drop what
they reject; of each group of near-duplicates one document stays; contaminated documents go;
secrets are masked inside the texts; what is left is packed into sequences.

No contract binds the near-duplicate stage, so the general rule holds (five words, similarity
0.8 or more), not op3's limit of 0.85.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.frames import LlmTables, materialized
from tidemark.llm.near_duplicates import deduplicate
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import tokenizer
from tidemark.llm.secrets import mask_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, LlmTables(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, LlmTables(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; each result is written to the shared folder and reread."""
    docs = LlmTables(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokenizer, no exact binomial bounds and no packing; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None
