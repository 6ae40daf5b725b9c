"""Corpus pipeline: raw documents to packed token sequences.

Each stage takes the documents that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm.mixing import mix_documents
from plantcast.llm.packing import pack_documents
from plantcast.llm.secrets import redact_secrets
from plantcast.llm.shared import read_table, stored
from plantcast.llm.simhash import drop_near_copies
from plantcast.llm.toxicity import fit_severity, labelled_sample, score_toxicity

VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = fit_severity(labelled_sample(docs, labels))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    return score_toxicity(whole, model).where(~F.col("toxic")).select("doc.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of three-word shingle fingerprints at most three bits apart."""
    return drop_near_copies(docs, shingle=3, radius=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

# The first stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
