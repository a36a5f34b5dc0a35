"""From raw documents to packed training sequences: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import binpacking, bytegru, divergence, linebitmaps, orderminhash
from runledger.session import materialised

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language the network cannot tell."""
    return bytegru.accepted(docs, bytegru.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are far from their language's distributions."""
    return divergence.accepted(docs, divergence.references(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; ``n_chars`` follows the text, no document goes."""
    out = linebitmaps.line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return orderminhash.near_duplicate_rows(docs).where("kept").select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of the documents into sequences; one row per piece."""
    return binpacking.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id), ("quality_rules", quality_rules), ("line_dedup", line_dedup),
    ("near_dedup", near_dedup), ("packing", packing),
]

#: Trained networks, alignment and packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs)
    return docs
