"""From raw documents to packed sequences: quality rules, near-dedup, source mix, packing.

``STAGES`` are applied in order by ``run``. Each takes the session, the documents its
predecessor left and the folder of the tables; all but the last give the columns of
documents. What a stage gives is written to the shared scratch folder and read back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm.line_quality import clean_documents
from annolytics.llm.minmax_dedup import NearDupSettings, distinct_documents
from annolytics.llm.mixing import mixed_documents
from annolytics.llm.packing import pack_documents, piece_columns
from annolytics.session import settle

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines, and the documents that the rules reject."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return distinct_documents(docs, settings=NearDupSettings())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each run of them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    packed = pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return packed.select(F.col("_rest.doc_id").alias("doc_id"), "ids", *piece_columns())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

# Tokenisation and packing are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
