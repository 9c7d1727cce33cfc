"""From raw documents to packed token sequences, in five stages.

Every stage reads all rows that the one before kept, and its decisions take effect.  Stages meet in Parquet
tables in the session's shared folder, so that a lost executor costs no more than a part of one stage.  All
stages but the last return the columns of `documents`; the last returns one row per packed piece.

Edge cases follow the operators: null texts are empty and null ids sort last; an empty table passes through
every stage; rows that repeat an id stay or go together in the near-duplicate stage and are otherwise rows of
their own; further columns ride along to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import crf, line_dedup, mixing, packing, shingle_join
from citegrain.llm.texts import documents, labels
from citegrain.operators.durable import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain scores 0.7 or more; it learns from the labelled ones outside the held-out fold."""
    return crf.keep_good(docs, crf.fit(docs, labels(spark, sf_dir)), threshold=0.7)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy copies of earlier lines go; documents whose every line was a copy go with them."""
    left = line_dedup.drop_emptied(docs)
    if "n_chars" not in left.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return shingle_join.one_per_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_deduplication", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

# The fitted chain, the MinHash bands and the tokenizer have no SQL; tests check counts, columns and ids of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
