"""From raw documents to training tokens, in five stages.

Each stage works on all rows that the one before it kept.  Nulls in any column, empty and very long texts, repeated rows,
empty tables and columns with other names of the same kind are treated as the stages' operators say; none of them ends a
stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.bpe import encode_documents
from keyloom.llm.minhash import deduplicated
from keyloom.llm.mixing import mixed_documents
from keyloom.llm.quality_model import good_documents
from keyloom.llm.secrets import Forest, common_words, findings_by_form, redacted
from keyloom.llm.shared import keep, table

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return redacted(docs, Forest(findings_by_form(docs), common_words(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of the ids and of what they decode to."""
    return encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: The stages learn models and follow links, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
