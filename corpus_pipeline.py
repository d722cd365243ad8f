"""A training-corpus pipeline: each stage takes the documents its predecessor kept and makes its decision take effect.

All stages but the last return the columns of their input in its order, whatever other columns there are; names that
clash with an operator's own do no harm. An empty table gives an empty one. A null doc_id counts as larger than any
other; rows are told by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.exact_dedup import drop_exact
from quadrille.llm.language_id import keep_known
from quadrille.llm.ngram_join import drop_near
from quadrille.llm.packing import pack
from quadrille.llm.secrets import redact_secrets
from quadrille.llm.shared import Scratch, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told; null texts, those without a letter and those below even odds go. Repeated rows fare alike."""
    return keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id. Null counts as empty, of which one stays."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of texts linked at Jaccard 0.8 on five-word shingles. Null and empty texts link with nothing and stay."""
    return drop_near(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text, and null texts stay null."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; null and empty texts are one end id."""
    return pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: Naive Bayes and tokenizers have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
