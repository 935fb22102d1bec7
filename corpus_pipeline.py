"""The corpus pipeline: raw documents to a deduplicated, mixed and tokenised training set, a written table per stage.

Every stage works on all that its predecessor kept.  It is registered as the query ``pipeline``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqlake.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece_dropout
from reqlake.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier can tell; those without a letter or with a narrow margin go."""
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row of the largest doc_id."""
    return exact_dedup.exact_duplicates_dropped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 0.8 Jaccard similarity on five-word shingles the row of the smallest doc_id."""
    return ngram_join.near_duplicates_dropped(docs, k=5, num=4, den=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document under seeded merge dropout, each copy's its own; lossless tells that they decode to the text."""
    return sentencepiece_dropout.encode(docs, per_copy=True, keep=("lang", "source"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("sentencepiece_dropout", pieces)]

#: Compression, random rounding and merge dropout have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; each stage is written as Parquet and reread by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
