"""Documents to packed training sequences, in five stages of tsq.llm.

Each stage works on all that the one before it kept, learns from those
documents alone (and, for quality, the labels table), and returns the columns
of documents; the last one returns pieces of packed sequences.

Defined cases: a null or empty text goes at the first two stages (the quality
of an empty line, no language); rows with one doc_id are one document for the
join; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsq.llm import decontam, jaccard, langid, packing, quality
from tsq.llm.base import prepare, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field doesn't reject (score of 0.7 or more)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a calibrated probability of 0.5 or more."""
    return langid.keep_identified(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return jaccard.keep_one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: No SQL can express the classifiers, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents, each stage's result written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.lower().replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
