"""The corpus pipeline: from raw documents to token ids of a deduplicated, mixed corpus.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import bpe, line_dedup, mixing, near_dedup, quality
from stratamem.llm.common import fresh, read, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It's trained on the labelled ones among them."""
    return quality.reject_low_quality(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones hold; one that is left with nothing goes."""
    n = fresh(docs, "removed")
    return line_dedup.dedup_lines(docs, removed=n).filter(~((F.col(n) > 0) & (F.col("text") == ""))).drop(n)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows, in equal parts from all sources; a document may occur several times or not at all."""
    n = fresh(docs, "copy_no")
    return mixing.sample(docs, mixing.WEIGHTS, copy_no=n).drop(n)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of each row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the classifier, the sampling of shingles or the merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents, the other stages' results being written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
