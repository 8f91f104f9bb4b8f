"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. One row per distinct length then
carries prefix and suffix sums, from which totals, quantiles and truncated
totals follow for every context limit: with the limit L between two lengths,
tokens kept = tokens of documents up to L + L x documents longer than L.

The histogram has as many rows as there are distinct lengths, so at most as
many as the longest document has tokens, whatever the number of documents; its
running sums are the only part that isn't spread over tasks.

Defined results. NULL and empty texts have length 0. Repeated rows count each.
An empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY
from .common import arrow_safe, read
from .tokens import library


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, documents): how many documents of a batch have so many tokens; lengths repeat between batches."""
    arrow_safe(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = library(vocabulary).ids
        for batch in batches:
            found = np.array([len(ids(s)) >> 2 if s else 0 for s in batch.column("text").to_pylist()], np.int64)
            length, count = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_pydict({"length": pa.array(length), "documents": pa.array(count.astype(np.int64))})

    return docs.select("text").mapInArrow(run, "length bigint, documents bigint")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct length.

    ``tokens``: of the documents of this length. ``documents_upto`` and
    ``tokens_upto``: of those up to it. ``documents_over``: of longer ones.
    ``tokens_truncated``: all tokens if each document is cut to this length.
    ``share_upto``: the part of the documents up to it, for quantiles.
    """
    counted = lengths(docs, vocabulary).groupBy("length").agg(F.sum("documents").alias("documents"))
    counted = counted.withColumn("tokens", F.col("length") * F.col("documents"))
    upto = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.withColumns({
        "documents_upto": F.sum("documents").over(upto), "tokens_upto": F.sum("tokens").over(upto),
        "documents_over": F.coalesce(F.sum("documents").over(over), F.lit(0)),
    })
    return summed.withColumns({
        "tokens_truncated": F.col("tokens_upto") + F.col("length") * F.col("documents_over"),
        "share_upto": F.col("documents_upto") / (F.col("documents_upto") + F.col("documents_over")),
    })


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens_kept, documents_cut) for each context limit."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context bigint")
    per = F.least("length", "context")
    # a handful of limits meet the histogram
    return wanted.join(hist).groupBy("context").agg(F.sum(per * F.col("documents")).alias("tokens_kept"), F.sum(F.when(F.col("length") > F.col("context"), F.col("documents")).otherwise(0)).alias("documents_cut"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents doesn't exceed."""
    wanted = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return wanted.join(hist, hist.share_upto >= wanted.share).groupBy("share").agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read(spark, sf_dir, "documents"))
