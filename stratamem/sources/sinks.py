"""Tables on disk: a snapshot of a state, and a change log with compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from stratamem.operators import memory


def save_snapshot(tables: dict[str, DataFrame], path: str, partition_by: dict[str, Sequence[str]] | None = None) -> None:
    """Writes each table as Parquet under ``path``, partitioned where asked."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def compact_log(spark: SparkSession, path: str, to: str, key: Sequence[str] = ("key",), seq: str = "seq") -> None:
    """Writes the log's latest row of each live key to ``to``; the log itself stays until its readers have moved."""
    memory.replay(spark.read.parquet(path), key, seq).write.mode("overwrite").parquet(to)
