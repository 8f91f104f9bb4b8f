"""Helpers shared by the operators: scratch space, joins sized by a check, safe names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows of a few dozen bytes; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"stratamem-{os.getpid()}")
        os.makedirs(path, exist_ok=True)
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: columnar, so later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}{n}"
    return name


def keyed_join(big: DataFrame, small: DataFrame, key: str, how: str, rows: int | None = None) -> DataFrame:
    """``big`` joined with the narrow ``small`` on one column of the same name.

    ``small`` is broadcast if it has at most BROADCAST_ROWS rows (counted unless
    given); otherwise it's the build side of a shuffled hash join, so that the
    wide rows of ``big`` are never sorted.
    """
    n = small.count() if rows is None else rows
    small = F.broadcast(small) if n <= BROADCAST_ROWS else small.hint("shuffle_hash")
    return big.join(small, key, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_safe(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches bounded in bytes as well as rows, so that long texts don't pile up in a worker. A batch is held by the JVM, outside its heap, and by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
