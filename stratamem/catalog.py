"""Tables, the graph model over the star schema, and where intermediate results go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows, after they're counted.
BROADCAST_ROWS = 200_000
#: The end of the event tables' time, in seconds: 2024-01-31 00:00:00 UTC. `now` is always a parameter.
NOW = 1_706_659_200
DAY = 86_400


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """Makes tables available to ``spark.sql``."""
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so that iterations don't grow their plans and lost executors cost no rerun."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = given or os.path.join(tempfile.gettempdir(), f"stratamem-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def arrow_safe(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches bounded in bytes as well as rows, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def seconds(ts: str | Column) -> Column:
    """A timestamp column as seconds since 1970 (UTC), double."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / F.lit(1e6)


def nanos(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) * F.lit(1000)


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property graph: (source, target, rel, weight, created_at, deleted_at), times in ns, deleted_at 0 while active.

    customer -placed-> order -contains-> part (until shipped), supplier
    -supplies-> part, customer and supplier -located_in-> nation -in-> region.
    """
    t = lambda name: read(spark, sf_dir, name)
    always = F.lit(0).cast("bigint")

    def of(df, source, target, rel, weight=F.lit(1.0), created=always, deleted=always):
        return df.select(source.alias("source"), target.alias("target"), F.lit(rel).alias("rel"), weight.cast("double").alias("weight"), created.alias("created_at"), deleted.alias("deleted_at"))

    orders, lines = t("orders"), t("lineitem")
    contains = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    # an order that ships on the day it's placed has an empty interval and never shows
    parts = [
        of(orders, node_id("customer", "o_custkey"), node_id("order", "o_orderkey"), "placed", created=nanos("o_orderdate")),
        of(contains, node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "contains", F.col("l_quantity"), nanos("o_orderdate"), nanos("l_shipdate")),
        of(lines.select("l_suppkey", "l_partkey").distinct(), node_id("supplier", "l_suppkey"), node_id("part", "l_partkey"), "supplies"),
        of(t("customer"), node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "located_in"),
        of(t("supplier"), node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "located_in"),
        of(t("nation"), node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "in"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same edges for DuckDB, to start a WITH list.
EDGES_SQL = """edges AS (
  SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'placed' AS rel, CAST(1 AS DOUBLE) AS weight, epoch_us(o_orderdate) * 1000 AS created_at, CAST(0 AS BIGINT) AS deleted_at FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', l_quantity, epoch_us(o_orderdate) * 1000, epoch_us(l_shipdate) * 1000 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', CAST(1 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lineitem
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1, 0, 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1, 0, 0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'in', 1, 0, 0 FROM nation)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as `mentions` edges (event -> user): source, target, rel, at (seconds), content, value."""
    e = read(spark, sf_dir, "events")
    return e.select(node_id("event", "event_id").alias("source"), node_id("user", "user_id").alias("target"), F.lit("mentions").alias("rel"), seconds("ts").alias("at"), F.col("event_type").alias("content"), "value")


MENTIONS_SQL = "mentions AS (SELECT 'event:' || event_id AS source, 'user:' || user_id AS target, 'mentions' AS rel, epoch_us(ts) / 1e6 AS moment, event_type AS content, value FROM events)"
