"""Event streams: the same functions run on batch and streaming frames of (ts, ...); late data is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def change_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A change log's folder as a stream; every consumer is a query of its own and none loses events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 day", by: tuple[str, ...] = ("event_type",), ts: str = "ts", late: str = LATE) -> DataFrame:
    """(window_start, by..., n, total): counts and summed values per window."""
    rows = _marked(events, ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, size: str = "3 days", slide: str = "1 day", by: tuple[str, ...] = ("event_type",), ts: str = "ts", late: str = LATE) -> DataFrame:
    """(window_start, by..., n): counts per overlapping window."""
    rows = _marked(events, ts, late).groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), *by, "n")


def debounce(events: DataFrame, quiet: str = "5 seconds", least: int = 1, by: str = "user_id", ts: str = "ts", late: str = LATE) -> DataFrame:
    """(by, started, ended, n): bursts of a user's events that a quiet period ended, with at least ``least`` events."""
    rows = _marked(events, ts, late).groupBy(F.session_window(ts, quiet).alias("w"), by).agg(F.count("*").alias("n"), F.max(ts).alias("ended"))
    return rows.filter(F.col("n") >= least).select(by, F.col("w.start").alias("started"), "ended", "n")


def session_state(events: DataFrame, by: str = "session_id", ts: str = "ts", status: str = "status", late: str = LATE) -> DataFrame:
    """(session, status, at): each session's last status."""
    return _marked(events, ts, late).groupBy(by).agg(F.max_by(status, ts).alias("status"), F.max(ts).alias("at"))


def stale_artifacts(events: DataFrame, artifacts: DataFrame, ts: str = "ts", node: str = "node") -> DataFrame:
    """(artifact, entity, events, staleness): a running sum of 0.3 per event on a source; the stream is joined with the static sources."""
    sources = artifacts.select("artifact", "entity", "created_at", F.explode("source_ids").alias(node))
    hits = events.join(sources, node).filter(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 > F.col("created_at"))
    return hits.groupBy("artifact", "entity").agg(F.count("*").alias("events")).withColumn("staleness", F.round(0.3 * F.col("events"), 6))


class CountTrigger:
    """Calls ``act(n)`` once at least ``least`` writes came and ``apart`` seconds passed since the last call; for foreachBatch."""

    def __init__(self, act, least: int = 50, apart: float = 30.0) -> None:
        self.act, self.least, self.apart = act, least, apart
        self.pending, self.last = 0, float("-inf")

    def __call__(self, batch: DataFrame, _: int) -> None:
        n, newest = batch.agg(F.count("*"), F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).first()
        self.pending += n
        if n and self.pending >= self.least and newest - self.last >= self.apart:
            self.act(self.pending)
            self.pending, self.last = 0, newest


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Processes what's there into the in-memory table ``name`` and ends."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the stream to Parquet files, exactly once; by micro-batches ``every`` so often, or what's there and then ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
