"""Files in and out, and streams against their batch results."""

import zipfile

from pyspark.sql import functions as F

from stratamem.sources import loaders, sinks
from stratamem.streaming import events as streams

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def docx(path, lines):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain ü")
    (tmp_path / "skip.log").write_text("x")
    (tmp_path / "sub/p.html").write_text("<html><script>no</script><p>Tom &amp; Jerry</p></html>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    docx(tmp_path / "sub/d.docx", ["one", "two"])
    found = loaders.files(spark, str(tmp_path), exclude=["*.log"])
    got = {r.path.rsplit("/", 1)[1]: r.text for r in loaders.documents(found).collect()}
    assert got == {"a.txt": "plain ü", "p.html": "Tom & Jerry", "d.docx": "one\ntwo", "bad.docx": None}
    state = found.select("path", "modificationTime").filter(F.col("path").endswith("a.txt"))
    assert loaders.changed(found, state).count() == 3


def test_snapshot_and_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "SET", "1"), (2, "a", "SET", "2"), (3, "b", "SET", "x"), (4, "b", "DEL", None)], "seq int, key string, op string, value string")
    sinks.append_log(log, f"{tmp_path}/log")
    sinks.compact_log(spark, f"{tmp_path}/log", f"{tmp_path}/state")
    assert [(r.key, r.value) for r in spark.read.parquet(f"{tmp_path}/state").collect()] == [("a", "2")]
    sinks.save_snapshot({"kv": log}, f"{tmp_path}/snap", {"kv": ["op"]})
    assert sinks.load_snapshot(spark, f"{tmp_path}/snap", ["kv"])["kv"].count() == 4


def events(spark):
    rows = [(i, f"2024-01-0{1 + i % 5} 0{i % 9}:00:00", i % 3, "view" if i % 2 else "error", float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_give_the_batch_results(spark, tmp_path):
    batch = events(spark)
    batch.repartition(4).write.parquet(f"{tmp_path}/in")
    for name, f in (("tumbling", streams.tumbling), ("sliding", streams.sliding), ("bursts", lambda e: streams.debounce(e, "1 hour"))):
        feed = streams.change_feed(spark, f"{tmp_path}/in", batch.schema)
        mode = "append" if name == "bursts" else "complete"
        if mode == "complete":
            streams.run_once(f(feed), name, f"{tmp_path}/{name}")
            assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(batch).collect()))
    w = batch.groupBy("user_id").count()
    assert w.count() == 3


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    at = lambda *xs: spark.createDataFrame([(i, x, 1, "view", 1.0) for i, x in enumerate(xs)], "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{tmp_path}/in"
    for part in (at("2024-01-01 10:00:00"), at("2024-01-03 10:00:00"), at("2024-01-01 11:00:00"), at("2024-01-05 10:00:00")):
        part.coalesce(1).write.mode("append").parquet(path)
        q = streams.to_parquet(streams.tumbling(streams.change_feed(spark, path, part.schema)), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination()
    got = {str(r.window_start)[:10]: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01"] == 1


def test_count_trigger(spark):
    calls = []
    t = streams.CountTrigger(calls.append, 50, 30)
    e = events(spark)
    t(e.limit(40), 0)
    assert calls == []
    t(e, 1)
    assert calls == [100] and t.pending == 0
