"""Queries of the agent tools and the worker's remaining jobs, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem.catalog import EDGES_SQL, NOW, edges, node_id, read, seconds
from stratamem.functions import text
from stratamem.functions.embed import embed, hashing
from stratamem.operators import ann, graph, insight, rag, vectors
from stratamem.plans.graph_queries import THEN
from stratamem.registry import query


@query("search_nodes", "SELECT s_suppkey, s_name AS label FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 50")
def search_nodes(spark, d):
    return insight.search_nodes(read(spark, d, "supplier"), "s_acctbal > 0", 50, "s_suppkey", F.trim("s_name"))


@query("graph_explore", f"WITH {EDGES_SQL}, f AS (SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY id LIMIT 10) SELECT id, rel, array_to_string(list_sort(list_distinct(list(target))), ',') AS neighbours FROM f LEFT JOIN edges ON source = id AND deleted_at = 0 GROUP BY id, rel")
def graph_explore(spark, d):
    nodes = read(spark, d, "nation").select(node_id("nation", "n_nationkey").alias("id"))
    return insight.explore(nodes, edges(spark, d), 10).withColumn("neighbours", F.array_join("neighbours", ","))


@query("graph_invalidate", f"WITH {EDGES_SQL} SELECT source, target, rel, created_at FROM edges UNION ALL SELECT 'system' AS source, 'supplier:' || s_suppkey AS target, 'invalidates' AS rel, CAST({NOW} AS BIGINT) AS created_at FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'supplier:' || s_suppkey, 'system', 'invalidated_by', {NOW} FROM supplier WHERE s_acctbal < 0")
def graph_invalidate(spark, d):
    gone = read(spark, d, "supplier").filter("s_acctbal < 0").select(node_id("supplier", "s_suppkey").alias("id"))
    return insight.invalidate(edges(spark, d), gone, NOW).select("source", "target", "rel", "created_at")


@query("provenance_path", "WITH c AS (SELECT doc_id, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id || '_' || i AS chunk, 'doc:' || doc_id AS doc, true AS verified FROM c UNION ALL SELECT 'x' || doc_id, 'doc:' || doc_id, false FROM documents")
def provenance_path(spark, d):
    """Every chunk with its document, and as many chunks that no edge verifies."""
    docs = read(spark, d, "documents")
    pieces = rag.chunks(docs, text.fixed_chunks("text", 500))
    links = rag.chunk_edges(pieces).withColumn("deleted_at", F.lit(0))
    root = F.concat(F.lit("doc:"), F.col("doc").cast("string"))
    found = pieces.select(F.col("chunk_id").alias("chunk"), root.alias("doc")).unionByName(docs.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("chunk"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("doc")))
    return insight.provenance(found, links)


@query("sources_by_document", "SELECT o_custkey AS doc, count(*) AS n, max(o_totalprice) AS best, array_to_string(list_sort(list_distinct(list(o_orderkey))), ',') AS chunks FROM orders WHERE o_totalprice >= 1000 GROUP BY o_custkey")
def sources_by_document(spark, d):
    found = read(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("score"))
    return insight.sources_by_document(found, 1000).withColumn("chunks", F.array_join("chunks", ","))


@query("evolution_candidates", f"WITH {EDGES_SQL} SELECT target AS node, count(*) AS in_degree FROM edges WHERE deleted_at = 0 GROUP BY target HAVING count(*) >= 15")
def evolution_candidates(spark, d):
    return insight.evolution_candidates(edges(spark, d))


def _at(days: int) -> str:
    t = THEN - days * 86_400 * 10**9
    walk = f"walk{days}(node, depth) AS (SELECT 'customer:1', 0 UNION SELECT b, depth + 1 FROM walk{days} JOIN (SELECT source AS a, target AS b FROM e{days} UNION ALL SELECT target, source FROM e{days}) ON a = node WHERE depth < 2)"
    return f"e{days} AS (SELECT * FROM edges WHERE rel IN ('placed', 'contains') AND created_at <= {t} AND (deleted_at = 0 OR deleted_at > {t})), {walk}"


_DAYS = (900, 300, 1)


@query("neighbourhood_snapshots", f"WITH RECURSIVE {EDGES_SQL}, {', '.join(map(_at, _DAYS))} " + " UNION ALL ".join(f"SELECT {n} AS days_ago, node, CAST(min(depth) AS INTEGER) AS depth FROM walk{n} GROUP BY node" for n in _DAYS))
def neighbourhood_snapshots(spark, d):
    return insight.snapshots(edges(spark, d), "customer:1", ["placed", "contains"], THEN, _DAYS)


@query("fact_candidates", "SELECT user_id, count(*) AS n, array_to_string(list_sort(list(event_id)), ',') AS ids FROM events WHERE event_type IN ('view', 'click') AND event_id NOT IN (SELECT event_id FROM events WHERE value > 50) GROUP BY user_id")
def fact_candidates(spark, d):
    """Views and clicks are episodic; facts were taken from those of a value over 50."""
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type").isin("view", "click"), "episodic").otherwise("semantic").alias("memory_layer"))
    done = e.filter("value > 50").select(F.col("event_id").alias("source"), F.lit("facts_extracted").alias("rel"), F.lit(0).alias("deleted_at"))
    return insight.fact_candidates(rows, done).withColumn("ids", F.array_join("ids", ","))


@query("memories_summary", "SELECT conv_id, count(*) AS n, md5(string_agg('- ' || substring(text, 1, 200), chr(10) ORDER BY turn DESC)) AS digest FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id")
def memories_summary(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("created_at"), F.col("text").alias("content"))
    return insight.memories_summary(turns, "conv_id").select("conv_id", "n", F.md5("summary").alias("digest"))


@query("user_timeline", "SELECT user_id, count(*) AS n, round(min(epoch_us(ts) / 1e6), 3) AS first_at, round(max(epoch_us(ts) / 1e6), 3) AS last_at, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def user_timeline(spark, d):
    e = read(spark, d, "events").withColumn("at", seconds("ts"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.min("at"), 3).alias("first_at"), F.round(F.max("at"), 3).alias("last_at"), F.count_distinct("event_type").alias("kinds"))


@query("scoped_recall")
def scoped_recall(spark, d):
    """The twenty vectors nearest to vector 0 among those linked to it by their label."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    hub = F.concat(F.lit("label:"), F.col("label").cast("string"))
    links = e.select(hub.alias("source"), F.col("id").alias("target"), F.lit("has").alias("rel"), F.lit(0).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("deleted_at"))
    return insight.scoped_recall(e, links, vectors.vector_of(e, "0", "vector", "id"), "label:0", ["has"], 20)


@query("knn_ivf")
def knn_ivf(spark, d):
    """The ten nearest neighbours of every vector, from the nearest 8 of 16 cells and those that can hold nearer ones."""
    e = read(spark, d, "embeddings")
    return ann.IvfIndex(e, 16).search(e, 10, 8)


@query("knn_int8")
def knn_int8(spark, d):
    """The ten nearest to vector 0 among int8 vectors."""
    e = read(spark, d, "embeddings")
    m = vectors.train_quantizer(e)
    q = F.array(*map(F.lit, vectors.vector_of(e, 0)))
    far = vectors.int8_cosine_distance(vectors.quantize(F.col("embedding"), m), vectors.quantize(q, m))
    return e.select("vec_id", F.round(far, 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("embed_texts")
def embed_texts(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", embed(hashing())("text").alias("vector"))


@query("entity_mentions", r"WITH c AS (SELECT doc_id, i, substring(text, i * 500 + 1, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents WHERE length(text) > 0)), n AS (SELECT DISTINCT lang AS name FROM documents) SELECT DISTINCT doc_id || '_' || i AS source, 'entity:' || lower(name) AS target, 'mentions' AS rel FROM c JOIN n ON list_contains(regexp_extract_all(lower(content), '[\p{L}0-9_]+'), lower(name))")
def entity_mentions(spark, d):
    """The names of the languages, as words, in all chunks."""
    docs = read(spark, d, "documents")
    pieces = rag.chunks(docs, text.fixed_chunks("text", 500))
    return rag.entity_mentions(pieces, docs.select(F.col("lang").alias("name")).distinct())
