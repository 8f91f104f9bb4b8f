"""Queries over the property graph, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem.catalog import EDGES_SQL, NOW, edges, node_id, read, seconds
from stratamem.operators import filters, graph, rag
from stratamem.registry import query

#: 1995-06-17 00:00:00 UTC in ns.
THEN = 803_347_200 * 10**9


@query("graph_out_links", f"WITH {EDGES_SQL} SELECT source, target, rel, weight FROM edges WHERE source = 'customer:1' AND deleted_at = 0")
def graph_out_links(spark, d):
    return graph.out_links(edges(spark, d), "customer:1").select("source", "target", "rel", "weight")


@query("graph_in_links", f"WITH {EDGES_SQL} SELECT source, target, rel, weight FROM edges WHERE target = 'nation:1' AND rel = 'located_in' AND deleted_at = 0")
def graph_in_links(spark, d):
    return graph.in_links(edges(spark, d), "nation:1", "located_in").select("source", "target", "rel", "weight")


@query("graph_relations_map", f"WITH {EDGES_SQL} SELECT target AS node, rel, CAST(count(DISTINCT source) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS ids FROM edges WHERE deleted_at = 0 GROUP BY target, rel")
def graph_relations_map(spark, d):
    r = graph.relations(edges(spark, d), incoming=True)
    return r.select("node", "rel", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("graph_traverse_2hop", f"WITH {EDGES_SQL}, a AS (SELECT DISTINCT 1 AS hop, source, rel, target AS node FROM edges WHERE source = 'customer:1' AND rel = 'located_in' AND deleted_at = 0) SELECT * FROM a UNION ALL SELECT DISTINCT 2, e.source, e.rel, e.target FROM edges e JOIN a ON e.source = a.node WHERE e.rel = 'in' AND e.deleted_at = 0")
def graph_traverse_2hop(spark, d):
    return graph.traverse(edges(spark, d), "customer:1", "located_in.in")


_BOTH = "both_ AS (SELECT source AS a, target AS b FROM kept UNION ALL SELECT target, source FROM kept)"


def _walk(root: str, rels: str, depth: int) -> str:
    return f"kept AS (SELECT * FROM edges WHERE deleted_at = 0 AND rel IN ({rels})), {_BOTH}, walk(node, depth) AS (SELECT '{root}', 0 UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = node WHERE depth < {depth}), seen AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node)"


@query("graph_subgraph_bfs", f"WITH RECURSIVE {EDGES_SQL}, {_walk('region:0', "'in', 'located_in', 'placed'", 3)} SELECT node, depth FROM seen")
def graph_subgraph_bfs(spark, d):
    return graph.reach(edges(spark, d), spark.createDataFrame([("region:0",)], "node string"), ["in", "located_in", "placed"], "both", 3)


@query("graph_subgraph_edges", f"WITH RECURSIVE {EDGES_SQL}, {_walk('customer:1', "'located_in', 'placed'", 2)} SELECT source, target, rel, weight, 'out' AS direction FROM kept WHERE source IN (SELECT node FROM seen WHERE depth < 2) AND target IN (SELECT node FROM seen) UNION ALL SELECT source, target, rel, weight, 'in' FROM kept WHERE target IN (SELECT node FROM seen WHERE depth < 2) AND source IN (SELECT node FROM seen)")
def graph_subgraph_edges(spark, d):
    return graph.subgraph(edges(spark, d), "customer:1", ["located_in", "placed"], 2)[1]


_RING = "SELECT CAST(a.vec_id AS VARCHAR) AS source, CAST(b.vec_id AS VARCHAR) AS target FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"
_NEAR0 = "near AS (SELECT CAST(vec_id AS VARCHAR) AS node FROM (SELECT vec_id, 1 - list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product((SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0), (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) AS far FROM embeddings) WHERE far <= 0.95)"


@query("graph_subgraph_guided", f"WITH RECURSIVE links AS ({_RING}), {_NEAR0}, walk(node, depth) AS (SELECT '0', 0 UNION SELECT target, depth + 1 FROM walk JOIN links ON source = walk.node JOIN near ON near.node = target WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node")
def graph_subgraph_guided(spark, d):
    """From vector 0 along same-label links, entering only vectors within distance 0.95 of it."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    q = list(e.filter("id = '0'").first()["embedding"])
    hubs = e.select(F.col("id").alias("node"), F.col("label").alias("hub"))
    return graph.reach(None, spark.createDataFrame([("0",)], "node string"), depth=2, guide=(e, q, 0.95), hubs=hubs)


@query("graph_find_path", f"WITH RECURSIVE {EDGES_SQL}, walk(node, path) AS (SELECT 'customer:1', ['customer:1'] UNION SELECT target, list_append(path, target) FROM walk JOIN edges ON source = node WHERE deleted_at = 0 AND rel IN ('placed', 'located_in', 'in') AND len(path) <= 3) SELECT node, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path), path) = 1")
def graph_find_path(spark, d):
    """The shortest path from customer 1 to everything it reaches in three steps."""
    p = graph.shortest_paths(edges(spark, d), "customer:1", ["placed", "located_in", "in"], 3)
    return p.select("node", "length", F.array_join("path", ">").alias("path"))


@query("graph_time_travel", f"WITH {EDGES_SQL} SELECT source, target, rel, weight FROM edges WHERE created_at <= {THEN} AND (deleted_at = 0 OR deleted_at > {THEN})")
def graph_time_travel(spark, d):
    return edges(spark, d).filter(graph.active(THEN)).select("source", "target", "rel", "weight")


@query("graph_scope_filter", "SELECT 'supplier:' || s_suppkey AS id, s_acctbal FROM supplier WHERE s_nationkey = 1 AND s_acctbal > 0")
def graph_scope_filter(spark, d):
    """Suppliers with a positive balance within one hop of nation 1."""
    ids = graph.scope(edges(spark, d), "nation:1", ["located_in"], "in")
    rows = read(spark, d, "supplier").select(node_id("supplier", "s_suppkey").alias("id"), "s_acctbal")
    return filters.where(rows, "s_acctbal > 0").join(ids, "id", "left_semi")


_COMMANDS = "c AS (SELECT user_id AS source, event_type AS target, 'did' AS rel, CASE WHEN value > 50 THEN 1 ELSE 0 END AS weight, epoch_us(ts) * 1000 AS moment, event_id AS seq FROM events)"


@query("graph_scd2_merge", f"WITH {_COMMANDS}, n AS (SELECT *, lag(weight) OVER w AS was, row_number() OVER w AS nth FROM c WINDOW w AS (PARTITION BY source, target, rel ORDER BY moment, seq)), k AS (SELECT * FROM n WHERE nth = 1 OR weight IS DISTINCT FROM was) SELECT source, target, rel, weight, moment AS created_at, coalesce(lead(moment) OVER (PARTITION BY source, target, rel ORDER BY moment, seq), 0) AS deleted_at FROM k")
def graph_scd2_merge(spark, d):
    e = read(spark, d, "events")
    commands = e.select(F.col("user_id").alias("source"), F.col("event_type").alias("target"), F.lit("did").alias("rel"), F.when(F.col("value") > 50, 1).otherwise(0).alias("weight"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at"), F.col("event_id").alias("seq"))
    return graph.merge_versions(commands)


@query("graph_vacuum", f"WITH {EDGES_SQL} SELECT rel, count(*) AS n, round(sum(weight), 6) AS weight FROM edges WHERE deleted_at = 0 OR deleted_at > {THEN} GROUP BY rel")
def graph_vacuum(spark, d):
    return graph.vacuum(edges(spark, d), THEN).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("graph_cascade_delete", f"WITH {EDGES_SQL}, gone AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < 0) SELECT rel, deleted_at = 0 AS active, count(*) AS n FROM (SELECT rel, CASE WHEN deleted_at = 0 AND (source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)) THEN {NOW} ELSE deleted_at END AS deleted_at FROM edges) GROUP BY ALL")
def graph_cascade_delete(spark, d):
    """Customers and suppliers in the red are deleted, and with them their links."""
    gone = read(spark, d, "supplier").filter("s_acctbal < 0").select(node_id("supplier", "s_suppkey").alias("id")).unionByName(read(spark, d, "customer").filter("c_acctbal < 0").select(node_id("customer", "c_custkey").alias("id")))
    return graph.cascade(edges(spark, d), gone, NOW).groupBy("rel", (F.col("deleted_at") == 0).alias("active")).agg(F.count("*").alias("n"))


@query("graph_unlink", f"WITH {EDGES_SQL} SELECT source, target, rel, CASE WHEN source LIKE 'supplier:%' AND deleted_at = 0 THEN {NOW} ELSE deleted_at END AS deleted_at FROM edges WHERE rel = 'located_in'")
def graph_unlink(spark, d):
    """All suppliers' locations are closed."""
    held = edges(spark, d).filter("rel = 'located_in'")
    links = held.filter(F.col("source").startswith("supplier:")).select("source", "target", "rel")
    return graph.unlink(held, links, NOW).select("source", "target", "rel", "deleted_at")


@query("graph_degree", f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges WHERE deleted_at = 0 UNION ALL SELECT target FROM edges WHERE deleted_at = 0) GROUP BY node")
def graph_degree(spark, d):
    return graph.degree(edges(spark, d))


@query("graph_induced", f"WITH {EDGES_SQL}, ids AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1) SELECT source, target, rel FROM edges WHERE deleted_at = 0 AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)")
def graph_induced(spark, d):
    ids = read(spark, d, "customer").filter("c_acctbal > 0").select(node_id("customer", "c_custkey").alias("id")).unionByName(read(spark, d, "nation").filter("n_regionkey = 1").select(node_id("nation", "n_nationkey").alias("id")))
    return graph.induced(edges(spark, d), ids).select("source", "target", "rel")


@query("graph_dead_links", f"WITH {EDGES_SQL} SELECT source, target FROM edges WHERE rel = 'placed' AND deleted_at = 0 AND source = 'customer:1' AND target NOT IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def graph_dead_links(spark, d):
    """Customer 1's orders, as if the finished ones had been deleted as nodes: the links that are left without a target."""
    nodes = read(spark, d, "orders").filter("o_orderstatus != 'F'").select(node_id("order", "o_orderkey").alias("id"))
    return graph.connections(edges(spark, d), nodes, "customer:1", "placed")[1].select("source", "target")


@query("graph_evolution_chain", "WITH RECURSIVE links AS (SELECT conv_id || ':' || turn AS source, conv_id || ':' || lead(turn) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), walk(root, step, node) AS (SELECT DISTINCT conv_id || ':' || min(turn) OVER (PARTITION BY conv_id), 0, conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) FROM conversations UNION ALL SELECT root, step + 1, target FROM walk JOIN links ON source = node WHERE target IS NOT NULL) SELECT root, CAST(step AS INTEGER) AS step, node FROM walk")
def graph_evolution_chain(spark, d):
    """Every conversation followed from its first turn by links from turn to turn."""
    from pyspark.sql import Window

    c = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    at = lambda x: F.concat(F.col("conv_id").cast("string"), F.lit(":"), x.cast("string"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    links = c.withColumn("next", F.lead("turn").over(w)).filter("next is not null").select(at(F.col("turn")).alias("source"), at(F.col("next")).alias("target"), F.lit("superseded_by").alias("rel"), F.lit(0).alias("created_at"), F.lit(0).alias("deleted_at"))
    start = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(at(F.col("turn")).alias("node"))
    return graph.chain(links, start, "superseded_by")


@query("rag_expand_greedy", f"""WITH {EDGES_SQL}, e AS (SELECT source, target, CASE rel WHEN 'in' THEN 0.8 WHEN 'placed' THEN 0.5 ELSE 0.3 END AS w FROM edges WHERE deleted_at = 0),
d0 AS (SELECT 'customer:' || c_custkey AS root, 'customer:' || c_custkey AS node, 0 AS depth, CAST(1 AS DOUBLE) AS score FROM customer),
d1 AS (SELECT root, target AS node, 1 AS depth, max(score * w) AS score FROM d0 JOIN e ON source = node GROUP BY root, target),
d2 AS (SELECT root, target AS node, 2 AS depth, max(score * w) AS score FROM d1 JOIN e ON source = node GROUP BY root, target),
found AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 ANTI JOIN d1 USING (root, node))
SELECT root, node, CAST(depth AS INTEGER) AS depth, round(score, 6) AS score FROM found QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, score DESC, node) <= 200""")
def rag_expand_greedy(spark, d):
    """Every customer's neighbourhood of two steps, with scores that fade by relation."""
    seeds = read(spark, d, "customer").select(node_id("customer", "c_custkey").alias("root")).withColumn("node", F.col("root"))
    return rag.expand(seeds, edges(spark, d), {"in": 0.8, "placed": 0.5})
