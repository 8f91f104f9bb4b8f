"""The temporal property graph: edges (source, target, rel, weight, created_at, deleted_at), deleted_at 0 while active."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.catalog import cut, small
from stratamem.operators import vectors

MOST_DEPTH = 5


def active(at: int | None = None) -> Column:
    """Whether an edge holds: now, or at the time ``at`` (ns)."""
    if not at:
        return F.col("deleted_at") == 0
    return (F.col("created_at") <= at) & ((F.col("deleted_at") == 0) | (F.col("deleted_at") > at))


def _kept(edges: DataFrame, rels: list[str] | None, at: int | None) -> DataFrame:
    rows = edges.filter(active(at))
    return rows if rels is None else rows.filter(F.col("rel").isin(rels))


def out_links(edges: DataFrame, source: str, rel: str | None = None, at: int | None = None) -> DataFrame:
    return _kept(edges, rel and [rel], at).filter(F.col("source") == source)


def in_links(edges: DataFrame, target: str, rel: str | None = None, at: int | None = None) -> DataFrame:
    return _kept(edges, rel and [rel], at).filter(F.col("target") == target)


def relations(edges: DataFrame, node: str | None = None, incoming: bool = False) -> DataFrame:
    """(node, rel, ids): each node's active neighbours by relation, sorted."""
    here, there = ("target", "source") if incoming else ("source", "target")
    rows = edges.filter(active())
    rows = rows if node is None else rows.filter(F.col(here) == node)
    return rows.groupBy(F.col(here).alias("node"), "rel").agg(F.array_sort(F.collect_set(there)).alias("ids"))


def relations_map(edges: DataFrame, node: str, incoming: bool = False) -> DataFrame:
    """One row per node with a map from relation to neighbours."""
    return relations(edges, node, incoming).groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "ids")))).alias("relations"))


def traverse(edges: DataFrame, start: str, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """(hop, source, rel, node): a dotted path of relations from ``start`` over active edges; nodes unknown to ``nodes`` are left out."""
    rows, frontier = None, None
    rels = path.split(".")
    if len(rels) > 10:
        raise ValueError("a path has at most 10 relations")
    for hop, rel in enumerate(rels, 1):
        step = _kept(edges, [rel], None)
        step = step.filter(F.col("source") == start) if frontier is None else step.join(small(frontier), "source")
        step = step.select(F.lit(hop).alias("hop"), "source", "rel", F.col("target").alias("node")).distinct()
        if nodes is not None:
            step = step.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("hop", "source", "rel", "node")
        step = cut(step)
        frontier = step.select(F.col("node").alias("source")).distinct()
        rows = step if rows is None else rows.unionByName(step)
    return rows


def reach(edges: DataFrame | None, roots: DataFrame, rels: list[str] | None = None, direction: str = "both", depth: int = 1, at: int | None = None, guide: tuple[DataFrame, list[float], float] | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` hops of ``roots`` (a column node), each with its least depth.

    ``guide`` is (vectors(id, embedding), query vector, most distance):
    neighbours farther from the query, or without a vector, are not entered.
    Each hop joins the new nodes with the edges and drops those already seen.

    ``hubs`` (node, hub) stands for edges between all nodes of a hub, in place
    of ``edges`` or besides them: a hop goes through the new nodes' hubs, so
    that these edges, as many as the square of a hub's nodes, are never made.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    ways = []
    if edges is not None:
        kept = _kept(edges, rels, at)
        if direction in ("out", "both"):
            ways.append(kept.select(F.col("source").alias("node"), F.col("target").alias("next")))
        if direction in ("in", "both"):
            ways.append(kept.select(F.col("target").alias("node"), F.col("source").alias("next")))
    elif hubs is None:
        raise ValueError("there are neither edges nor hubs")

    def step(front: DataFrame) -> DataFrame:
        found = [way.join(front, "node").select(F.col("next").alias("node")) for way in ways]
        if hubs is not None:
            through = cut(hubs.join(front, "node").filter("hub is not null").select("hub").distinct())
            found.append(hubs.join(small(through), "hub", "left_semi").filter("node is not null").select("node"))
        return reduce(DataFrame.unionByName, found).distinct()

    seen = frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, min(depth, MOST_DEPTH) + 1):
        new = step(small(frontier.select("node"))).join(seen.select("node"), "node", "left_anti")
        if guide is not None:
            table, query, most = guide
            far = vectors.cosine_distance(F.col("embedding"), F.array(*map(F.lit, query)))
            new = new.join(table.select(F.col("id").alias("node"), "embedding"), "node").filter(far <= most).select("node")
        frontier = cut(new.withColumn("depth", F.lit(d)))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier)) if d < depth else seen.unionByName(frontier)
    return seen


def scope(edges: DataFrame, root: str, rels: list[str], direction: str = "out", depth: int = 1) -> DataFrame:
    """The ids a graph-scoped search may return: ``root`` and what it reaches."""
    spark = edges.sparkSession
    return reach(edges, spark.createDataFrame([(root,)], "node string"), rels, direction, depth).select(F.col("node").alias("id"))


def subgraph(edges: DataFrame, root: str, rels: list[str], depth: int = 1, at: int | None = None, guide=None) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges among hops) of the neighbourhood. Without relations just the root."""
    spark = edges.sparkSession
    nodes = reach(edges, spark.createDataFrame([(root,)], "node string"), rels, "both", depth, at, guide)
    inner = nodes.filter(F.col("depth") < min(depth, MOST_DEPTH)).select("node")
    known = nodes.select("node")
    kept = _kept(edges, rels, at)
    touched = lambda here, there, way: kept.join(inner.withColumnRenamed("node", here), here, "left_semi").join(known.withColumnRenamed("node", there), there, "left_semi").withColumn("direction", F.lit(way))
    found = touched("source", "target", "out").unionByName(touched("target", "source", "in"))
    return nodes, found.select("source", "target", "rel", "weight", "direction")


def shortest_paths(edges: DataFrame, source: str, rels: list[str], longest: int, at: int | None = None) -> DataFrame:
    """(node, length, path): the shortest directed path from ``source`` to each node it reaches; ties go to the least path."""
    if not rels:
        raise ValueError("path finding needs relations")
    kept = _kept(edges, rels, at).select(F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(source, 0, [source])], "node string, length int, path array<string>")
    for n in range(1, longest + 1):
        new = kept.join(small(frontier.select("node", "path")), "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        new = new.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(new.select("node", F.lit(n).alias("length"), "path"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def find_path(edges: DataFrame, source: str, target: str, rels: list[str], max_depth: int = 4, at: int | None = None) -> DataFrame:
    """The shortest path as one row (node, length, path), or none. Both ends expand once per depth, so paths have at most 2 max_depth - 1 edges."""
    return shortest_paths(edges, source, rels, 2 * max_depth - 1, at).filter(F.col("node") == target)


def degree(edges: DataFrame, at: int | None = None, rels: list[str] | None = None) -> DataFrame:
    """(node, degree): active edges in and out; an edge to itself counts twice."""
    rows = _kept(edges, rels, at)
    ends = rows.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def merge_versions(commands: DataFrame, keys: tuple[str, ...] = ("source", "target", "rel"), values: tuple[str, ...] = ("weight",), time: str = "at", order: str = "seq") -> DataFrame:
    """Link commands as edge versions [created_at, deleted_at): one that repeats the values before it changes nothing, others close the version before."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    first = F.row_number().over(w) == 1
    changed = commands.withColumn("_new", first | ~same).filter("_new").drop("_new")
    return changed.select(*keys, *values, F.col(time).alias("created_at"), F.coalesce(F.lead(time).over(w), F.lit(0).cast(commands.schema[time].dataType)).alias("deleted_at"))


def unlink(edges: DataFrame, links: DataFrame, now: int, hard: bool = False) -> DataFrame:
    """Closes (or, if ``hard``, removes all versions of) the edges that ``links`` (source, target, rel) names."""
    key = ["source", "target", "rel"]
    if hard:
        return edges.join(small(links), key, "left_anti").select(*edges.columns)
    marked = edges.join(small(links.select(*key).distinct().withColumn("_gone", F.lit(True))), key, "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone") & (F.col("deleted_at") == 0), now).otherwise(F.col("deleted_at"))).select(*edges.columns)


def cascade(edges: DataFrame, gone: DataFrame, now: int) -> DataFrame:
    """``edges`` after the nodes ``gone`` (id) are deleted: their active edges, in and out, are closed at ``now``."""
    ids = small(gone.select(F.col("id")).distinct())
    marked = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    hit = (F.col("deleted_at") == 0) & (F.col("_s") | F.col("_t")).isNotNull() & F.coalesce(F.coalesce("_s", "_t"), F.lit(False))
    return marked.withColumn("deleted_at", F.when(hit, F.lit(now)).otherwise(F.col("deleted_at"))).select(*edges.columns)


def vacuum(edges: DataFrame, cutoff: int) -> DataFrame:
    """Without the versions that were closed by ``cutoff``."""
    return edges.filter((F.col("deleted_at") == 0) | (F.col("deleted_at") > cutoff))


def chain(edges: DataFrame, start: DataFrame, rel: str, most: int = 100) -> DataFrame:
    """(root, step, node): follows the first active ``rel`` edge (least created_at, target) from each start; stops at cycles."""
    first = edges.filter(active() & (F.col("rel") == rel)).groupBy(F.col("source").alias("node")).agg(F.min(F.struct("created_at", "target")).alias("m")).select("node", F.col("m.target").alias("next"))
    first = cut(first)
    now = cut(start.select(F.col("node").alias("root"), F.lit(0).alias("step"), "node", F.array("node").alias("path")))
    rows = now
    for step in range(1, most + 1):
        now = now.join(first, "node").filter(~F.array_contains("path", F.col("next")))
        now = cut(now.select("root", F.lit(step).alias("step"), F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        if not now.limit(1).count():
            break
        rows = rows.unionByName(now)
    return rows.select("root", "step", "node")


def connections(edges: DataFrame, nodes: DataFrame, source: str, rel: str) -> tuple[DataFrame, DataFrame]:
    """(linked nodes, dead links): targets that exist, hydrated, and the active edges whose target doesn't."""
    links = out_links(edges, source, rel)
    ids = nodes.withColumnRenamed("id", "target")
    return links.join(ids, "target").withColumnRenamed("target", "id"), links.join(ids.select("target"), "target", "left_anti")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Active edges with both ends among ``ids`` (id)."""
    for end in ("source", "target"):
        edges = edges.join(small(ids.select(F.col("id").alias(end)).distinct()), end, "left_semi")
    return edges.filter(active())
