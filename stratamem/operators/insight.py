"""What the background worker and the agent tools derive beyond single detectors; language models are a hook the caller passes."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.catalog import DAY
from stratamem.operators import filters, graph, memory, scoring, vectors

GENERAL_RELATIONS = ("related_to", "mentions", "mentioned_in", "parent", "child", "next", "prev", "has", "part_of", "contradicts", "supports", "superseded_by", "evolves_from")


def search_nodes(nodes: DataFrame, words: str, limit: int, id_col: str = "id", label=None) -> DataFrame:
    """(id, label) of the first ``limit`` matching nodes in id order, sorted by what they're listed by."""
    kept = filters.where(nodes, words).orderBy(id_col).limit(limit)
    return kept.select(id_col, (memory.label() if label is None else label).alias("label")).orderBy("label", id_col)


def explore(nodes: DataFrame, edges: DataFrame, limit: int, rels: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """(id, rel, neighbours): the first ``limit`` nodes with their active neighbours by relation; a node without any has a NULL rel."""
    first = nodes.orderBy(id_col).limit(limit).select(id_col)
    held = edges.filter(graph.active())
    held = held if rels is None else held.filter(F.col("rel").isin(*rels))
    near = held.groupBy(F.col("source").alias(id_col), "rel").agg(F.array_sort(F.collect_set("target")).alias("neighbours"))
    return first.join(near, id_col, "left")


def relation_probe(edges: DataFrame, node: str) -> list[str]:
    """The relations a node has, or the general ones if it has none."""
    touching = edges.filter(graph.active() & ((F.col("source") == node) | (F.col("target") == node)))
    return sorted(r.rel for r in touching.select("rel").distinct().collect()) or list(GENERAL_RELATIONS)


def invalidate(edges: DataFrame, targets: DataFrame, now: int, source: str = "system") -> DataFrame:
    """``edges`` with invalidates and invalidated_by links between ``source`` and each of ``targets`` (id)."""
    w, stamp = edges.schema["weight"].dataType, [F.lit(now).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("deleted_at")]
    there = targets.select(F.lit(source).alias("source"), F.col("id").alias("target"), F.lit("invalidates").alias("rel"), F.lit(1).cast(w).alias("weight"), *stamp)
    back = targets.select(F.col("id").alias("source"), F.lit(source).alias("target"), F.lit("invalidated_by").alias("rel"), F.lit(1).cast(w).alias("weight"), *stamp)
    return edges.unionByName(there).unionByName(back)


def provenance(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (chunk, doc, ...) with whether an active parent edge verifies that the chunk is the document's."""
    known = edges.filter(graph.active() & (F.col("rel") == "parent")).select(F.col("source").alias("chunk"), F.col("target").alias("doc"), F.lit(True).alias("verified")).distinct()
    return found.join(known, ["chunk", "doc"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def scoped_recall(nodes: DataFrame, edges: DataFrame, query: list[float], root: str, rels: Sequence[str], k: int, depth: int = 1, vector: str = "vector") -> DataFrame:
    """(id, seed, similarity): the k nearest nodes in the root's scope, filled up with their own neighbours by similarity (above 0)."""
    ids = graph.scope(edges, root, list(rels), "both", depth)
    seeds = vectors.knn(nodes.join(ids, "id", "left_semi"), query, k, "cosine", vector, "id").select("id")
    around = graph.reach(edges, seeds.select(F.col("id").alias("node")), list(rels), "both", 1)
    like = 1 - vectors.cosine_distance(F.col(vector), F.array(*map(F.lit, query)))
    rows = nodes.join(around.select(F.col("node").alias("id"), (F.col("depth") == 0).alias("seed")), "id").select("id", "seed", F.round(like, 6).alias("similarity"))
    return rows.filter(F.col("seed") | (F.col("similarity") > 0)).orderBy(F.desc("seed"), F.desc("similarity"), "id").limit(k)


def sources_by_document(found: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc, n, best, chunks): retrieved chunks (doc, chunk, score) of at least a score, grouped by document."""
    rows = found.filter(F.col("score") >= least)
    return rows.groupBy("doc").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.array_sort(F.collect_set("chunk")).alias("chunks"))


def evolution_candidates(edges: DataFrame, least: int = 15) -> DataFrame:
    """(node, in_degree): entities so often linked to that their history is worth a look."""
    return edges.filter(graph.active()).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree")).filter(F.col("in_degree") >= least)


def snapshots(edges: DataFrame, node: str, rels: Sequence[str], now: int, days: Sequence[int] = (30, 15, 1), depth: int = 2) -> DataFrame:
    """(days_ago, node, depth): a node's neighbourhood as it was at several times."""
    out = None
    root = edges.sparkSession.createDataFrame([(node,)], "node string")
    for d in days:
        rows = graph.reach(edges, root, list(rels), "both", depth, now - d * DAY * 10**9).withColumn("days_ago", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
    return out.select("days_ago", "node", "depth")


def fact_candidates(memories: DataFrame, edges: DataFrame, by: str = "user_id") -> DataFrame:
    """(user, n, ids): episodic memories of each user whose facts weren't extracted yet (no facts_extracted edge)."""
    done = edges.filter(graph.active() & (F.col("rel") == "facts_extracted")).select(F.col("source").alias("id"))
    rows = memories.filter(filters.in_layers(["episodic"]) & F.col(by).isNotNull()).join(done, "id", "left_anti")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def volatile_beliefs(reflections: DataFrame, edges: DataFrame, now: float, most: int = 3, least: float = 0.40) -> DataFrame:
    """The oldest unresolved reflections, at most ``most``, whose sources' belief is below ``least``.

    Reflections are rows (reflection, created, vec_id, embedding, created_at, access_count) of their sources.
    """
    conf = scoring.belief(reflections, edges, "reflection", now).filter(F.col("confidence") < least)
    age = reflections.groupBy("reflection").agg(F.min("created").alias("created"))
    return conf.join(age, "reflection").orderBy("created", "reflection").limit(most).select("reflection", "created", "confidence")


def memories_summary(memories: DataFrame, by: str, order: str = "created_at", length: int = 200) -> DataFrame:
    """(by, n, summary): every memory, newest first, as a bullet of at most ``length`` characters."""
    line = F.struct((-F.col(order)).alias("o"), F.concat(F.lit("- "), F.substring("content", 1, length)).alias("line"))
    rows = memories.filter(F.coalesce("content", F.lit("")) != "").groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select(by, "n", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("summary"))


def last_json_object(text: str) -> dict | None:
    """The last whole JSON object in a model's answer, whatever surrounds it."""
    decoder, found, at = json.JSONDecoder(), None, text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            found = value if isinstance(value, dict) else found
        at = text.find("{", end)
    return found


def think(index_sizes: dict[str, int], detectors: Sequence[tuple[str, Callable[[str], DataFrame]]], least: int = 3) -> dict[str, list[tuple[str, DataFrame]]]:
    """One cycle: for every index of at least ``least`` nodes, the findings of all detectors in order, not yet computed."""
    return {name: [(d, f(name)) for d, f in detectors] for name, n in index_sizes.items() if n >= least}


def compress_fields(df: DataFrame, language: str = "english", fields: Sequence[str] = ("content", "text", "summary", "description", "title", "label")) -> DataFrame:
    """``df`` with its usual text columns compressed; of struct columns their fields of those names too."""
    from pyspark.sql import types as T

    from stratamem.functions import text

    def shrink(column, kind, name):
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*(shrink(column[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
        return text.compress(column, language) if name in fields and isinstance(kind, T.StringType) else column

    return df.select(*(shrink(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def request_knowledge(artifacts: DataFrame, key: str, make: Callable[[], DataFrame] | None = None, search: Callable[[], DataFrame] | None = None) -> DataFrame | None:
    """The newest stored artifact of ``type:id``; else one made now; else what a search finds."""
    found = artifacts.filter(F.col("entity") == key)
    if found.limit(1).count():
        w = Window.partitionBy("artifact", "entity").orderBy(F.desc("version"))
        return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return make() if make else search() if search else None
