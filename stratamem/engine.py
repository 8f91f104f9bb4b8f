"""The engine's verbs on one catalog of frames: what an agent calls, each a thin layer over the operators.

A ``Memory`` holds the nodes and edges of one index as DataFrames. Reading verbs
return frames; writing verbs replace the frames the object holds, and ``save``
writes them. Nothing is collected but point lookups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.catalog import cut
from stratamem.functions.embed import Embedder, embed, hashing
from stratamem.operators import compiler, filters, graph, memory, scoring, search, vectors
from stratamem.sources import sinks

NODE = "id string, vector array<float>, content string, type string, name string, memory_layer string, created_at double, last_accessed double, access_count bigint, pinned boolean, archived boolean, is_historical boolean, deleted boolean"
EDGE = "source string, target string, rel string, weight double, created_at bigint, deleted_at bigint"


@dataclass
class Memory:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    config: scoring.Memory = field(default_factory=scoring.Memory)
    embedder: Embedder = field(default_factory=hashing)
    dimension: int = 64
    language: str | None = "english"

    @classmethod
    def create(cls, spark: SparkSession, **options) -> Memory:
        return cls(spark, spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Memory:
        t = sinks.load_snapshot(spark, path, ["nodes", "edges"])
        return cls(spark, t["nodes"], t["edges"], **options)

    def save(self, path: str) -> None:
        sinks.save_snapshot({"nodes": self.nodes, "edges": self.edges}, path)

    def live(self) -> DataFrame:
        return self.nodes.filter(~F.coalesce("deleted", F.lit(False)))

    # writing

    def add(self, rows: DataFrame, now: float) -> None:
        """Adds nodes (id, content, and any other columns); those without a vector are embedded from their content."""
        kinds = {f.name: f.dataType for f in self.nodes.schema.fields}
        full = rows.select(*(F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
        full = full.withColumn("vector", F.coalesce("vector", F.when(F.coalesce("content", F.lit("")) != "", embed(self.embedder)("content"))))
        self.nodes = cut(memory.add(self.nodes, full, now, self.dimension))

    def link(self, links: DataFrame, now: int) -> None:
        """Adds edges (source, target, rel, weight); a weight that changed closes the version before."""
        old = self.edges.filter(graph.active()).select("source", "target", "rel", "weight", F.col("created_at").alias("at"), F.lit(0).alias("seq"))
        new = links.select("source", "target", "rel", F.col("weight").cast("double"), F.lit(now).cast("bigint").alias("at"), F.lit(1).alias("seq"))
        merged = graph.merge_versions(old.unionByName(new)).select(*self.edges.columns)
        self.edges = cut(self.edges.filter(~graph.active()).unionByName(merged))

    def unlink(self, links: DataFrame, now: int, hard: bool = False) -> None:
        self.edges = cut(graph.unlink(self.edges, links, now, hard))

    def delete(self, ids: DataFrame, now: int) -> None:
        nodes, edges = memory.delete(self.nodes, self.edges, ids, now)
        self.nodes, self.edges = cut(nodes), cut(edges)

    def evolve(self, changes: DataFrame, now: int) -> None:
        """New versions of nodes (id, content, reason)."""
        nodes, edges = memory.evolve(self.nodes, self.edges, changes, now)
        self.nodes, self.edges = cut(nodes), cut(edges)

    def reinforce(self, ids: DataFrame, now: float) -> None:
        self.nodes = cut(memory.reinforce(self.nodes, ids, now))

    def vacuum(self, cutoff: int) -> None:
        self.edges = cut(graph.vacuum(self.edges, cutoff))

    # reading

    def get(self, ids: Sequence[str]) -> DataFrame:
        return memory.many(self.live(), ids)

    def filter(self, words: str, limit: int = 10) -> DataFrame:
        return filters.select_ids(self.live(), words, limit)

    def recall(self, words: str, k: int, now: float, where: str | None = None, root: str | None = None, rels: Sequence[str] = (), depth: int = 1, alpha: float = 0.5, historical: bool = False) -> DataFrame:
        """(id, content, score): the hybrid search within the filter and the graph scope, decayed by age."""
        rows = self.live() if historical else self.live().filter(filters.live_memory())
        parsed = filters.parse(where) if where else None
        if parsed:
            rows = rows.filter(filters.predicate(parsed, filters.fields_of(rows)))
        if root:
            rows = rows.join(graph.scope(self.edges, root, list(rels), "both", depth), "id", "left_semi")
        asked = parsed.contains[1] if parsed and parsed.contains else words
        q = [float(x) for x in self.embedder([words])[0]]
        found = search.hybrid(rows, q, asked, k, alpha, column="content", language=self.language)
        scored = found.join(rows, "id").withColumn("score", F.round(F.col("score") * scoring.memory_decay(self.config, now), 6))
        return scored.select("id", "content", "score").orderBy(F.desc("score"), "id")

    def neighbours(self, root: str, rels: Sequence[str], depth: int = 1, at: int | None = None) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.edges, root, list(rels), depth, at)

    def path(self, source: str, target: str, rels: Sequence[str], max_depth: int = 4) -> DataFrame:
        return graph.find_path(self.edges, source, target, list(rels), max_depth)

    def history(self, node: str, forward: bool = True) -> DataFrame:
        start = self.spark.createDataFrame([(node,)], "node string")
        return graph.chain(self.edges, start, "superseded_by" if forward else "evolves_from")

    def belief(self, words: str, now: float, k: int = 10) -> DataFrame:
        """One row: how far the memories nearest to a text (50 at most) agree, last and are challenged."""
        q = [float(x) for x in self.embedder([words])[0]]
        near = vectors.knn(self.live().filter(filters.live_memory()), q, min(k, 50), "cosine", "vector", "id").withColumn("belief", F.lit(words))
        return scoring.belief(near, self.edges, "belief", now, "vector", "id", self.config.model)

    def compile(self, template: str, now: float, intent: str = "") -> DataFrame:
        """The artifact fields of every node from what it's linked to."""
        links = self.edges.filter(graph.active()).select(F.col("source").alias("entity"), F.col("target").alias("id"))
        return compiler.compile_fields(links.join(self.live(), "id"), template, now, intent)

    def stats(self) -> DataFrame:
        return memory.system_stats(self.nodes, self.edges)
