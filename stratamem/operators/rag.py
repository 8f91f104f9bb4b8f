"""Retrieval for generation: chunk chains, ranked sources, expansion over the graph, context under a token budget, and gateway checks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.catalog import arrow_safe, cut, small
from stratamem.functions import text
from stratamem.operators import vectors

RELATION_WEIGHTS = {"next": 0.95, "prev": 0.95, "parent": 0.8, "child": 0.7, "mentions": 0.5, "mentioned_in": 0.4}


def chunks(docs: DataFrame, split: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc, chunk_index, chunk_id, content): the pieces that ``split`` (an array column expression) makes of each document."""
    flat = docs.select(F.col(id_col).alias("doc"), F.posexplode(split).alias("chunk_index", "content"))
    return flat.withColumn("chunk_id", F.concat(F.col("doc").cast("string"), F.lit("_"), F.col("chunk_index").cast("string"))).select("doc", "chunk_index", "chunk_id", "content")


def recursive(docs: DataFrame, size: int, overlap: int = 0, kind: str | list[str] = "recursive", id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """``chunks`` by ``text.split_recursively``, in batches bounded in bytes and a few texts at a time, so that a worker's memory doesn't depend on the table."""
    arrow_safe(docs.sparkSession)
    separators = text.SEPARATORS[kind] if isinstance(kind, str) else [*kind, ""]
    overlap = overlap if 0 <= overlap < size else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                made = [None if t is None else text.split_recursively(t, size, overlap, separators) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(made, pa.list_(pa.string()))], names=["doc", "c"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("doc"), F.col(column).alias("t"))
    split = rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("c", T.ArrayType(T.StringType()))]))
    return chunks(split, F.col("c"), "doc")


def chunk_edges(pieces: DataFrame) -> DataFrame:
    """(source, target, rel): next and prev between neighbouring chunks, parent and child with their document.

    A chunk's neighbours follow from its index and its document's number of
    chunks, so the only shuffle counts chunks.
    """
    sized = pieces.select("doc", "chunk_index", "chunk_id").join(pieces.groupBy("doc").agg(F.max("chunk_index").alias("last")), "doc")
    at = lambda i: F.concat(F.col("doc").cast("string"), F.lit("_"), i.cast("string"))
    root = F.concat(F.lit("doc:"), F.col("doc").cast("string"))
    edge = lambda a, b, rel: F.struct(a.alias("source"), b.alias("target"), F.lit(rel).alias("rel"))
    me, i = F.col("chunk_id"), F.col("chunk_index")
    made = F.array_compact(F.array(F.when(i < F.col("last"), edge(me, at(i + 1), "next")), F.when(i > 0, edge(me, at(i - 1), "prev")), edge(me, root, "parent"), edge(root, me, "child")))
    return sized.select(F.explode(made).alias("e")).select("e.*")


def entity_mentions(pieces: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, rel): mentions edges from chunks to the entities (name) whose first word and whole name they hold."""
    wanted = names.select("name", text.slug("name").alias("entity"), F.get(text.tokens("name"), F.lit(0)).alias("token"))
    words = pieces.select("chunk_id", "content", F.explode(F.array_distinct(text.tokens("content"))).alias("token"))
    hit = words.join(small(wanted), "token").filter(F.lower("content").contains(F.lower("name")))
    return hit.select(F.col("chunk_id").alias("source"), F.col("entity").alias("target"), F.lit("mentions").alias("rel")).distinct()


def ranked_sources(found: DataFrame, order: Sequence[Column], by: str | None = None) -> DataFrame:
    """Results with their rank from 0 and the score max(0.1, 1 - 0.1 rank)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(w) - 1)
    return ranked.withColumn("score", F.round(F.greatest(F.lit(0.1), 1 - 0.1 * F.col("rank")), 6))


def expand(seeds: DataFrame, edges: DataFrame, weights: Mapping[str, float] = RELATION_WEIGHTS, default: float = 0.3, depth: int = 2, most: int = 200) -> DataFrame:
    """(seed group, node, depth, score): a node's score is its predecessor's times the relation's weight.

    ``seeds`` is (root, node): every root's expansion is its own. A node is
    reached at its least depth, by its best score there; of each root's nodes
    the ``most`` first by (depth, score, id) count.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    steps = edges.filter(F.col("deleted_at") == 0).select(F.col("source").alias("node"), F.col("target").alias("next"), F.coalesce(table[F.col("rel")], F.lit(default)).alias("w"))
    seen = front = cut(seeds.select("root", "node").distinct().select("root", "node", F.lit(0).alias("depth"), F.lit(1.0).alias("score")))
    for d in range(1, depth + 1):
        new = steps.join(small(front), "node").groupBy("root", F.col("next").alias("node")).agg(F.max(F.col("score") * F.col("w")).alias("score"))
        front = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"), "score"))
        seen = seen.unionByName(front)
    w = Window.partitionBy("root").orderBy("depth", F.desc("score"), "node")
    return seen.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n").withColumn("score", F.round("score", 6))


def final_score(derived: Column, depth: Column, density: Column) -> Column:
    """0.6 x derived + 0.2 x max(0.3, 1 - 0.15 depth) + 0.2 x density scaled from 0.3..0.9 to 0..1."""
    return 0.6 * derived + 0.2 * F.greatest(F.lit(0.3), 1 - 0.15 * depth) + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (density - 0.3) / 0.6))


def context(candidates: DataFrame, budget: int = 4096, by: str = "query_id") -> DataFrame:
    """(by, position, doc, chunk_index, tokens): which chunks a prompt takes, in order.

    Candidates are (by, doc, chunk_index, score, tokens). Documents go by their
    best score (ties by id), chunks by index; a chunk that would exceed the
    budget ends its document. A query's candidates are few, so each is packed
    by one group of a pandas function.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        best = rows.groupby("doc")["score"].max()
        for doc in sorted(best.index, key=lambda d: (-best[d], d)):
            for r in rows[rows["doc"] == doc].sort_values("chunk_index").itertuples():
                if used + r.tokens > budget:
                    break
                used += r.tokens
                out.append((rows[by].iloc[0], len(out), doc, r.chunk_index, r.tokens))
        return pd.DataFrame(out, columns=[by, "position", "doc", "chunk_index", "tokens"])

    return candidates.groupBy(by).applyInPandas(pack, f"{by} {kinds[by]}, position int, doc {kinds['doc']}, chunk_index int, tokens int")


DENY = (r"ignore (all )?previous instructions", r"system prompt", r"(drop|delete) (table|database)", r"jailbreak")


def blocked(column: str = "text", patterns: Sequence[str] = DENY) -> Column:
    """Whether any pattern matches, whatever the case."""
    return F.coalesce(F.col(column).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def semantic_block(queries: DataFrame, forbidden: DataFrame, threshold: float = 0.25, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, neighbor_id, distance): queries whose nearest forbidden vector is nearer than ``threshold``."""
    return vectors.knn_batch(queries, forbidden, 1, "cosine", vector, id_col).filter(F.col("distance") < threshold).select("query_id", "neighbor_id", "distance")


def cache_lookup(queries: DataFrame, cache: DataFrame, now: float, threshold: float = 0.1, ttl: float = 86_400.0, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, neighbor_id, distance): the nearest cached entry (with ``created_at``) not past its time to live, if it's near enough."""
    live = cache.filter(F.col("created_at") > now - ttl)
    return semantic_block(queries, live, threshold, vector, id_col)


def cache_invalidate(cache: DataFrame, doc: str) -> DataFrame:
    """Without the entries made from the document ``doc`` (column sources)."""
    return cache.filter(~F.coalesce(F.array_contains("sources", doc), F.lit(False)))


def injection(hits: DataFrame, pieces: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(query_id, doc, content): each good hit with the chunks before and after it, once per text.

    Hits are (query_id, doc, chunk_index, score).
    """
    good = hits.filter(F.col("score") >= threshold).withColumn("i", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)))
    around = good.join(pieces.select("doc", F.col("chunk_index").alias("i"), "content"), ["doc", "i"])
    joined = around.groupBy("query_id", "doc", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return joined.groupBy("query_id", "doc", "content").agg(F.min("chunk_index").alias("chunk_index")).select("query_id", "doc", "chunk_index", "content")
