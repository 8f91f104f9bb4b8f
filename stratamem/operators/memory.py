"""Writing: nodes, metadata, versions, auto-links, transfer, and the state of a change log. All return new frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.catalog import small
from stratamem.operators import graph, vectors


def page(nodes: DataFrame, cursor, limit: int, id_col: str = "internal_id") -> DataFrame:
    """The next ``limit`` rows from ``cursor`` on in id order; keyset paging, so every page costs the same."""
    return nodes.filter(F.col(id_col) >= cursor).orderBy(id_col).limit(limit)


def offset_page(nodes: DataFrame, offset: int, limit: int, id_col: str = "internal_id") -> DataFrame:
    """Rows by offset, with the true total and whether there's more."""
    total = nodes.count()
    rows = nodes.orderBy(id_col).offset(offset).limit(limit)
    return rows.withColumn("total_count", F.lit(total)).withColumn("has_more", F.lit(offset + limit < total))


def many(nodes: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    """The nodes of ``ids``, in that order (column ord); unknown ones are left out."""
    kind = nodes.schema[id_col].dataType.simpleString()
    wanted = nodes.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} {kind}, ord int")
    return nodes.join(small(wanted), id_col)


def index_info(nodes: DataFrame, config: DataFrame) -> DataFrame:
    """(index_name, live, deleted_ratio, config...): every index of ``config`` with its live rows."""
    counts = nodes.groupBy("index_name").agg(F.sum(F.when(F.col("deleted"), 0).otherwise(1)).alias("live"), F.avg(F.col("deleted").cast("int")).alias("deleted_ratio"))
    return config.join(counts, "index_name", "left").withColumns({"live": F.coalesce("live", F.lit(0)), "deleted_ratio": F.coalesce("deleted_ratio", F.lit(0.0))})


def add(existing: DataFrame, new: DataFrame, now: float, dimension: int | None = None, pinned_layers: tuple[str, ...] = ("procedural",), upsert: bool = False) -> DataFrame:
    """``existing`` and ``new`` nodes (id, vector, memory_layer, created_at, pinned, ...), with defaults filled in.

    An id that exists, or occurs twice in ``new``, is an error unless
    ``upsert``, when the new row replaces it. A missing vector becomes zeros of
    the dimension; another dimension is an error.
    """
    layer = F.coalesce("memory_layer", F.lit("episodic"))
    rows = new.withColumns({"memory_layer": layer, "created_at": F.coalesce("created_at", F.lit(float(now))), "pinned": F.coalesce("pinned", layer.isin(*pinned_layers))})
    if dimension is None:
        first = existing.filter("size(vector) > 0").select(F.size("vector")).first() or rows.filter("size(vector) > 0").select(F.size("vector")).first()
        dimension = first and first[0]
    if dimension is None:
        raise ValueError("the index has no dimension yet")
    wrong = rows.filter((F.size("vector") > 0) & (F.size("vector") != dimension)).limit(1).count()
    if wrong:
        raise ValueError(f"a vector hasn't {dimension} components")
    rows = rows.withColumn("vector", F.when(F.coalesce(F.size("vector"), F.lit(0)) > 0, F.col("vector")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dimension)))
    clash = existing.join(rows.select("id"), "id", "left_semi")
    if upsert:
        return existing.join(rows.select("id"), "id", "left_anti").select(*existing.columns).unionByName(rows, allowMissingColumns=True)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count() or clash.limit(1).count():
        raise ValueError("an id exists already")
    return existing.unionByName(rows, allowMissingColumns=True)


def delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Tombstones the nodes ``gone`` (id) and closes their edges."""
    marked = nodes.join(small(gone.select("id").distinct().withColumn("_gone", F.lit(True))), "id", "left")
    return marked.withColumn("deleted", F.coalesce("_gone", "deleted")).select(*nodes.columns), graph.cascade(edges, gone, now)


def set_metadata(nodes: DataFrame, changes: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Shallow merge: keys of ``changes`` (id, metadata map) replace those of the node's map, others stay."""
    both = nodes.join(changes.select("id", F.col(metadata).alias("_new")), "id", "left")
    old = F.map_filter(metadata, lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    merged = F.when(F.col("_new").isNull(), F.col(metadata)).when(F.col(metadata).isNull(), F.col("_new")).otherwise(F.map_concat(old, F.col("_new")))
    return both.withColumn(metadata, merged).select(*nodes.columns)


def reinforce(nodes: DataFrame, ids: DataFrame, now: float, id_col: str = "id") -> DataFrame:
    """Counts an access of each of ``ids`` and sets its time; an id given several times counts once per time."""
    hits = ids.groupBy(id_col).agg(F.count("*").alias("_n"))
    both = nodes.join(small(hits), id_col, "left")
    return both.withColumns({
        "last_accessed": F.when(F.col("_n").isNotNull(), F.lit(float(now))).otherwise(F.col("last_accessed")),
        "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
    }).select(*nodes.columns)


def evolve(nodes: DataFrame, edges: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New versions of nodes: ``changes`` is (id, content, reason).

    The new node is a copy of the old with the given content and the id
    evolved_<old>_<now>; incoming edges are copied with weight 0; superseded_by
    and evolves_from join the two; the old one is historical.
    """
    fresh = F.concat(F.lit("evolved_"), F.col("id").cast("string"), F.lit(f"_{now}"))
    change = changes.select("id", F.col("content").alias("_content"), "reason")
    both = nodes.join(small(change), "id", "left")
    old = both.withColumn("is_historical", F.coalesce(F.col("is_historical"), F.lit(False)) | F.col("reason").isNotNull() | F.col("_content").isNotNull()).select(*nodes.columns)
    new = both.filter(F.col("_content").isNotNull() | F.col("reason").isNotNull()).withColumns({"content": F.coalesce("_content", "content"), "is_historical": F.lit(False), "id": fresh}).select(*nodes.columns)
    ids = change.select("id", fresh.alias("_new"))
    kind = edges.schema["weight"].dataType
    stamp = [F.lit(now).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("deleted_at")]
    copied = edges.filter(graph.active()).join(small(ids.withColumnRenamed("id", "target")), "target").select("source", F.col("_new").alias("target"), "rel", F.lit(0).cast(kind).alias("weight"), *stamp)
    pair = lambda a, b, rel: ids.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(rel).alias("rel"), F.lit(1).cast(kind).alias("weight"), *stamp)
    return old.unionByName(new), edges.unionByName(copied).unionByName(pair("id", "_new", "superseded_by")).unionByName(pair("_new", "id", "evolves_from"))


@dataclass(frozen=True)
class AutoLink:
    """Nodes with a value in ``field`` get an edge ``rel`` to it."""

    field: str
    rel: str
    prefix: str = ""


def auto_links(nodes: DataFrame, rules: Sequence[AutoLink], id_col: str = "id") -> DataFrame:
    """(source, target, rel, weight): the edges of all rules, one scan; array fields link to each element."""
    link = lambda r: lambda v: F.struct(F.lit(r.rel).alias("rel"), F.concat(F.lit(r.prefix), v).alias("target"))
    made = []
    for r in rules:
        array = nodes.schema[r.field].dataType.typeName() == "array"
        values = F.col(r.field).cast("array<string>") if array else F.array(F.col(r.field).cast("string"))
        made.append(F.transform(values, link(r)))
    flat = nodes.select(F.col(id_col).cast("string").alias("source"), F.explode(F.flatten(F.array_compact(F.array(*made)))).alias("e"))
    return flat.select("source", "e.target", "e.rel", F.lit(1.0).alias("weight")).filter(F.col("target").isNotNull())


def transfer(source: DataFrame, target: DataFrame, query: list[float], limit: int = 50, agent: str = "source", now: float = 0.0, metric: str = "cosine") -> DataFrame:
    """``target`` (id, vector, ...) after the ``limit`` (500 at most) nearest nodes of ``source`` are copied into it with their provenance.

    Nodes that exist keep their own columns where they have a value.
    """
    found = vectors.knn(source, query, min(limit, 500), metric, "vector", "id").select(*source.columns)
    came = found.withColumns({"transferred_from": F.lit(agent), "transferred_at": F.lit(float(now))})
    mine = target.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("transferred_from", "string"), ("transferred_at", "double")) if c not in target.columns))
    a, b = mine.alias("a"), came.alias("b")
    columns = [F.coalesce("a.id", "b.id").alias("id")] + [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in came.columns else F.col(f"a.{c}") for c in mine.columns if c not in ("id", "transferred_from", "transferred_at")]
    # who it came from is news about the copy, so here the newcomer counts
    columns += [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("transferred_from", "transferred_at")]
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(*columns)


def replay(log: DataFrame, key: Sequence[str] = ("key",), seq: str = "seq", op: str = "op", deletes: Sequence[str] = ("DEL",)) -> DataFrame:
    """The state that a change log leaves: the last row of each key, unless it's a deletion. One shuffle with map-side combining."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return last.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest)).filter(~F.col(op).isin(*deletes))


def prefix_scan(kv: DataFrame, prefix: str, limit: int | None = None, key: str = "key") -> DataFrame:
    rows = kv.filter(F.col(key).startswith(prefix))
    return rows if limit is None else rows.orderBy(key).limit(limit)


def label(name: str = "name", title: str = "title", content: str = "content", source: str = "source", id_col: str = "id"):
    """What a node is listed by: its name, title, first line of content (40 bytes' worth of characters), file name or id."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    line = F.substring(F.substring_index(F.trim(F.col(content)), "\n", 1), 1, 40)
    return F.coalesce(some(F.col(name)), some(F.col(title)), some(line), some(F.substring_index(F.col(source), "/", -1)), F.col(id_col).cast("string"))


def system_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: live nodes, pinned ones, active edges and the distinct nodes they join."""
    live = nodes.filter(~F.coalesce("deleted", F.lit(False))).agg(F.count("*").alias("nodes"), F.sum(F.coalesce(F.col("pinned").cast("int"), F.lit(0))).alias("pinned"))
    held = edges.filter(graph.active())
    joined = held.select(F.explode(F.array("source", "target")).alias("n")).agg(F.count_distinct("n").alias("linked_nodes"))
    return live.crossJoin(held.agg(F.count("*").alias("edges"))).crossJoin(joined)


def versions(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with version numbers from 1 per key and whether each is historical."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("is_historical", F.lead(F.lit(1)).over(w).isNotNull())
