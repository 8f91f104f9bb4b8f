"""Knowledge compiler: artifacts are versioned, materialised answers with provenance, confidence and staleness.

Sources are nodes (id, entity, type, content, name, pinned, created_at, ...);
an artifact row is (artifact, entity, version, data map, created_at, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_HOURS = 168.0


def relevance(keywords: Sequence[str], types: Sequence[str], now: float) -> Column:
    """+0.3 for a wanted type (0.15 if none is asked for), +0.4 x share of keywords in the content, +0.3 x e^(-hours / 168), +0.2 pinned; 1 at most."""
    kind = F.when(F.col("type").isin(*types), 0.3).otherwise(0.0) if types else F.lit(0.15)
    low = F.lower(F.coalesce("content", F.lit("")))
    hits = F.lit(0)
    for w in keywords:
        hits = hits + F.when(low.contains(w.lower()), 1).otherwise(0)
    words = 0.4 * hits / len(keywords) if keywords else F.lit(0.0)
    recent = 0.3 * F.exp(-(F.lit(float(now)) - F.col("created_at")) / 3600 / WEEK_HOURS)
    pin = F.when(F.coalesce(F.col("pinned"), F.lit(False)), 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), kind + words + recent + pin), 6)


def relevant(sources: DataFrame, keywords: Sequence[str], types: Sequence[str], now: float, least: float = 0.1, most: int = 50, by: str | None = None) -> DataFrame:
    """Sources with their relevance, the best ``most`` (of each ``by``), ranked; ties by id."""
    rows = sources.withColumn("relevance", relevance(keywords, types, now)).filter(F.col("relevance") >= least)
    if by is None:
        return rows.orderBy(F.desc("relevance"), "id").limit(most)
    w = Window.partitionBy(by).orderBy(F.desc("relevance"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def keywords(intent: str) -> list[str]:
    """Words of an intent without the common ones."""
    common = set("the a an of for in on to and or is are what how with about".split())
    return [w for w in intent.lower().split() if w not in common]


# fields; each gives (by, field, value, confidence, sources)


def _field(rows: DataFrame, by: str, name: str, value: Column, confidence: float, ids: Column) -> DataFrame:
    return rows.groupBy(by).agg(value.cast("string").alias("value"), ids.alias("source_ids")).filter(F.col("value").isNotNull()).select(by, F.lit(name).alias("field"), "value", F.lit(confidence).alias("confidence"), "source_ids")


def metadata_field(ranked: DataFrame, by: str, name: str, column: str) -> DataFrame:
    """The first non-missing value by relevance."""
    some = ranked.filter(F.col(column).isNotNull())
    return _field(some, by, name, F.min_by(column, "rank"), 0.95, F.array(F.min_by(F.col("id").cast("string"), F.col("rank"))))


def computed_field(ranked: DataFrame, by: str, name: str, kind: str, column: str | None = None) -> DataFrame:
    """count, sum, max, or minutes between the first and last of ``column``."""
    value = {"count": lambda: F.count("*"), "sum": lambda: F.sum(column), "max": lambda: F.max(column), "minutes": lambda: F.round((F.max(column) - F.min(column)) / 60, 6)}[kind]()
    return _field(ranked, by, name, value, 0.95, F.array_sort(F.collect_set(F.col("id").cast("string"))))


def core_facts(ranked: DataFrame, by: str) -> DataFrame:
    pinned = ranked.filter(F.coalesce(F.col("pinned"), F.lit(False)))
    return _field(pinned, by, "core_facts", F.to_json(F.array_sort(F.collect_set("content"))), 0.9, F.array_sort(F.collect_set(F.col("id").cast("string"))))


def relation_types(edges: DataFrame, by: str = "source") -> DataFrame:
    """(entity, relations, types): how many active edges a node has and their sorted relations."""
    held = edges.filter(F.col("deleted_at") == 0)
    return held.groupBy(F.col(by).alias("entity")).agg(F.count("*").alias("relations"), F.array_sort(F.collect_set("rel")).alias("types"))


def top_entities(edges: DataFrame, of: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(entity, relations): the ``k`` nodes with most active edges, ties by id."""
    held = edges.filter(F.col("deleted_at") == 0).select(F.explode(F.array("source", "target")).alias("entity"))
    held = held if of is None else held.join(of.select(F.col("id").alias("entity")), "entity", "left_semi")
    return held.groupBy("entity").agg(F.count("*").alias("relations")).orderBy(F.desc("relations"), "entity").limit(k)


def sentiment_vote(scored: DataFrame, by: str, score: str = "sentiment") -> DataFrame:
    """positive or negative if one side has more than twice the other's votes, else mixed; neutral without votes."""
    rows = scored.groupBy(by).agg(F.sum(F.when(F.col(score) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(score) < 0, 1).otherwise(0)).alias("neg"))
    vote = F.when((F.col("pos") == 0) & (F.col("neg") == 0), "neutral").when(F.col("pos") > 2 * F.col("neg"), "positive").when(F.col("neg") > 2 * F.col("pos"), "negative").otherwise("mixed")
    return rows.select(by, "pos", "neg", vote.alias("sentiment"))


@dataclass(frozen=True)
class Field:
    """A template's field; source is metadata, computed, graph or text."""

    name: str
    source: str
    column: str | None = None
    kind: str = "count"


TEMPLATES: dict[str, tuple[Field, ...]] = {
    "entity_card": (Field("name", "metadata", "name"), Field("type", "metadata", "type"), Field("last_updated", "computed", "created_at", "max"), Field("connection_count", "computed")),
    "user_profile": (Field("name", "metadata", "name"), Field("interaction_count", "computed"), Field("last_interaction", "computed", "created_at", "max"), Field("core_facts", "graph")),
    "project_summary": (Field("node_count", "computed"), Field("last_activity", "computed", "created_at", "max"), Field("summary", "text")),
    "conversation_context": (Field("participants", "metadata", "name"), Field("duration_minutes", "computed", "created_at", "minutes"), Field("memory_count", "computed")),
    "topic_overview": (Field("node_count", "computed"), Field("core_facts", "graph"), Field("summary", "text")),
}


def snippets(ranked: DataFrame, by: str, most: int = 5, length: int = 200) -> DataFrame:
    """The best sources' beginnings as a stand-in for written text, at low confidence."""
    some = ranked.filter((F.col("rank") <= most) & F.col("content").isNotNull())
    lines = F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, length).alias("line"))))
    return _field(some, by, "summary", F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 0.4, F.array_sort(F.collect_set(F.col("id").cast("string"))))


def compile_fields(sources: DataFrame, template: str, now: float, intent: str = "", types: Sequence[str] = (), by: str = "entity", least_confidence: float = 0.0) -> DataFrame:
    """(by, field, value, confidence, source_ids) of every entity's artifact."""
    ranked = relevant(sources, keywords(intent), types, now, by=by)
    made = None
    for f in TEMPLATES[template]:
        if f.source == "metadata":
            rows = metadata_field(ranked, by, f.name, f.column)
        elif f.source == "computed":
            rows = computed_field(ranked, by, f.name, f.kind, f.column)
        elif f.source == "graph":
            rows = core_facts(ranked, by)
        else:
            rows = snippets(ranked, by)
        made = rows if made is None else made.unionByName(rows)
    return made.filter(F.col("confidence") >= least_confidence)


def artifact(fields: DataFrame, name: str, now: float, by: str = "entity") -> DataFrame:
    """(artifact, entity, version, data, confidence, source_ids, created_at) from compiled fields."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))
    return fields.groupBy(F.col(by).alias("entity")).agg(entries.alias("data"), F.avg("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids")).select(
        F.lit(name).alias("artifact"), "entity", F.lit(1).alias("version"), "data", "confidence", "source_ids", F.lit(float(now)).alias("created_at")
    )


def store(history: DataFrame, new: DataFrame, keep_history: bool = True) -> DataFrame:
    """``history`` with ``new`` as each artifact's next version; without history only the newest stays."""
    latest = history.groupBy("artifact", "entity").agg(F.max("version").alias("_v"))
    numbered = new.join(latest, ["artifact", "entity"], "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast(new.schema["version"].dataType)).select(*new.columns)
    old = history if keep_history else history.join(new.select("artifact", "entity"), ["artifact", "entity"], "left_anti").select(*history.columns)
    return old.unionByName(numbered)


def prune(history: DataFrame, now: float, most: int = 20, oldest: float = 90 * 86_400.0, key: Sequence[str] = ("artifact", "entity")) -> DataFrame:
    """The newest ``most`` versions of each artifact that aren't older than ``oldest``; the newest always stays."""
    w = Window.partitionBy(*key).orderBy(F.desc("version"))
    rows = history.withColumn("_n", F.row_number().over(w))
    return rows.filter((F.col("_n") == 1) | ((F.col("_n") <= most) & (F.col("created_at") >= now - oldest))).drop("_n")


def as_of(history: DataFrame, at: float, key: Sequence[str] = ("artifact", "entity")) -> DataFrame:
    """Each artifact's latest version that was created by ``at``."""
    rest = [c for c in history.columns if c not in key]
    last = history.filter(F.col("created_at") <= at).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("created_at", "version")).alias("_r"))
    return last.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def diff(history: DataFrame, one: int, two: int, key: Sequence[str] = ("artifact", "entity")) -> DataFrame:
    """(key..., field, change, before, after): fields added, removed or modified between two versions."""
    flat = lambda v, name: history.filter(F.col("version") == v).select(*key, F.explode("data").alias("field", name))
    both = flat(one, "before").join(flat(two, "after"), [*key, "field"], "full_outer")
    change = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "added").when(F.col("after").isNull() & F.col("before").isNotNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(*key, "field", "change", "before", "after")


def staleness(artifacts: DataFrame, events: DataFrame, now: float) -> DataFrame:
    """(artifact, entity, events, staleness, stale): 0.3 for each event (node, at) on a source since the version was made, 0.05 an hour.

    ``threshold`` of an artifact (a column, 1 if missing) decides whether it's stale.
    """
    src = artifacts.select("artifact", "entity", "created_at", F.explode("source_ids").alias("node"))
    hits = src.join(events, "node").filter(F.col("at") > F.col("created_at")).groupBy("artifact", "entity").agg(F.count("*").alias("events"))
    limit = F.coalesce(F.col("threshold"), F.lit(1.0)) if "threshold" in artifacts.columns else F.lit(1.0)
    rows = artifacts.join(hits, ["artifact", "entity"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    score = F.round(0.3 * F.col("events") + 0.05 * (F.lit(float(now)) - F.col("created_at")) / 3600, 6)
    return rows.select("artifact", "entity", "events", score.alias("staleness"), (score >= limit).alias("stale"))


def valid_provenance(artifacts: DataFrame, nodes: DataFrame, fallback: float = 0.3) -> DataFrame:
    """Unknown sources are dropped; an artifact that keeps none falls to the confidence ``fallback``."""
    ids = nodes.select(F.col("id").alias("node"))
    known = artifacts.select("artifact", "entity", F.explode("source_ids").alias("node")).join(ids, "node", "left_semi").groupBy("artifact", "entity").agg(F.array_sort(F.collect_set("node")).alias("_known"))
    rows = artifacts.join(known, ["artifact", "entity"], "left")
    return rows.withColumns({"source_ids": F.coalesce("_known", F.array().cast("array<string>")), "confidence": F.when(F.col("_known").isNull(), fallback).otherwise(F.col("confidence"))}).select(*artifacts.columns)


CASTS = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}


def validated(fields: DataFrame, schema: dict[str, str | Sequence[str]]) -> DataFrame:
    """Adds valid: whether each field's value is of its declared type (string, number, boolean, array, object) or among an enumeration."""
    ok = F.lit(True)
    for name, kind in schema.items():
        value = F.col("value")
        if not isinstance(kind, str):
            good = value.isin(*kind)
        elif kind in ("array", "object"):
            good = F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith(kind.upper()), F.lit(False))
        else:
            good = F.expr(f"try_cast(value AS {CASTS[kind]})").isNotNull()
        ok = F.when(F.col("field") == name, good).otherwise(ok)
    return fields.withColumn("valid", ok)
