"""Time decay and belief scores. Times are seconds; ``now`` is always a parameter."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.catalog import cut, small
from stratamem.operators import vectors

MONTH = 30 * 86_400.0


def exponential(age: Column, half_life: Column | float) -> Column:
    return F.pow(F.lit(2.0), -age / half_life)


def linear(age: Column, half_life: Column | float) -> Column:
    return F.greatest(F.lit(0.0), 1 - age / half_life)


def step(age: Column, half_life: Column | float) -> Column:
    return F.when(age < half_life, 1.0).otherwise(0.0)


def ebbinghaus(age: Column, half_life: Column | float, accesses: Column | int = 0) -> Column:
    """Forgetting that slows with the number of accesses."""
    n = accesses if isinstance(accesses, Column) else F.lit(accesses)
    return F.exp(-age / (half_life * (1 + F.log1p(n))))


def decay(age: Column, half_life: Column | float, accesses: Column | int = 0, model: Column | str = "exponential") -> Column:
    """The factor of a model by name; an unknown one is exponential, and without age or half-life nothing decays."""
    m = F.lit(model) if isinstance(model, str) else F.coalesce(model, F.lit("exponential"))
    h = F.lit(float(half_life)) if not isinstance(half_life, Column) else half_life
    chosen = F.when(m == "linear", linear(age, h)).when(m == "step", step(age, h)).when(m == "ebbinghaus", ebbinghaus(age, h, accesses)).otherwise(exponential(age, h))
    return F.when(F.coalesce(age, F.lit(0.0)) <= 0, 1.0).when(F.coalesce(h, F.lit(0.0)) <= 0, 1.0).otherwise(chosen)


@dataclass(frozen=True)
class Memory:
    """How an index remembers: half-life and model, by layer where given (a half-life of 0 keeps for ever)."""

    half_life: float = MONTH
    model: str = "exponential"
    layers: Mapping[str, float] = field(default_factory=lambda: {"episodic": 72 * 3600.0, "semantic": 720 * 3600.0, "procedural": 0.0})
    pinned_layers: tuple[str, ...] = ("procedural",)


def memory_decay(config: Memory, now: float, layer: str = "memory_layer", created: str = "created_at", accessed: str = "last_accessed", count: str = "access_count", pinned: str = "pinned", model: str | None = None) -> Column:
    """A node's factor: 1 if pinned; else by its layer's half-life, from its last access or creation, whichever is later."""
    half = F.create_map(*[F.lit(x) for pair in config.layers.items() for x in pair])[F.coalesce(F.col(layer), F.lit("episodic"))] if config.layers else F.lit(None).cast("double")
    age = F.lit(float(now)) - F.greatest(F.col(created), F.coalesce(F.col(accessed), F.col(created)))
    m = F.coalesce(F.col(model), F.lit(config.model)) if model else config.model
    return F.when(F.coalesce(F.col(pinned), F.lit(False)), 1.0).otherwise(decay(age, F.coalesce(half, F.lit(config.half_life)), F.coalesce(F.col(count), F.lit(0)), m))


def search_with_scores(nodes: DataFrame, query: list[float], k: int, half_life: float, now: float, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows with similarity, decay_factor (from created_at alone) and their product, score."""
    near = vectors.knn(nodes, query, k, metric, vector, id_col)
    factor = F.round(decay(F.lit(float(now)) - F.col("created_at"), half_life), 6)
    out = near.withColumn("decay_factor", factor).withColumn("score", F.round(F.col("similarity") * F.col("decay_factor"), 6))
    return out.select(id_col, "similarity", "decay_factor", "score").orderBy(F.desc("score"), id_col)


def consensus(members: DataFrame, by: str, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(by, n, variance, consensus): 1 - the mean squared distance to the group's centroid over the squared largest distance of a pair, at most 1."""
    rows = members.select(by, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    middle = vectors.centroid(rows, [by], "v").select(by, "centroid", F.col("members").alias("n"))
    placed = rows.join(small(middle), by).withColumn("d", vectors.belief_distance(F.col("v"), F.col("centroid"))).drop("centroid")
    farthest = F.max_by(F.struct("id", "v"), F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), F.col("d"))).alias("far")
    spread = cut(placed.groupBy(by).agg(F.first("n").alias("n"), F.avg(F.col("d") * F.col("d")).alias("variance"), F.max("d").alias("most"), farthest))
    both = spread.drop("most", "far").join(_widest(placed, spread, by), by, "left")
    square = F.col("widest") * F.col("widest")
    one = F.col("widest").isNull() | (F.col("widest") < 1e-10)
    return both.select(by, "n", F.when(one, 0.0).otherwise(F.col("variance")).alias("variance"), F.when(one, 1.0).otherwise(1 - F.least(F.col("variance") / square, F.lit(1.0))).alias("consensus"))


def _widest(placed: DataFrame, spread: DataFrame, by: str) -> DataFrame:
    """(by, widest): the largest belief distance of two members of each group, exactly; none for a group without pairs.

    No distance exceeds 1, so where the member farthest from the centroid is 1
    away from another the group is done. In others, as angles to the centroid
    add up, members too near to it to be in a wider pair are left out, and the
    rest is compared in pairs of blocks.
    """
    tip = spread.filter("far is not null").select(by, "far", "most")
    d = vectors.belief_distance(F.col("v"), F.col("far.v"))
    first = cut(placed.join(small(tip), by).filter("id != far.id").groupBy(by).agg(F.max(d).alias("widest"), F.first("most").alias("most")))
    angle = lambda x: F.when(x >= 1, math.pi).otherwise(F.acos(1 - x))
    open_ = first.filter("widest < 1")
    if not open_.limit(1).count():
        return first.drop("most")
    left = placed.join(small(open_), by).filter((angle(F.col("d")) + angle(F.col("most"))) >= angle(F.col("widest")) - 1e-6)
    return first.drop("most").unionByName(vectors.widest(left, by)).groupBy(by).agg(F.max("widest").alias("widest"))


def stability(members: DataFrame, by: str, now: float, created: str = "created_at", accesses: str = "access_count", model: str = "exponential") -> DataFrame:
    """(by, stability, average_age_days): mean decay with a half-life of 30 days."""
    age = F.lit(float(now)) - F.col(created)
    return members.groupBy(by).agg(F.avg(decay(age, MONTH, F.coalesce(F.col(accesses), F.lit(0)), model)).alias("stability"), (F.avg(age) / 86_400).alias("average_age_days"))


def friction(members: DataFrame, edges: DataFrame, by: str, id_col: str) -> DataFrame:
    """(by, contradictions, invalidations, friction): 1 - 0.2 x incoming contradicts - 0.5 x incoming invalidates, 0 at least."""
    kinds = edges.filter((F.col("deleted_at") == 0) & F.col("rel").isin("contradicts", "invalidates")).select(F.col("target").alias("_id"), "rel")
    rows = members.select(by, F.col(id_col).alias("_id")).join(kinds, "_id", "left")
    out = rows.groupBy(by).agg(F.sum(F.when(F.col("rel") == "contradicts", 1).otherwise(0)).alias("contradictions"), F.sum(F.when(F.col("rel") == "invalidates", 1).otherwise(0)).alias("invalidations"))
    return out.withColumn("friction", F.greatest(F.lit(0.0), 1 - 0.2 * F.col("contradictions") - 0.5 * F.col("invalidations")))


def state(confidence: Column, frictions: Column) -> Column:
    """contested, crystallized, volatile or stable."""
    return F.when((frictions > 0) & (confidence < 0.85), "contested").when(confidence >= 0.85, "crystallized").when(confidence <= 0.40, "volatile").otherwise("stable")


def belief(members: DataFrame, edges: DataFrame, by: str, now: float, vector: str = "embedding", id_col: str = "vec_id", model: str = "exponential") -> DataFrame:
    """(by, n, consensus, stability, friction, confidence, state) of groups of nodes; confidence = 0.4 C + 0.3 S + 0.3 F."""
    c = consensus(members, by, vector, id_col).select(by, "n", "consensus")
    s = stability(members, by, now, model=model)
    f = friction(members, edges, by, id_col)
    both = c.join(s, by).join(f, by)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * F.col("consensus") + 0.3 * F.col("stability") + 0.3 * F.col("friction")))
    out = both.withColumn("confidence", F.round(conf, 6))
    count = F.col("contradictions") + F.col("invalidations")
    return out.select(by, "n", *(F.round(x, 6).alias(x) for x in ("consensus", "stability", "friction")), "confidence", state(F.col("confidence"), count).alias("state"))


def assess(members: DataFrame, by: str, now: float, stance: str = "stance", created: str = "created_at") -> DataFrame:
    """The light belief score: shares of supporting, contradicting and neutral members and the age of the oldest, with a verdict."""
    n = F.count("*")
    part = lambda x: F.sum(F.when(F.col(stance) == x, 1).otherwise(0))
    con = part("contradicts")
    rows = members.groupBy(by).agg(n.alias("n"), part("supports").alias("supports"), con.alias("contradicts"), F.min(created).alias("oldest"))
    agree, fight = (F.col("n") - F.col("contradicts")) / F.col("n"), F.col("contradicts") / F.col("n")
    steady = F.greatest(F.lit(0.0), 1 - (F.lit(float(now)) - F.col("oldest")) / F.col("n") / (90 * 86_400))
    out = rows.select(by, "n", "supports", "contradicts", F.round(agree, 6).alias("consensus"), F.round(steady, 6).alias("stability"), F.round(fight, 6).alias("friction"))
    verdict = F.when(F.col("friction") > 0.4, "contested").when((F.col("stability") > 0.7) & (F.col("consensus") > 0.6), "well_supported").when(F.col("stability") < 0.3, "fresh").otherwise("fading")
    return out.withColumn("verdict", verdict)
