"""Mixing sources to target weights by systematic sampling.

Source s has the target weight_s x size, and each of its n documents target / n
expected copies. The target is an integer of UNIT parts of a copy, the rest is
exact integer arithmetic: a document whose prefix sum of expected copies within
its source runs from a to b is emitted once for each whole number in
(a + offset, b + offset], with one random offset in [0, 1) for all sources. So a
source's copies differ from its target by less than one at any size, and equal
documents' copies by at most one.

All documents of a source expect the same number of copies, so the prefix sum
is rank x target / n. Ranks come from counts of small blocks of ids: only
(doc_id, source) pairs are shuffled for them, no source is sorted in one task,
and the window over blocks sees one row per block. Sources may be as many as
domains: their sizes are never collected, and targets ride on the blocks' rows.
Texts are shuffled at most once, to meet the copies.

Defined results. By default weights are equal and the result has as many rows
as the input. A NULL source is a source like any other. Sources of the table
without a weight get none; weights of sources that the table lacks, and
weights that are NULL, infinite or not above 0, count as absent, and the rest is
normalised to 1. Rows that tie in doc_id (repeated, or NULL, which comes first)
are ordered by a hash of all columns (but maps and variants); equal rows are interchangeable.
NULL and empty texts count as documents. An empty table, or one without any
weighted source, gives an empty result. All columns are kept; ``copy_no`` counts
an emitted document's copies from 1, under the next free name (copy_no1, ...)
if the table has such a column.
"""

from __future__ import annotations

import random
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, keyed_join, read

#: Fixed point of targets: one copy is so many parts.
UNIT = 1_000_000
SEED = 20240131
#: Rank blocks hold about this many documents of a source.
BLOCK = 4096


def offset(seed: int = SEED) -> int:
    """The random offset, in parts of a copy."""
    return random.Random(seed).randrange(UNIT)


def _share(weight: Fraction, total: Fraction, rows: int) -> int:
    return int(weight / total * rows * UNIT + Fraction(1, 2))


def targets(sources: list[object], weights: Mapping[object, float], rows: int) -> dict[object, int]:
    """The target of each of the table's ``sources``, in parts of a copy; ``rows`` is their sum."""
    wanted = {s: Fraction(weights[s]) for s in sources if weights.get(s) is not None and 0 < weights[s] < float("inf")}
    total = sum(wanted.values(), Fraction(0))
    return {s: _share(w, total, rows) for s, w in wanted.items()}


def sample(docs: DataFrame, weights: Mapping[object, float] | None = None, size: int | None = None, seed: int = SEED, copy_no: str = "copy_no") -> DataFrame:
    """The mixture: the columns of ``docs`` and ``copy_no``. ``size`` is the target number of rows."""
    spark = docs.sparkSession
    copy_no = fresh(docs, copy_no)
    key = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    light = cut(docs.select("source", F.col("doc_id").alias("id"), key.alias("rid")))
    sizes = light.groupBy("source").agg(F.count("*").alias("n"))
    rows, kinds = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = rows if size is None else size
    kind = docs.schema["source"].dataType.simpleString()
    if weights is None:
        wanted = sizes.select("source", F.lit(_share(Fraction(1), Fraction(max(kinds, 1)), rows)).cast("decimal(20,0)").alias("target"))
    else:
        # no more rows than the caller gave weights
        named = spark.createDataFrame([(s,) for s in weights], f"s {kind}")
        present = [r[0] for r in sizes.join(named, sizes.source.eqNullSafe(named.s)).select("source").collect()]
        wanted = spark.createDataFrame(list(targets(present, weights, rows).items()), f"source {kind}, target bigint").withColumn("target", F.col("target").cast("decimal(20,0)"))
    at = _ranked(light, wanted)
    upto = lambda nth: f"((cast({nth} as decimal(16,0)) * target + {offset(seed)} * cast(n as decimal(16,0))) div (n * {UNIT}))"
    crossed = F.expr(f"{upto('nth')} - {upto('(nth - 1)')}")
    rid, copies = fresh(docs, "rid"), fresh(docs, "copies")
    # equal rows share a rid, so their copies are added and dealt to the rows again
    some = at.select(F.col("rid").alias(rid), crossed.alias("n")).groupBy(rid).agg(F.array_sort(F.collect_list("n")).alias(copies))
    some = cut(some.filter(F.expr(f"exists({copies}, x -> x > 0)")))
    joined = keyed_join(docs.withColumn(rid, key), some, rid, "inner")
    if light.groupBy("rid").count().filter("count > 1").limit(1).count():
        n = fresh(docs, "n")
        joined = joined.withColumn(n, F.row_number().over(Window.partitionBy(rid).orderBy(F.lit(1))))
        joined = joined.withColumn(copies, F.array(F.element_at(copies, F.col(n)))).drop(n)
    one = F.element_at(copies, 1)
    return joined.filter(one > 0).withColumn(copy_no, F.explode(F.sequence(F.lit(1), one.cast("int")))).select(*docs.columns, copy_no)


def _ranked(light: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, nth, n, target) of the sources in ``wanted``: the rank from 1 by (id, rid) within the source and the source's rows, without a task that sees a whole source.

    The rows are range-partitioned by (id, rid) and sorted; a row's rank is the
    number of its source's rows in earlier partitions and in its own up to it.
    """
    rows = light.count()
    parts = max(1, -(-rows // (BLOCK * 16)))
    placed = cut(light.repartitionByRange(parts, F.col("id").asc_nulls_first(), "rid").withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("source")
    block = placed.groupBy("source", "part").count()
    block = block.withColumn("past", F.sum("count").over(whole.orderBy("part")) - F.col("count")).withColumn("n", F.sum("count").over(whole))
    block = block.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("part").alias("p"), "past", "n", "target")
    local = placed.withColumn("within", F.row_number().over(Window.partitionBy("source", "part").orderBy(F.col("id").asc_nulls_first(), "rid")))
    both = local.join(block, local.source.eqNullSafe(block.s) & (local.part == block.p))
    return both.select("rid", (F.col("past") + F.col("within")).alias("nth"), "n", "target")


#: The mixture of the query: a flat one over all sources of the table.
WEIGHTS: Mapping[object, float] | None = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of an equal mixture of all sources, as many rows as the table has."""
    return sample(read(spark, sf_dir, "documents"), WEIGHTS)


SQL = f"""
WITH sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT CAST(sum(n) AS HUGEINT) AS n, count(*) AS k FROM sized),
ranked AS (SELECT d.*, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS HUGEINT) AS nth FROM documents d),
copies AS (
  SELECT r.*, CAST((nth * target + {offset()} * size) // (size * {UNIT}) - ((nth - 1) * target + {offset()} * size) // (size * {UNIT}) AS INTEGER) AS copies
  FROM ranked r JOIN (SELECT source AS s, CAST(sized.n AS HUGEINT) AS size, (2 * total.n * {UNIT} + k) // (2 * k) AS target FROM sized, total) ON source IS NOT DISTINCT FROM s)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM copies
"""
