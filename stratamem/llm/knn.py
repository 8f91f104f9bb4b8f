"""Exact top-k search as a Voronoi kNN join.

Rows are assigned to their nearest pivot. From the cells' summaries (radius, and
the distances of the rows nearest to the pivot) follows, for each cell of
queries, a bound on how far its k-th neighbour can be; the triangle inequality
then tells which rows of another cell can matter. Cells are put together into
groups of queries, each row of data is replicated to just the groups whose
bounds it meets, and every group is solved by itself, in blocks of queries and
of data, whose results are merged. ``queries`` tells which rows are queries,
by default all; the registered search asks for every id divisible by 100.

What reaches the driver and the executors as a whole are the pivots and the
summaries: at most MOST_PIVOTS x MOST_PIVOTS bounds, whatever the number of rows.
Beyond some 4 x MOST_PIVOTS squared rows, cells grow instead of getting more,
which prunes less but leaves nothing out: groups beyond GROUP_ROWS queries are
solved in several blocks of them, and data in blocks of BLOCK_ROWS, so a task's
memory doesn't grow. Where the data can't be pruned (high dimensions),
replication grows with the number of groups, as any exact search must.

Defined results. Distances are Euclidean, in double precision, rounded to 6
decimals; ties go to the lesser id. A row isn't a neighbour of its own id. Rows
that repeat an id count once, with the least of their vectors. Rows with a NULL
id or vector, with a NULL or non-finite component, or of another dimension than
most rows, are neither queries nor neighbours. Fewer than k others give fewer
than k neighbours. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_safe, read, saved

K_NEIGHBOURS = 10
MOST_PIVOTS = 1024
GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS = 8192, 16384, 256
#: Distances that differ by less count as possible ties until they're rounded.
_SLACK = 2e-6


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a**2).sum(1)[:, None]
    d += (b**2).sum(1)
    return np.maximum(d, 0, out=d)


def _clean(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.limit(0)
    rows = rows.filter(F.size("v") == sizes[0].d)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


class _Plan:
    """Groups of cells, and for each (group, cell) the distances from the pivot that rows to replicate have.

    ``count`` and ``radius`` are of the queries of each cell, ``nearest`` the least distances of all rows.
    """

    def __init__(self, pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, nearest: list[list[float]], k: int) -> None:
        m = len(pivots)
        self.pivots = pivots
        between = np.sqrt(_squares(pivots, pivots))
        bound = np.zeros(m)
        for i in range(m):
            if not count[i]:
                continue
            reach: list[float] = []
            held = 0
            for j in np.argsort(between[i], kind="stable"):
                reach += [radius[i] + between[i, j] + e for e in nearest[j]]
                held += len(nearest[j])
                if held >= 4 * (k + 1):
                    break
            reach.sort()
            # the row itself is one of them; with too few rows every row matters
            bound[i] = reach[k] if len(reach) > k else np.inf
        self.group = self._groups(between, count)
        groups = self.group.max() + 1
        self.rows = np.bincount(self.group, count, groups).astype(np.int64)
        low, high = np.full((groups, m), np.inf), np.full((groups, m), -np.inf)
        for i in range(m):
            if count[i]:
                g = self.group[i]
                span = radius[i] + bound[i] + 1e-6
                low[g] = np.minimum(low[g], between[i] - span)
                high[g] = np.maximum(high[g], between[i] + span)
        self.low, self.high, self.groups = low, high, groups

    @staticmethod
    def _groups(between: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Neighbouring cells of together about GROUP_ROWS queries; each group starts at the free cell farthest from the last start."""
        m = len(count)
        group, free, g, at = np.full(m, -1), np.ones(m, bool), 0, 0
        while free.any():
            rows = 0
            for j in np.argsort(np.where(free, between[at], np.inf), kind="stable"):
                if not free[j] or (rows and rows + count[j] > GROUP_ROWS):
                    break
                group[j], free[j] = g, False
                rows += count[j]
            g += 1
            if free.any():
                at = int(np.argmax(np.where(free, between[at], -1)))
        return group


def _solve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            q_id, d_id = (np.asarray(t.column("id").combine_chunks()) for t in (left, right))
            q, d = _matrix(left.column("v")), _matrix(right.column("v"))
            order = np.argsort(d_id, kind="stable")
            d_id, d = d_id[order], d[order]
            take = min(k, len(d) - 1)
            for a in range(0, len(q), QUERY_ROWS):
                some = q[a : a + QUERY_ROWS]
                square = _squares(some, d)
                limit = np.sqrt(np.partition(square, take, 1)[:, take]) + _SLACK
                row, col = np.nonzero(square <= (limit**2 + 1e-12)[:, None])
                other = q_id[a + row] != d_id[col]
                row, col = row[other], col[other]
                far = np.round(np.sqrt(((some[row] - d[col]) ** 2).sum(1)), 6)
                order = np.lexsort((col, far, row))
                row, col, far = row[order], col[order], far[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                out.append((q_id[a + row[keep]], d_id[col[keep]], far[keep]))
        kind = left.schema.field("id").type
        parts = [np.concatenate([o[i] for o in out]) if out else [] for i in range(3)]
        return pa.table({"query_id": pa.array(parts[0], kind), "neighbor_id": pa.array(parts[1], kind), "distance": pa.array(parts[2], pa.float64())})

    return run


def knn_join(df: DataFrame, k: int = K_NEIGHBOURS, id_col: str = "vec_id", vector: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k nearest other rows of every row that meets ``queries``. Ids are numbers.

    ``queries`` is a condition on ``id_col``; by default all rows are queries, and rows for which it is NULL are none.
    """
    spark = df.sparkSession
    arrow_safe(spark)
    kind = df.schema[id_col].dataType
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = _clean(df, id_col, vector).withColumnRenamed("id", id_col)
    rows = saved(rows.select(F.col(id_col).alias("id"), "v", asked.alias("q")), "vectors")
    n, total = rows.agg(F.count("*"), F.count_if("q")).first()
    out = T.StructType([T.StructField("query_id", kind), T.StructField("neighbor_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    if n < 2 or not total:
        return spark.createDataFrame([], out)
    m = int(max(1, min(MOST_PIVOTS, n**0.5 / 2)))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(m).collect()])
    given = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            cell = _squares(v, p).argmin(1)
            far = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "q": batch.column("q"), "cell": pa.array(cell.astype(np.int32)), "far": pa.array(far)})

    fields = [T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType()))]
    placed = saved(rows.mapInArrow(assign, T.StructType([*fields, T.StructField("q", T.BooleanType()), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])), "cells")
    count, radius = np.zeros(m, np.int64), np.zeros(m)
    nearest: list[list[float]] = [[] for _ in range(m)]
    for r in placed.filter("q").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        count[r.cell], radius[r.cell] = r.n, r.radius
    by_distance = Window.partitionBy("cell").orderBy("far", "id")
    for r in placed.select("cell", "far", F.row_number().over(by_distance).alias("nth")).filter(F.col("nth") <= k + 1).collect():
        nearest[r.cell].append(r.far)
    plan = spark.sparkContext.broadcast(_Plan(pivots, count, radius, nearest, k))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            row, group = np.nonzero(((far >= p.low[:, cell]) & (far <= p.high[:, cell])).T)
            for a in range(0, len(row), BLOCK_ROWS):
                at = pa.array(row[a : a + BLOCK_ROWS])
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(at), "v": batch.column("v").take(at), "g": pa.array(group[a : a + BLOCK_ROWS].astype(np.int32))})

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        total = np.zeros(p.groups, np.int64)
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            total += ((far >= p.low[:, cell]) & (far <= p.high[:, cell])).sum(1)
        yield pa.RecordBatch.from_pydict({"g": pa.array(np.arange(p.groups, dtype=np.int32)), "n": pa.array(total)})

    sizes = {r.g: r.n for r in placed.select("cell", "far").mapInArrow(needed, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    # one row per group, at most MOST_PIVOTS
    parts = [(g, max(1, -(-size // BLOCK_ROWS)), max(1, -(-int(plan.value.rows[g]) // GROUP_ROWS))) for g, size in sizes.items()]
    blocks = F.broadcast(spark.createDataFrame(parts, "g int, blocks int, lots int"))
    of_cell = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(plan.value.group)], "cell int, g int"))
    part = lambda count: F.expr(f"int(pmod(xxhash64(id), {count}))")
    each = lambda count: F.explode(F.expr(f"sequence(0, {count} - 1)"))
    data = placed.mapInArrow(replicate, T.StructType([*fields, T.StructField("g", T.IntegerType())])).join(blocks, "g").select("id", "v", "g", part("blocks").alias("b"), each("lots").alias("lot"))
    asking = placed.filter("q").join(of_cell, "cell").join(blocks, "g").select("id", "v", "g", each("blocks").alias("b"), part("lots").alias("lot"))
    key = ["g", "b", "lot"]
    found = asking.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(_solve(k), T.StructType([f for f in out.fields if f.name != "rank"]))
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*out.fieldNames())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every embedding whose id is divisible by 100, among all embeddings."""
    return knn_join(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, neighbor_id, rank, distance FROM r WHERE rank <= {K_NEIGHBOURS}
"""
