"""Vector distances, exact nearest neighbours, quantisation and centroids over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.catalog import small

#: Rows of a block of the batch search; a block of 64-d doubles is 16 MB. Each row is sent once for every block of the other side.
BLOCK_ROWS = 32768
#: Fewer rows than that aren't cut for the sake of parallelism, into at most so many blocks.
LEAST_ROWS, LEAST_BLOCKS = 2048, 6
#: Queries and rows of data that are compared at once: 4 MB of products.
QUERY_ROWS, CHUNK_ROWS = 128, 4096


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def belief_distance(a: Column, b: Column) -> Column:
    """Cosine distance with the similarity clamped to [0, 1]; 1 for zero vectors and unequal lengths."""
    return F.when(F.size(a) != F.size(b), F.lit(1.0)).otherwise(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cosine_distance(a, b))))


def normalize(a: Column) -> Column:
    """The vector at unit length; zero stays zero."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def score(distance: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + distance)


METRICS = {"cosine": cosine_distance, "euclidean": squared_euclidean}


def knn(df: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to ``query``, with distance and similarity; ties by id. One pass and a top-k merge, no full sort."""
    literal = F.array(*map(F.lit, map(float, query)))
    near = df.withColumn("distance", F.round(METRICS[metric](F.col(vector), literal), 6))
    return near.withColumn("similarity", F.round(score(F.col("distance")), 6)).orderBy("distance", id_col).limit(k)


def vector_of(df: DataFrame, key: int | str, vector: str = "embedding", id_col: str = "vec_id") -> list[float]:
    """One row's vector, a point lookup. KeyError if there's no such row."""
    row = df.filter(F.col(id_col) == key).select(vector).first()
    if row is None:
        raise KeyError(key)
    return list(row[0])


def _numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of a table (id, v) whose vectors are of one length, without those that have a component that's no number, and which rows these are."""
    v = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    good = np.flatnonzero(np.isfinite(v).all(1))
    return np.asarray(t.column("id").combine_chunks())[good], v[good], good


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.linalg.norm(v, axis=1)[:, None]
    return np.divide(v, scale, out=np.zeros_like(v), where=scale > 0)


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS), min(LEAST_BLOCKS, rows // LEAST_ROWS))


def _best(metric: str, k: int):
    """The k nearest rows of right (id, v) for each of left (id, v, and kth if no farther ones are wanted), in chunks that stay in the processor's cache.

    A first chunk gives each query a bound; of the others only what meets it is sorted.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if left.num_rows and right.num_rows:
            bound = np.asarray(left.column("kth").combine_chunks()) if "kth" in left.column_names else np.full(left.num_rows, np.inf)
            (q_id, q, own), (d_id, d, _) = _numbers(left), _numbers(right)
            bound = bound[own]
            order = np.argsort(d_id, kind="stable")
            d_id, d = d_id[order], d[order]
            # so many rows of data share an id at most; a query's own aren't its neighbours
            same = int(np.diff(np.flatnonzero(np.r_[True, d_id[1:] != d_id[:-1], True])).max()) if len(d_id) else 0
            if metric == "cosine":
                q, d = _unit(q), _unit(d)
                lift, reach = np.zeros(len(d)), 1 - bound
                far_of = lambda s, i: 1 - s
            else:
                square = (q**2).sum(1)
                lift, reach = (d**2).sum(1) / 2, (square - bound) / 2
                far_of = lambda s, i: np.maximum(square[i] - 2 * s, 0)
            take = k + same
            for a in range(0, len(q) if len(d) else 0, QUERY_ROWS):
                x, least = q[a : a + QUERY_ROWS], reach[a : a + QUERY_ROWS, None] - 2e-6
                rows, cols, values = [], [], []
                for b in range(0, len(d), CHUNK_ROWS):
                    s = x @ d[b : b + CHUNK_ROWS].T
                    s -= lift[b : b + CHUNK_ROWS]
                    if b == 0 and s.shape[1] > take:
                        least = np.maximum(least, np.partition(s, s.shape[1] - take, 1)[:, s.shape[1] - take, None] - 2e-6)
                    at = np.flatnonzero(s >= least)
                    row, col = np.divmod(at, s.shape[1])
                    rows.append(row)
                    cols.append(col + b)
                    values.append(s.ravel()[at])
                row, col = np.concatenate(rows), np.concatenate(cols)
                far = np.round(far_of(np.concatenate(values), a + row), 6) + 0.0
                other = q_id[a + row] != d_id[col]
                row, col, far = row[other], col[other], far[other]
                order = np.lexsort((col, far, row))
                row, col, far = row[order], col[order], far[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                parts.append((q_id[a + row[keep]], d_id[col[keep]], far[keep]))
        kind = left.schema.field("id").type
        c = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(3)]
        return pa.table({"query_id": pa.array(c[0], kind), "neighbor_id": pa.array(c[1], kind), "distance": pa.array(c[2], pa.float64())})

    return run


def knn_batch(queries: DataFrame, data: DataFrame, k: int, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k nearest rows of ``data`` for every query, but the row itself; exact.

    Both sides are cut into blocks by hash; each pair of blocks is one numpy
    product and keeps k rows a query, and the blocks' results are merged. No
    side is broadcast or collected. ``ann.IvfIndex`` prunes for larger tables.
    """
    kind = data.schema[id_col].dataType
    plain = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    q, d = plain(queries), plain(data)
    nq, nd = _blocks(q.count()), _blocks(d.count())
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", own(nq)).withColumn("db", all_(nd))
    right = d.withColumn("db", own(nd)).withColumn("qb", all_(nq))
    out = T.StructType([T.StructField("query_id", kind), T.StructField("neighbor_id", kind), T.StructField("distance", T.DoubleType())])
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(_best(metric, k), out)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "distance")


def _widest_of_blocks(by: str):
    def parts(t: pa.Table) -> dict[int, pa.Table]:
        size = np.asarray(pc.list_value_length(t.column("v").combine_chunks()))
        return {int(s): t.filter(pa.array(size == s)) for s in np.unique(size)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        most = None
        for m, x in parts(left).items() if left.num_rows and right.num_rows else ():
            for n, y in parts(right).items():
                if m != n:
                    ids = [np.asarray(t.column("id").combine_chunks()) for t in (x, y)]
                    if (ids[0] != ids[0][0]).any() or (ids[1] != ids[0][0]).any():
                        most = 1.0
                    continue
                (a, p, _), (b, q, _) = _numbers(x), _numbers(y)
                p, q = _unit(p), _unit(q)
                order = np.argsort(b, kind="stable")
                b, q = b[order], q[order]
                for i in range(0, len(a) if len(b) else 0, 256):
                    cos = p[i : i + 256] @ q.T
                    # pairs of one id don't count
                    lo, hi = np.searchsorted(b, a[i : i + 256]), np.searchsorted(b, a[i : i + 256], "right")
                    for r in np.nonzero(hi > lo)[0]:
                        cos[r, lo[r] : hi[r]] = np.inf
                    least = cos.min()
                    if least < np.inf:
                        most = max(most or 0.0, 1 - max(0.0, min(1.0, least)))
        kept = left.column(by)[:1] if most is not None else left.column(by)[:0]
        return pa.table({by: kept, "widest": pa.array([most] if most is not None else [], pa.float64())})

    return run


def widest(rows: DataFrame, by: str) -> DataFrame:
    """(by, widest): the largest belief distance of two rows (by, id, v) of a group with different ids, by pairs of hash blocks; none where there's no pair."""
    rows = rows.select(by, "id", "v").filter(F.col(by).isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull())
    blocks = small(rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n")))
    own = rows.join(blocks, by).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    left = own.select(by, "id", "v", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"))
    again = (F.col(c).alias(c) for c in (by, "id", "v"))  # else both sides' columns are the same
    right = own.select(*again, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    key = [by, "_i", "_j"]
    out = T.StructType([rows.schema[by], T.StructField("widest", T.DoubleType())])
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_widest_of_blocks(by), out)
    return found.groupBy(by).agg(F.max("widest").alias("widest"))


def centroid(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by..., centroid, members): the mean vector of each group, by position."""
    flat = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = flat.groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("members"))


def train_quantizer(df: DataFrame, vector: str = "embedding", share: float = 0.999) -> float:
    """The magnitude that int8 quantisation maps to 127: the element at index int(n * share) of the sorted magnitudes, exactly.

    A histogram of at most 65537 bins finds the bin of that index, and only the
    bin's values are sorted, so nothing needs a total sort or a large state.
    """
    values = df.select(F.explode(F.col(vector)).alias("x")).select(F.abs("x").cast("double").alias("x")).filter("x is not null")
    n, most = values.agg(F.count("x"), F.max("x")).first()
    if not n:
        raise ValueError("there's nothing to train on")
    if not most:
        return 0.0
    at = min(int(n * share), n - 1)
    bin_ = F.floor(F.col("x") / most * 65536)
    before = 0
    for b, count in sorted(values.groupBy(bin_.alias("b")).count().collect()):
        if before + count > at:
            return values.filter(bin_ == b).orderBy("x").offset(at - before).limit(1).first()[0]
        before += count
    raise AssertionError("the histogram is complete")


def quantize(v: Column, magnitude: float) -> Column:
    """int8 by symmetric scaling, halves away from zero."""
    return F.transform(v, lambda x: F.round(F.greatest(F.least(x.cast("double") / magnitude * 127, F.lit(127.0)), F.lit(-127.0))).cast("tinyint"))


def dequantize(v: Column, magnitude: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127 * magnitude)


def int8_cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of int8 vectors, clamped to [0, 2]; 1 where a norm is zero."""
    whole = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("bigint") * q.cast("bigint")), F.lit(0).cast("bigint"), lambda s, z: s + z)
    scale = F.sqrt(whole(a, a).cast("double")) * F.sqrt(whole(b, b).cast("double"))
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - whole(a, b) / scale)))


def half(df: DataFrame, vector: str = "embedding", out: str = "half") -> DataFrame:
    """``df`` with the vector rounded to float16 (given back as floats) in ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(vector)
            ptr = np.asarray(lists.offsets)
            flat = np.asarray(lists.values.slice(ptr[0], ptr[-1] - ptr[0])).astype(np.float16).astype(np.float32)
            made = pa.ListArray.from_arrays(pa.array((ptr - ptr[0]).astype(np.int32)), pa.array(flat), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def near_pairs(df: DataFrame, k: int, least_score: float, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(a, b, score), a < b: pairs where either is among the other's k nearest, with a score of at least ``least_score``."""
    near = knn_batch(df, df, k, "cosine", vector, id_col)
    s = F.round(score(F.col("distance")), 6)
    return near.select(F.least("query_id", "neighbor_id").alias("a"), F.greatest("query_id", "neighbor_id").alias("b"), s.alias("score")).filter(F.col("score") >= least_score).distinct()


def hydrate(ids: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """Joins ids (with any columns) to their nodes; unknown ids are left out."""
    return nodes.join(small(ids), id_col)
