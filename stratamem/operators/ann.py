"""Nearest neighbours with an inverted file of K-means cells; ``vectors.knn`` is the exact answer it is measured against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.catalog import cut
from stratamem.operators import vectors


class IvfIndex:
    """Vectors in cells, written partitioned by cell so that a search reads only the cells it probes.

    Cells are trained on all vectors. What's broadcast are the centres.
    """

    def __init__(self, df: DataFrame, cells: int = 64, vector: str = "embedding", id_col: str = "vec_id", seed: int = 7) -> None:
        self.vector, self.id_col = vector, id_col
        chosen = df.filter(F.col(vector).isNotNull()).select(array_to_vector(vectors.normalize(F.col(vector))).alias("features"))
        self.centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(chosen).clusterCenters())
        placed = self._ranked(df)
        self.rows = placed.withColumn("cell", F.col("_cells")[0]).drop("_cells", "_squares")
        self.radius, self.count = [0.0] * len(self.centres), [0] * len(self.centres)
        for cell, d, n in placed.groupBy(F.col("_cells")[0].alias("c")).agg(F.max(F.col("_squares")[0]), F.count("*")).collect():
            self.radius[cell], self.count[cell] = float(d) ** 0.5, n

    def _ranked(self, df: DataFrame, cells: int = 1) -> DataFrame:
        """``df`` with ``_cells``, its nearest cells by number, and ``_squares``, the squared distances of their centres; NULL vectors are left out."""
        vector, centres = self.vector, self.centres
        square = (centres**2).sum(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.asarray(b.column(vector).flatten(), np.float64).reshape(b.num_rows, -1)
                scale = np.linalg.norm(v, axis=1)[:, None]
                v = np.divide(v, scale, out=np.zeros_like(v), where=scale > 0)
                d = np.maximum((v**2).sum(1)[:, None] + square - 2 * v @ centres.T, 0)
                order = np.argsort(d, 1, kind="stable")[:, :cells]
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
                yield pa.RecordBatch.from_arrays([*b.columns, lists(order, pa.int32()), lists(np.take_along_axis(d, order, 1), pa.float64())], names=[*b.schema.names, "_cells", "_squares"])

        extra = [T.StructField("_cells", T.ArrayType(T.IntegerType())), T.StructField("_squares", T.ArrayType(T.DoubleType()))]
        return df.filter(F.col(vector).isNotNull()).mapInArrow(run, T.StructType([*df.schema.fields, *extra]))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(path)

    def search(self, queries: DataFrame, k: int, probe: int = 8) -> DataFrame:
        """(query_id, neighbor_id, rank, distance) by cosine distance; exact.

        The ``probe`` nearest cells are read first, then those that can hold a
        nearer vector than the k-th found: ones whose centre is no farther than
        that distance and the cell's radius. Either is solved in blocks of a
        cell's queries and data, the second with the bound that the first gave.
        """
        kind = self.rows.schema[self.id_col].dataType
        asked = queries.select(F.col(self.id_col).alias("id"), F.col(self.vector).alias(self.vector)).filter("id is not null")
        q = self._ranked(asked, len(self.centres)).withColumnRenamed(self.vector, "v")
        d = self.rows.select(F.col(self.id_col).alias("id"), F.col(self.vector).alias("v"), "cell").filter("id is not null")
        w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
        out = T.StructType([T.StructField("query_id", kind), T.StructField("neighbor_id", kind), T.StructField("distance", T.DoubleType())])
        blocks = F.get(F.array(*(F.lit(max(1, -(-n // vectors.BLOCK_ROWS))) for n in self.count)), F.col("cell"))
        lots = max(1, -(-queries.count() * min(probe, len(self.centres)) // len(self.centres) // vectors.BLOCK_ROWS))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

        def near(left: DataFrame) -> DataFrame:
            """The k nearest of each cell that rows (id, v, kth, cell) ask."""
            key = ["cell", "lot", "block"]
            a = left.withColumn("lot", own(F.lit(lots))).withColumn("block", all_(blocks))
            b = d.withColumn("block", own(blocks)).withColumn("lot", all_(F.lit(lots)))
            return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(vectors._best("cosine", k), out)

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "rank", "distance")

        first = q.select("id", "v", F.lit(float("inf")).alias("kth"), F.explode(F.slice("_cells", 1, probe)).alias("cell"))
        first = cut(best(near(first)))
        last = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("kth"))
        radius = F.get(F.array(*map(F.lit, self.radius)), F.col("cell"))
        # distances are rounded to six places, and unit vectors at cosine distance t are sqrt(2 t) apart
        open_ = F.col("kth").isNull() | (F.sqrt("d") - radius <= F.sqrt(2 * F.greatest(F.col("kth"), F.lit(0.0)) + 4e-6) + 1e-9)
        rest = q.select("id", "v", F.slice(F.arrays_zip("_cells", "_squares"), probe + 1, len(self.centres)).alias("c")).join(last, "id", "left")
        rest = rest.select("id", "v", "kth", F.explode("c").alias("c")).select("id", "v", "kth", F.col("c._cells").alias("cell"), F.col("c._squares").alias("d")).filter(open_)
        return best(first.drop("rank").unionByName(near(rest.select("id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"), "cell"))))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of true (query_id, neighbor_id) pairs that were found."""
    n = truth.count()
    return truth.join(found, ["query_id", "neighbor_id"], "left_semi").count() / n if n else 1.0
