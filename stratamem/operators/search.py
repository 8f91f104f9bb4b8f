"""Full-text ranking (BM25), hybrid fusion with vectors, and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.catalog import arrow_safe, cut, small
from stratamem.functions import stemmers, text
from stratamem.operators import vectors

K1, B = 1.2, 0.75
#: Up to so many distinct (query, token), and tokens times queries, documents are scored by products with a matrix that all workers hold.
MOST_ASKED, MOST_WEIGHTS = 200_000, 4_000_000
TEXT_FIELDS = ("content", "text", "page_content", "body", "description", "summary")


def text_field(df: DataFrame) -> str:
    """The column to search: the first usual name, else the first string column."""
    strings = [c for c, t in df.dtypes if t == "string"]
    found = next((c for c in TEXT_FIELDS if c in strings), None) or next((c for c in strings if c not in ("id", "doc_id")), None)
    if found is None:
        raise ValueError("there's no text column")
    return found


def stemmed(rows: DataFrame, language: str, token: str = "token") -> DataFrame:
    """``rows`` with the tokens' stems instead: the distinct vocabulary goes through Python once and is joined back."""
    stems = rows.select(token).distinct().withColumn("_stem", text.stem(language)(F.col(token)))
    return rows.join(stems, token).withColumn(token, F.col("_stem")).drop("_stem").select(*rows.columns)


def postings(docs: DataFrame, id_col: str = "doc_id", column: str = "text", language: str | None = None) -> DataFrame:
    """(id, token, tf, length): the inverted index. With a language, stop words go, the rest is stemmed, and lengths count what's left."""
    words = text.tokens(column)
    words = text.without_stop_words(words, language) if language else words
    flat = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("token"))
    counted = flat.groupBy("id", "length", "token").agg(F.count("*").alias("tf"))
    if not language:
        return counted.select("id", "token", "tf", "length")
    return stemmed(counted, language).groupBy("id", "length", "token").agg(F.sum("tf").alias("tf")).select("id", "token", "tf", "length")


def field_stats(docs: DataFrame, column: str = "text", language: str | None = None) -> DataFrame:
    """(total_docs, average_length) over documents that have the field."""
    words = text.tokens(column)
    words = text.without_stop_words(words, language) if language else words
    return docs.filter(F.col(column).isNotNull()).agg(F.count("*").alias("total_docs"), F.avg(F.size(words)).alias("average_length"))


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", column: str = "text", language: str | None = None, k: int | None = None) -> DataFrame:
    """(query_id, id, score) of every document that shares a token with a query (query_id, text).

    A token that a query repeats counts each time. With ``k`` only each query's
    k best documents by rounded score, ties by id, are sure to be there, among
    others; scores are rounded then. One pass counts the queries' tokens, a
    second one multiplies each batch of documents with all queries. Where the
    queries are too many for that, or documents share an id, postings are joined.
    """
    words = text.tokens("text")
    words = text.without_stop_words(words, language) if language else words
    asked = queries.select("query_id", F.explode(words).alias("token"))
    asked = stemmed(asked, language) if language else asked
    asked = cut(asked.groupBy("query_id", "token").agg(F.count("*").alias("times")))
    rows = asked.limit(MOST_ASKED + 1).collect()
    tokens = {t: i for i, t in enumerate(sorted({r.token for r in rows}))}
    ids = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in rows))}
    kept = docs.filter(F.col(column).isNotNull())
    repeated = kept.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null")
    if len(rows) > MOST_ASKED or len(tokens) * len(ids) > MOST_WEIGHTS or repeated.limit(1).count():
        return _bm25_joined(docs, asked, id_col, column, language)
    weights = np.zeros((len(tokens), len(ids)))
    for r in rows:
        weights[tokens[r.token], ids[r.query_id]] = r.times
    return _bm25_batches(kept, tokens, weights, ids, queries.schema["query_id"].dataType, id_col, column, language, k)


def _bm25_joined(docs: DataFrame, asked: DataFrame, id_col: str, column: str, language: str | None) -> DataFrame:
    """Scores from postings; only those of the queries' tokens are kept before anything is joined or counted."""
    wanted = small(asked.select("token").distinct())
    index = postings(docs, id_col, column, language).join(wanted, "token", "left_semi")
    frequency = index.groupBy("token").agg(F.count("*").alias("df"))
    stats = F.broadcast(field_stats(docs, column, language))  # one row
    weights = asked.join(frequency, "token").crossJoin(stats).select("query_id", "token", "average_length", (F.col("times") * idf(F.col("total_docs"), F.col("df"))).alias("w"))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average_length")))
    return index.join(small(weights), "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def _counts(tokens: dict[str, int], language: str | None):
    """A function from a batch (id, w) of documents' words to parts of it: (first row, lengths, how often each row has each token)."""
    one = {"english": stemmers.english, "italian": stemmers.italian}[language] if language else None
    known: dict[str, int] = {}
    table = pa.array(tokens, pa.string())

    def code(word: str) -> int:
        if word not in known:
            if len(known) > 500_000:
                known.clear()
            known[word] = tokens.get(one(word), -1)
        return known[word]

    def run(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        m = len(tokens)
        size = max(1, min(512, (4 << 20) // max(1, m)))
        for at in range(0, b.num_rows, size):
            lists = b.column("w").slice(at, size)
            length = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            flat = lists.flatten()
            if one:
                encoded = flat.dictionary_encode()
                codes = np.array([code(w) for w in encoded.dictionary.to_pylist()], np.int64)[np.asarray(encoded.indices)]
            else:
                codes = np.asarray(pc.fill_null(pc.index_in(flat, value_set=table), -1)).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            hit = codes >= 0
            yield at, length, np.bincount(row[hit] * m + codes[hit], minlength=len(length) * m).reshape(len(length), m)

    return run


def _bm25_batches(docs: DataFrame, tokens: dict[str, int], weights: np.ndarray, ids: dict, query_type: T.DataType, id_col: str, column: str, language: str | None, k: int | None) -> DataFrame:
    spark = docs.sparkSession
    arrow_safe(spark)
    kind = docs.schema[id_col].dataType
    words = text.tokens(column)
    words = text.without_stop_words(words, language) if language else words
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    out = T.StructType([T.StructField("query_id", query_type), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    m = len(tokens)
    if not m:
        return spark.createDataFrame([], out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = _counts(tokens, language), np.zeros(m + 2, np.int64)
        for b in batches:
            for _, length, tf in parts(b):
                total[:m] += (tf > 0).sum(0)
                total[m:] += len(length), length.sum()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"code": pa.array(np.arange(m + 2, dtype=np.int32)), "n": pa.array(total)})

    total = np.zeros(m + 2)
    for r in rows.select("w").mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[r.code] = r.n
    if not total[m + 1]:
        return spark.createDataFrame([], out)
    average = total[m + 1] / total[m]
    scale = np.log(1 + (total[m] - total[:m] + 0.5) / (total[:m] + 0.5)) * (K1 + 1)
    given = spark.sparkContext.broadcast(weights * scale[:, None])

    def best(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], i[keep], s[keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, w = _counts(tokens, language), given.value
        least, held = np.zeros(w.shape[1]), None
        for b in batches:
            own = b.column("id")
            for at, length, tf in parts(b):
                found = (tf / (tf + K1 * (1 - B + B * length[:, None] / average))) @ w
                shared = found > 0
                if k is not None:
                    found = np.floor(found * 1e6 + 0.5) / 1e6
                    shared &= found >= least
                row, q = np.nonzero(shared)
                if not len(row):
                    continue
                mine = own.take(pa.array(at + row))
                if k is None:
                    yield pa.RecordBatch.from_pydict({"q": pa.array(q.astype(np.int32)), "id": mine, "score": pa.array(found[row, q])})
                    continue
                new = q, np.asarray(mine), found[row, q]
                held = best(*(np.concatenate(x) for x in zip(held, new, strict=True))) if held else best(*new)
                n = np.bincount(held[0], minlength=len(least))
                least[n >= k] = held[2][np.cumsum(n)[n >= k] - 1]
        pa.default_memory_pool().release_unused()
        if held:
            yield pa.RecordBatch.from_pydict({"q": pa.array(held[0].astype(np.int32)), "id": pa.array(held[1], own.type), "score": pa.array(held[2])})

    found = rows.mapInArrow(score, T.StructType([T.StructField("q", T.IntegerType()), *out.fields[1:]]))
    names = spark.createDataFrame([(i, q) for q, i in ids.items()], T.StructType([T.StructField("q", T.IntegerType()), out.fields[0]]))
    return found.join(F.broadcast(names), "q").select("query_id", "id", "score")  # at most MOST_ASKED rows


def top_k(scored: DataFrame, k: int, by: str | None = None, id_col: str = "id") -> DataFrame:
    """The k best rows by rounded score, ties by id; of each group ``by`` with ranks."""
    rows = scored.withColumn("score", F.round("score", 6))
    if by is None:
        return rows.orderBy(F.desc("score"), id_col).limit(k)
    w = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(near: DataFrame, found: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, score): alpha x vector similarity + (1 - alpha) x text score over the best one; a side that lacks an id adds 0.

    ``near`` has (id, distance), ``found`` (id, score). An alpha outside [0, 1] counts as a half.
    """
    alpha = alpha if 0 <= alpha <= 1 else 0.5
    best = found.agg(F.max("score").alias("best"))
    v = near.select("id", (alpha * vectors.score(F.col("distance"))).alias("part"))
    t = found.crossJoin(F.broadcast(best)).select("id", F.when(F.col("best") > 0, (1 - alpha) * F.col("score") / F.col("best")).otherwise(0.0).alias("part"))
    return v.unionByName(t).groupBy("id").agg(F.sum("part").alias("score"))


def hybrid(nodes: DataFrame, query: list[float] | None, words: str | None, k: int, alpha: float = 0.5, allowed: DataFrame | None = None, metric: str = "cosine", column: str | None = None, language: str | None = None) -> DataFrame:
    """(id, score): the search with all its parts, over nodes (id, vector, text...).

    ``allowed`` (id) restricts both sides before they're cut to k. Without a
    vector, or with a zero one, the text score alone ranks, unscaled; without
    words the vector alone does.
    """
    column = column or text_field(nodes)
    if allowed is not None:
        kept = nodes.join(small(allowed.select("id").distinct()), "id", "left_semi")
    else:
        kept = nodes
    found = None
    if words:
        asked = nodes.sparkSession.createDataFrame([(0, words)], "query_id int, text string")
        found = bm25(nodes, asked, "id", column, language).select("id", "score")
        found = found if allowed is None else found.join(kept.select("id"), "id", "left_semi")
    if query is None or not any(query):
        if found is None:
            raise ValueError("a search needs a vector or words")
        return top_k(found, k)
    near = vectors.knn(kept.select("id", "vector"), query, k, metric, "vector", "id").select("id", "distance")
    if found is None:
        return top_k(near.select("id", vectors.score(F.col("distance")).alias("score")), k)
    return top_k(fuse(near, found, alpha), k)


LAYER_WEIGHTS = {"semantic": 0.5, "episodic": 0.4, "procedural": 0.1}


def layer_rerank(ranked: DataFrame, weights: Mapping[str, float] = LAYER_WEIGHTS, limit: int | None = None) -> DataFrame:
    """Rows (id, memory_layer, rank) reordered by their layer's weight, then by rank, as new_rank."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = F.coalesce(table[F.coalesce("memory_layer", F.lit("episodic"))], F.lit(0.0))
    # one result list, so one partition is enough
    out = ranked.withColumn("weight", weight).withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("weight"), "rank")))
    return out if limit is None else out.filter(F.col("new_rank") <= limit)
