"""Queries over vectors, filters and text, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.catalog import NOW, cut, read, seconds, small
from stratamem.functions import text
from stratamem.functions.words import ENGLISH_SAFE, NEGATIVE, POSITIVE, PROTECTED
from stratamem.operators import filters, memory, rag, scoring, search, vectors
from stratamem.registry import query
from stratamem.sources import loaders

_COS = "round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0"
_Q = "q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0)"
_NEAR = f"{_Q}, near AS (SELECT vec_id, label, {_COS} AS distance FROM (SELECT vec_id, label, embedding::DOUBLE[] AS a, b FROM embeddings, q))"
_PAIRS = f"v AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings), pairs AS (SELECT query_id, neighbor_id, {_COS} AS distance FROM (SELECT x.vec_id AS query_id, y.vec_id AS neighbor_id, x.a, y.a AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id))"


def _knn(spark: SparkSession, d: str, k: int = 10, metric: str = "cosine", where: str | None = None) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = vectors.vector_of(e, 0)
    return vectors.knn(filters.where(e, where) if where else e, q, k, metric)


@query("knn_cosine", f"WITH {_NEAR} SELECT vec_id, distance, round(1 / (1 + distance), 6) AS similarity FROM near ORDER BY distance, vec_id LIMIT 10")
def knn_cosine(spark, d):
    return _knn(spark, d).select("vec_id", "distance", "similarity")


@query("knn_euclidean", f"WITH {_Q} SELECT vec_id, round(pow(list_distance(embedding::DOUBLE[], b), 2), 6) + 0 AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10")
def knn_euclidean(spark, d):
    return _knn(spark, d, metric="euclidean").select("vec_id", "distance")


@query("knn_filtered", f"WITH {_NEAR} SELECT vec_id, label, distance, round(1 / (1 + distance), 6) AS similarity FROM near WHERE NOT coalesce(label = 3, false) ORDER BY distance, vec_id LIMIT 10")
def knn_filtered(spark, d):
    """The ten nearest to vector 0 among those whose label isn't 3."""
    return _knn(spark, d, where="label != 3").select("vec_id", "label", "distance", "similarity")


@query("knn_batch_selfjoin", f"WITH {_PAIRS} SELECT * FROM (SELECT query_id, neighbor_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, distance FROM pairs) WHERE rank <= 5")
def knn_batch_selfjoin(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.knn_batch(e, e, 5)


@query("vector_normalize", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(a[i] / sqrt(list_dot_product(a, a)), 6) + 0 AS x FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS i FROM v)")
def vector_normalize(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalize(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("centroid_by_label", "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(a[i]), 6) + 0 AS x, count(*) AS members FROM (SELECT label, embedding::DOUBLE[] AS a, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i")
def centroid_by_label(spark, d):
    c = vectors.centroid(read(spark, d, "embeddings"), ["label"])
    return c.select("label", "members", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


_MAGNITUDE = "x AS (SELECT vec_id, label, i - 1 AS pos, a[i] AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS a, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT abs(x) AS m FROM x ORDER BY m LIMIT 1 OFFSET (SELECT least(CAST(floor(count(*) * CAST(0.999 AS DOUBLE)) AS BIGINT), count(*) - 1) FROM x))"
_QUANT = "round(greatest(least(x / m * 127, 127), -127))"


@query("quantize_int8", f"WITH {_MAGNITUDE} SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST({_QUANT} AS INTEGER) AS q FROM x, m")
def quantize_int8(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.quantize(F.col("embedding"), vectors.train_quantizer(e))).alias("pos", "q")).withColumn("q", F.col("q").cast("int"))


@query("quantize_roundtrip_error", f"WITH {_MAGNITUDE} SELECT label, round(avg(abs(x - {_QUANT} / 127 * m)), 6) AS mean_error, round(max(abs(x - {_QUANT} / 127 * m)), 6) AS max_error FROM x, m GROUP BY label")
def quantize_roundtrip_error(spark, d):
    e = read(spark, d, "embeddings")
    m = vectors.train_quantizer(e)
    back = vectors.dequantize(vectors.quantize(F.col("embedding"), m), m)
    each = e.select("label", F.explode(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b))).alias("x"))
    return each.groupBy("label").agg(F.round(F.avg("x"), 6).alias("mean_error"), F.round(F.max("x"), 6).alias("max_error"))


@query("half_precision_error")
def half_precision_error(spark, d):
    rows = vectors.half(read(spark, d, "embeddings"))
    return rows.select("vec_id", F.round(vectors.squared_euclidean(F.col("embedding"), F.col("half")), 9).alias("error"))


# filters


@query("filter_eq", "SELECT doc_id FROM documents WHERE coalesce(lang = 'en', false)")
def filter_eq(spark, d):
    return filters.where(read(spark, d, "documents").select("doc_id", "lang"), "lang = 'en'").select("doc_id")


@query("filter_range", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 1000")
def filter_range(spark, d):
    return filters.where(read(spark, d, "part"), "p_size >= 10 AND p_size < 20 AND p_retailprice > 1000").select("p_partkey", "p_size", "p_retailprice")


@query("filter_neq_missing", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def filter_neq_missing(spark, d):
    both = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return filters.where(both, "quality != 1").select("doc_id")


@query("filter_and_or", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 OR c_mktsegment = 'MACHINERY' AND c_acctbal < 0")
def filter_and_or(spark, d):
    return filters.where(read(spark, d, "customer"), "c_mktsegment = 'BUILDING' and c_acctbal > 5000 OR c_mktsegment = 'MACHINERY' AND c_acctbal < 0").select("c_custkey")


@query("filter_array_contains", "SELECT doc_id FROM documents WHERE list_contains([lang, source], 'de')")
def filter_array_contains(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return filters.where(rows, "tags = 'de'").select("doc_id")


@query("filter_json_leaf", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def filter_json_leaf(spark, d):
    rows = read(spark, d, "events").select("event_id", filters.json_leaf(F.col("props"), "k", "double").alias("k"))
    return filters.where(rows, "k > 50")


@query("node_page_keyset", "SELECT doc_id, lang, source FROM documents WHERE doc_id >= 100 ORDER BY doc_id LIMIT 50")
def node_page_keyset(spark, d):
    return memory.page(read(spark, d, "documents").select("doc_id", "lang", "source"), 100, 50, "doc_id")


@query("node_page_offset", "SELECT doc_id, lang, (SELECT count(*) FROM documents) AS total_count, (SELECT count(*) FROM documents) > 50 AS has_more FROM documents ORDER BY doc_id LIMIT 30 OFFSET 20")
def node_page_offset(spark, d):
    return memory.offset_page(read(spark, d, "documents").select("doc_id", "lang"), 20, 30, "doc_id").withColumn("total_count", F.col("total_count").cast("bigint"))


@query("multi_get", "SELECT c_custkey, c_name, CAST(ord AS INTEGER) AS ord FROM customer JOIN (VALUES (7, 0), (3, 1), (11, 2), (-1, 3)) AS w(k, ord) ON k = c_custkey")
def multi_get(spark, d):
    return memory.many(read(spark, d, "customer"), [7, 3, 11, -1], "c_custkey").select("c_custkey", "c_name", "ord")


# text

_TOKENS = r"t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}0-9_]+') AS w FROM documents WHERE text IS NOT NULL)"


@query("text_tokenize", f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_n FROM t")
def text_tokenize(spark, d):
    t = text.tokens("text")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("distinct_n"))


@query("text_term_stats", f"WITH {_TOKENS}, f AS (SELECT doc_id, unnest(w) AS token FROM t) SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM f GROUP BY token")
def text_term_stats(spark, d):
    p = search.postings(read(spark, d, "documents"))
    return p.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_BM25 = rf"""{_TOKENS}, stats AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t), f AS (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM t),
tf AS (SELECT doc_id, l, token, count(*) AS tf FROM f GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}0-9_]+')) AS token FROM benchmark),
scored AS (SELECT query_id, doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) AS score FROM asked JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL)"""


def _benchmark(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_search", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM scored WHERE query_id = (SELECT min(item_id) FROM benchmark) ORDER BY score DESC, id LIMIT 10")
def bm25_search(spark, d):
    """The ten best documents for the first benchmark passage."""
    asked = _benchmark(spark, d).orderBy("query_id").limit(1)
    return search.top_k(search.bm25(read(spark, d, "documents"), asked, k=10), 10).select("id", "score")


@query("bm25_batch", f"WITH {_BM25} SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5")
def bm25_batch(spark, d):
    return search.top_k(search.bm25(read(spark, d, "documents"), _benchmark(spark, d), k=5), 5, "query_id")


@query("bm25_stemmed")
def bm25_stemmed(spark, d):
    docs = read(spark, d, "documents").filter("lang = 'en'")
    return search.top_k(search.bm25(docs, _benchmark(spark, d), language="english", k=5), 5, "query_id")


@query("rag_rank_score", f"WITH {_BM25}, r AS (SELECT query_id, id, round(score, 6) AS s FROM scored) SELECT query_id, id, rank, round(CAST(greatest(0.1, 1 - 0.1 * rank) AS DOUBLE), 6) AS score FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS INTEGER) AS rank FROM r) WHERE rank < 5")
def rag_rank_score(spark, d):
    top = search.top_k(search.bm25(read(spark, d, "documents"), _benchmark(spark, d), k=5), 5, "query_id")
    return rag.ranked_sources(top, [F.desc("score"), F.col("id")], "query_id").select("query_id", "id", "rank", "score")


_DROPPED = ", ".join(f"'{w}'" for w in sorted(ENGLISH_SAFE - PROTECTED))


@query("text_compress", rf"SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}''-]+'), lambda w: lower(w) NOT IN ({_DROPPED})), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def text_compress(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(text.compress("text")).alias("digest"))


@query("text_density", f"WITH {_TOKENS} SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_distinct(w)) / len(w), 6) END AS density FROM t")
def text_density(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.round(text.density("text"), 6).alias("density"))


_SENTIMENT = " + ".join([*(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in POSITIVE), *(f"CASE WHEN contains(lower(text), '{w}') THEN -1 ELSE 0 END" for w in NEGATIVE)])


@query("text_sentiment", f"SELECT doc_id, CAST({_SENTIMENT} AS INTEGER) AS sentiment FROM documents")
def text_sentiment(spark, d):
    return read(spark, d, "documents").select("doc_id", text.sentiment("text", list(POSITIVE), list(NEGATIVE)).alias("sentiment"))


@query("text_token_estimate", "SELECT doc_id, CAST(strlen(text) // 4 AS INTEGER) AS tokens FROM documents")
def text_token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


@query("text_slug", "SELECT p_partkey, 'entity:' || replace(regexp_replace(trim(lower(p_name)), '[\"'']', '', 'g'), ' ', '_') AS slug FROM part")
def text_slug(spark, d):
    return read(spark, d, "part").select("p_partkey", text.slug("p_name").alias("slug"))


@query("chunk_fixed", "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substring(text, i * 150 + 1, 200)) AS digest FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 149) // 150)) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, d):
    c = rag.chunks(read(spark, d, "documents"), text.fixed_chunks("text", 200, 50))
    return c.select(F.col("doc").alias("doc_id"), "chunk_index", F.md5("content").alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return rag.recursive(read(spark, d, "documents"), 500, 50)


@query("stem_english")
def stem_english(spark, d):
    words = read(spark, d, "documents").filter("lang = 'en'").select(F.explode(text.tokens("text")).alias("word")).distinct()
    return words.withColumn("stem", text.stem("english")("word"))


@query("stem_italian")
def stem_italian(spark, d):
    words = read(spark, d, "documents").select(F.explode(text.tokens("text")).alias("word")).distinct()
    return words.withColumn("stem", text.stem("italian")("word"))


@query("page_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis') AS h FROM pages), b AS (SELECT page_id, regexp_replace(h, '<[^>]*>', ' ', 'gs') AS h FROM a)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM b""")
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(loaders.html_text("html")).alias("digest"))


# hybrid ranking


@query("hybrid_fusion", rf"""WITH {_Q}, nodes AS (SELECT doc_id, text, embedding::DOUBLE[] AS a FROM documents JOIN embeddings ON doc_id = vec_id),
near AS (SELECT doc_id AS id, {_COS} AS distance FROM nodes, q ORDER BY distance, id LIMIT 10),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}0-9_]+') AS w FROM nodes WHERE text IS NOT NULL), stats AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t), f AS (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM t),
tf AS (SELECT doc_id, l, token, count(*) AS tf FROM f GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
asked AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}0-9_]+')) AS token FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
found AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))) AS score FROM asked JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL),
parts AS (SELECT id, 0.5 / (1 + distance) AS part FROM near UNION ALL SELECT id, 0.5 * score / (SELECT max(score) FROM found) FROM found)
SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def hybrid_fusion(spark, d):
    """Documents that have a vector, ranked by vector 0 and the first benchmark passage alike."""
    e = read(spark, d, "embeddings")
    nodes = read(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), "text", F.col("embedding").alias("vector"))
    words = _benchmark(spark, d).orderBy("query_id").first()["text"]
    return search.hybrid(nodes, vectors.vector_of(e, 0), words, 10)


@query("search_with_scores", f"WITH {_NEAR}, k AS (SELECT vec_id, round(1 / (1 + distance), 6) AS similarity, CASE WHEN vec_id <= 0 THEN 1 ELSE round(pow(2, -(vec_id * 3600.0) / 259200), 6) END AS decay_factor FROM near ORDER BY distance, vec_id LIMIT 20) SELECT vec_id, similarity, decay_factor, round(similarity * decay_factor, 6) AS score FROM k")
def search_with_scores(spark, d):
    """The twenty nearest to vector 0, each id an hour older than the one before."""
    e = read(spark, d, "embeddings").withColumn("created_at", F.lit(float(NOW)) - F.col("vec_id") * 3600)
    return scoring.search_with_scores(e, vectors.vector_of(e, 0), 20, 72 * 3600, NOW)


_LAYER = "CASE label % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' ELSE 'procedural' END"


@query("layer_reweight", f"WITH {_NEAR}, r AS (SELECT vec_id AS id, {_LAYER} AS memory_layer, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM near QUALIFY rank <= 20) SELECT id, memory_layer, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY CASE memory_layer WHEN 'semantic' THEN 0.5 WHEN 'episodic' THEN 0.4 ELSE 0.1 END DESC, rank) AS INTEGER) AS new_rank FROM r")
def layer_reweight(spark, d):
    near = rag.ranked_sources(_knn(spark, d, 20), [F.col("distance"), F.col("vec_id")]).select(F.col("vec_id").alias("id"), F.expr(_LAYER).alias("memory_layer"), (F.col("rank") + 1).alias("rank"))
    return search.layer_rerank(near).select("id", "memory_layer", "rank", "new_rank")


_CACHE = f"{_PAIRS}, live AS (SELECT vec_id FROM embeddings WHERE label < 5 AND vec_id < 240)"


@query("semantic_cache_lookup", f"WITH {_CACHE}, r AS (SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs JOIN live ON neighbor_id = vec_id) SELECT query_id, neighbor_id, distance FROM r WHERE rank = 1 AND distance < 0.7")
def semantic_cache_lookup(spark, d):
    """Every vector looked up in a cache of those with a label under 5, each id six minutes older, kept for a day."""
    e = read(spark, d, "embeddings")
    cache = filters.where(e, "label < 5").withColumn("created_at", F.lit(float(NOW)) - F.col("vec_id") * 360)
    return rag.cache_lookup(e, cache, NOW, 0.7)


_ERROR = r"(?i)(?:error)|(?:\bpassword\b)|(?:ignore (all )?previous)|(?:how (do|can) i)"


@query("firewall_regex", f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{_ERROR}')")
def firewall_regex(spark, d):
    patterns = ["error", r"\bpassword\b", "ignore (all )?previous", "how (do|can) i"]
    return read(spark, d, "conversations").filter(rag.blocked("text", patterns)).select("conv_id", "turn")


@query("rag_chunk_chain", """WITH c AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id) AS last FROM (SELECT doc_id, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents WHERE length(text) > 0))
SELECT doc_id || '_' || i AS source, doc_id || '_' || (i + 1) AS target, 'next' AS rel FROM c WHERE i < last UNION ALL SELECT doc_id || '_' || i, doc_id || '_' || (i - 1), 'prev' FROM c WHERE i > 0
UNION ALL SELECT doc_id || '_' || i, 'doc:' || doc_id, 'parent' FROM c UNION ALL SELECT 'doc:' || doc_id, doc_id || '_' || i, 'child' FROM c""")
def rag_chunk_chain(spark, d):
    return rag.chunk_edges(rag.chunks(read(spark, d, "documents"), text.fixed_chunks("text", 500)))


@query("rag_context_budget")
def rag_context_budget(spark, d):
    """Prompts of at most 4096 tokens from the documents that rank best for each benchmark passage."""
    docs = read(spark, d, "documents")
    top = cut(search.top_k(search.bm25(docs, _benchmark(spark, d), k=5), 5, "query_id").select("query_id", F.col("id").alias("doc"), "score"))
    found = docs.join(small(top.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    pieces = rag.chunks(found, text.fixed_chunks("text", 1000)).withColumn("tokens", text.token_estimate("content")).select("doc", "chunk_index", "tokens")
    return rag.context(pieces.join(top, "doc"))
