"""The corpus pipeline's stages, one by one and together, on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from stratamem.llm import bpe

from .test_operators import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        text = "\n".join(prose(12, i * 50 + j).capitalize() + "." for j in range(5)) if good else "".join(r.choice("#$%| \nABC!!! 01") for _ in range(200))
        rows.append([i, text])
        labels.append((i, int(good), 0))
    rows[31][1] = rows[4][1]
    shared = "\n".join(rows[7][1].split("\n")[1:4])
    rows[40][1] = f"{shared}\n{rows[40][1]}"
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 5 == 0], len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = seen["quality classifier"]
    assert sum(i % 3 != 0 for i in kept) >= 155 and sum(i % 3 == 0 for i in kept) <= 4
    after = seen["line dedup"]
    assert 31 not in after and 4 in after
    assert after[40] == kept[40].split("\n", 3)[3] and after[7] == kept[7]
    assert seen["near dedup"].keys() <= after.keys() and len(seen["near dedup"]) >= len(after) - 2
    by = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert abs(by["a"] - by["b"]) <= 2
    coder = bpe.coder()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sorted((r.doc_id, r.token_ids) for r in last) == sorted((r.doc_id, coder.encode(r.text)) for r in docs.collect())


def test_run_is_the_stages_in_order(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "source", "n_tokens", "token_ids"]
    assert all(r.n_tokens == len(r.token_ids) for r in out.collect())


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
