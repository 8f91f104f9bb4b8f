"""The engine's verbs end to end, and approximate search against exact."""

import time

import numpy as np
from pyspark.sql import functions as F

from stratamem.engine import Memory
from stratamem.operators import ann, vectors

DAY = 86_400


def test_memory_verbs(spark, tmp_path):
    m = Memory.create(spark)
    said = [("a", "the cat likes fish", "note"), ("b", "dogs like long walks", "note"), ("c", "fish swim in the sea", "fact"), ("home", None, "entity")]
    m.add(spark.createDataFrame(said, "id string, content string, type string"), 100.0)
    m.link(spark.createDataFrame([("home", "a", "has", 1.0), ("home", "b", "has", 1.0)], "source string, target string, rel string, weight double"), 10)
    assert [r.id for r in m.recall("fish", 3, 100.0).collect()][:2] in (["a", "c"], ["c", "a"])
    assert [r.id for r in m.recall("fish", 3, 100.0, where="type = 'note'").collect()][0] == "a"
    assert {r.id for r in m.recall("like", 3, 100.0, root="home", rels=["has"]).collect()} <= {"a", "b", "home"}
    assert [r.id for r in m.filter("type != 'note'").collect()] == ["c", "home"]
    m.link(spark.createDataFrame([("home", "a", "has", 2.0), ("home", "b", "has", 1.0)], "source string, target string, rel string, weight double"), 20)
    assert sorted((r.target, r.weight, r.created_at, r.deleted_at) for r in m.edges.collect()) == [("a", 1.0, 10, 20), ("a", 2.0, 20, 0), ("b", 1.0, 10, 0)]
    m.evolve(spark.createDataFrame([("a", "the cat likes milk", "new")], "id string, content string, reason string"), 30)
    assert [r.node for r in m.history("a").orderBy("step").collect()] == ["a", "evolved_a_30"]
    assert "a" not in {r.id for r in m.recall("cat", 5, 100.0).collect()}
    m.delete(spark.createDataFrame([("b",)], "id string"), 40)
    assert m.stats().first()["nodes"] == 4
    assert m.belief("cat milk", 200.0).first()["n"] >= 1
    assert m.compile("entity_card", 200.0).filter("entity = 'home' and field = 'connection_count'").count() == 1
    m.save(f"{tmp_path}/snap")
    assert Memory.load(spark, f"{tmp_path}/snap").get(["c", "nobody"]).count() == 1


def test_ivf_recall(spark):
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(c, 0.2, (100, 8)) for c in np.eye(8)[:4] * 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    index = ann.IvfIndex(df, cells=8)
    exact = vectors.knn_batch(df, df, 5)
    assert ann.recall(index.search(df, 5, probe=3), exact) >= 0.9
    assert ann.recall(index.search(df, 5, probe=8), exact) == 1.0


def test_ivf_with_the_query_parameters(spark):
    x = np.random.default_rng(3).normal(size=(300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    assert ann.recall(ann.IvfIndex(df, 16).search(df, 10, 8), vectors.knn_batch(df, df, 10)) >= 0.99


def test_ivf_equals_brute_force_in_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 11)
    x = np.random.default_rng(5).normal(size=(120, 8))
    x[7], x[30], x[31], x[90:95] = 0, x[32], x[32], x[40]
    df = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "vec_id string, embedding array<double>")
    rows = lambda f: sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in f.collect())
    got = rows(ann.IvfIndex(df, 6).search(df, 4, 1))
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    far = np.round(1 - unit @ unit.T, 6) + 0.0
    want = sorted((f"n{i}", r, name, d) for i in range(120) for r, (d, name) in enumerate(sorted((far[i, j], f"n{j}") for j in range(120) if j != i)[:4], 1))
    assert got == want == rows(vectors.knn_batch(df, df, 4))


def test_ivf_of_many_vectors_is_quick(spark):
    g = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(6000, 32)))], "vec_id int, embedding array<double>")
    began = time.time()
    assert ann.IvfIndex(df, 16).search(df, 10, 8).count() == 60_000 and time.time() - began < 60


def test_exact_batch_search_has_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    g = np.random.default_rng(2)
    x = g.normal(size=(70, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in vectors.knn_batch(df, df, 3, "euclidean").collect()}
    for i in range(70):
        want = sorted((round(float(((x[i] - y) ** 2).sum()), 6), j) for j, y in enumerate(x) if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in want]
    assert df.select(vectors.normalize(F.array(F.lit(0.0))).alias("z")).first().z == [0.0]
