"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its results in special cases."""

import random
import zlib
from fractions import Fraction
from math import floor
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from stratamem.llm import bpe, kernel as K, knn, licenses, line_dedup, media, mixing, near_dedup, quality, token_blocks, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with names the operators use, beside the documents' own.
EXTRA = ", rid bigint, keep string, found_in string, quality_score string, copies int, n int, token_ids string, decoded string, copy string, removed int"
rng = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tre", "su") for b in ("ran", "vel", "dor", "pin", "sto") for c in ("a", "en", "is", "or", "um")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, extra=True, ids=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        row = (i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None if t is None else len(t))
        rows.append(row + ((7, "k", "f", "q", 3, 4, "t", "d", "c", 9) if extra else ()))
    return spark.createDataFrame(rows, SCHEMA + (EXTRA if extra else ""))


ODD = [None, "", " ", "\n\n", "ü", "a b c", "x" * 200_000, "a b c", ("word " * 50_000).strip()]


# 1


def weighted_jaccard(a, b, table):
    def bag(text):
        _, h, n = near_dedup.terms(next(K.chunks(pa.array([text]))))
        return dict(zip(h.tolist(), (n * near_dedup.idf(table, h)).tolist()))

    x, y = bag(a), bag(b)
    keys = x.keys() | y.keys()
    total = sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / total if total else 0


def test_near_dedup_against_all_pairs(spark):
    texts = []
    for g in range(12):
        base = prose(120, g).split()
        for change in (0, 3, 8, 14):
            words = list(base)
            for _ in range(change):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    docs = frame(spark, texts)
    table = near_dedup.idf_table(docs.select("doc_id", "text"))
    got = {r.doc_id: r.kept_id for r in near_dedup.near_duplicates(docs).collect()}
    comp = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if weighted_jaccard(texts[i], texts[j], table) >= near_dedup.THRESHOLD]
    for _ in texts:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    want = {i: c for i, c in enumerate(comp) if c != i}
    assert len(want) > 20
    assert sum(got.get(i) == c for i, c in want.items()) >= 0.9 * len(want)
    assert all(comp[i] == comp[c] for i, c in got.items())


def test_near_dedup_special_cases(spark):
    docs = frame(spark, [*ODD, prose(40, 1), prose(40, 1)], ids=[*range(9), 20, None])
    got = {(r.doc_id, r.kept_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(7, 5)}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    twice = frame(spark, ["a b c d", "e f g h"], ids=[1, 1])
    assert [r.text for r in near_dedup.drop_near_duplicates(twice).collect()] == ["e f g h"]


def test_near_dedup_of_very_long_repeated_texts(spark):
    """A shingle of every document, and more shingles than counters: no weight is below 1."""
    text = " ".join(f"w{i}" for i in range(200_000))
    docs = frame(spark, [text] * 10, extra=False)
    table = near_dedup.idf_table(docs.select("doc_id", "text"))
    assert float(table.min()) >= 1
    assert sorted((r.doc_id, r.kept_id) for r in near_dedup.near_duplicates(docs).collect()) == [(i, 0) for i in range(1, 10)]


def test_near_dedup_frequencies_are_nearly_exact(spark):
    """More distinct shingles than counters, and one in all documents: the first are taken as rare, the second as frequent."""
    texts = [f"common phrase here w{i} " + " ".join(f"x{i}y{k}" for k in range(3000)) for i in range(500)]
    table = near_dedup.idf_table(frame(spark, texts, extra=False).select("doc_id", "text"))
    _, h, _ = near_dedup.terms(next(K.chunks(pa.array([texts[7]]))))
    found = near_dedup.idf(table, h)
    assert found.min() < 1.05 and abs(np.median(found) - (np.log(501 / 2) + 1)) < 0.3


def test_near_dedup_buckets_of_several_groups(spark, monkeypatch):
    """With short bands many documents of different groups share buckets, so later leads and pairs decide; the groups are those of all pairs."""
    monkeypatch.setattr(near_dedup, "LEADS", 2)
    r = random.Random(2)
    common, texts = prose(60, 77).split(), []
    for g in range(6):
        own = prose(50, 100 + g).split()
        for _ in range(6):
            words = common + own
            for _ in range(12):
                words[r.randrange(len(words))] = r.choice(WORDS)
            texts.append(" ".join(words))
    r.shuffle(texts)
    docs = frame(spark, texts, extra=False)
    table = near_dedup.idf_table(docs.select("doc_id", "text"))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(texts[i], texts[j], table) >= near_dedup.THRESHOLD and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if x == old else x for x in group]
    got = {x.doc_id: x.kept_id for x in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: g for i, g in enumerate(group) if g != i}


def test_near_dedup_workers_give_memory_back(monkeypatch):
    """After its last batch each kernel has Arrow's pool released, once: idle workers share the executor's memory with the joins."""
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(1)))
    table = SimpleNamespace(value=np.ones((near_dedup.SKETCHES, near_dedup.DF_BUCKETS), np.float32))
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c", "d e f"]})
    pairs = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "text_a": ["a b c"], "text_b": ["a b c"]})
    for kernel, batch in ((near_dedup._count_slices, docs), (near_dedup._signer(table), docs), (near_dedup._verifier(table), pairs)):
        released.clear()
        assert sum(b.num_rows for b in kernel(iter([batch]))) and released == [1]


# 2


def test_token_blocks_round_trip(spark):
    texts = [*ODD, prose(6000, 2), "aaa " * 3000]
    docs = frame(spark, texts)
    blocks = token_blocks.encode_blocks(docs)
    coder = bpe.coder()
    back = {r.doc_id: r.token_ids for r in token_blocks.decode_documents(blocks.filter("n_tokens is not null")).collect()}
    assert back == {i: coder.encode(t) for i, t in enumerate(texts) if t is not None}
    null = blocks.filter("doc_id = 0").collect()
    assert [(r.n_tokens, r.payload, r.crc32) for r in null] == [(None, None, None)]
    assert blocks.filter("n_tokens > 4096").count() == 0 and blocks.filter("block > 0").count() > 0
    assert token_blocks.encode_blocks(docs.limit(0)).count() == 0


def test_token_blocks_of_repeated_doc_ids(spark):
    docs = frame(spark, ["one two", "three four five", "one two", None], ids=[1, 1, 1, 1])
    back = token_blocks.decode_documents(token_blocks.encode_blocks(docs)).collect()
    want = [None] + [tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={}).encode_ordinary(t) for t in ("one two", "three four five")]
    assert sorted((r.token_ids or [] for r in back)) == sorted(w or [] for w in want) and {r.doc_id for r in back} == {1}


def test_token_blocks_of_any_ids():
    r = np.random.default_rng(3)
    blocks = [r.integers(0, 2**31, 300), np.array([2**31 - 1, 0, 65535, 65536, 131072] * 9), np.zeros(0, int), np.zeros(4096, int), np.array([5]), np.array([5, 6]), *(r.integers(0, 40, n) for n in (3, 4, 5, 8, 9, 33, 65, 4096, 4095)), r.zipf(1.3, 4096) % 60000]
    blocks = [b.astype(np.int32) for b in blocks]
    packed = token_blocks.compress(blocks)
    out = token_blocks.expand(packed, [len(b) for b in blocks], [zlib.crc32(b.tobytes()) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, out))
    # a block's payload doesn't depend on its neighbours
    assert [token_blocks.compress([b])[0] for b in blocks] == packed
    # a constant block costs next to nothing, one of 40 equally likely ids about log2(40) = 5.3 bits each
    assert len(packed[3]) < 60 and 8 * len(packed[13]) / 4096 < 7
    with pytest.raises(ValueError):
        token_blocks.compress([np.zeros(4097, int)])
    with pytest.raises(ValueError):
        token_blocks.compress([np.array([-1])])


def test_token_blocks_cost_less_than_their_parts():
    """Ids with order cost less than half the entropy of single ids."""
    r = np.random.default_rng(8)
    ids = np.tile(r.integers(0, 5000, 600), 7)[:4096].astype(np.int32)
    other = r.random(4096) < 0.02
    ids[other] = r.integers(0, 5000, int(other.sum()))
    size = len(token_blocks.compress([ids])[0])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * size < len(ids) * float(-(share * np.log2(share)).sum()) / 2


def test_token_blocks_compress_and_check():
    ids = np.array([random.Random(1).choice([5, 9, 900, 50000, 9, 9]) for _ in range(5000)], np.int32)
    blocks = [ids[:4096], ids[4096:], np.zeros(0, np.int32), np.full(4096, 65535, np.int32)]
    packed = token_blocks.compress(blocks)
    assert sum(map(len, packed)) < sum(b.nbytes for b in blocks) / 4
    import zlib

    sums = [zlib.crc32(b.tobytes()) for b in blocks]
    out = token_blocks.expand(packed, [len(b) for b in blocks], sums)
    assert all((a == b).all() for a, b in zip(out, blocks))
    with pytest.raises(ValueError):
        token_blocks.expand(packed, [len(b) for b in blocks], [s + 1 for s in sums])


# 3


def test_quality_on_held_out_rows(spark):
    r = random.Random(3)
    good = [". ".join(prose(12, i * 100 + j).capitalize() for j in range(6)) + "." for i in range(150)]
    bad = ["".join(r.choice("#$%| \nABCDE!!! 0123") for _ in range(300)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, labels), "q").filter("doc_id >= 200").select("doc_id", "q").collect()
    assert len(scored) == 100
    assert sum((s.q >= 0.5) == (s.doc_id % 2 == 0) for s in scored) >= 95


def test_quality_special_cases(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    kept = quality.reject_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert quality.reject_low_quality(docs.limit(0), labels).count() == 0


def test_trees_follow_each_row():
    g = np.random.default_rng(1)
    x = g.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y)
    one = []
    for row in x:
        total = trees.base
        for k in range(len(trees.feature)):
            i = 0
            while trees.feature[k, i] >= 0:
                i = 2 * i + 1 + int(row[trees.feature[k, i]] > trees.cut[k, i])
            total += trees.value[k, i]
        one.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.score(x), one)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


# 4


def test_token_counts_against_lists(spark):
    docs = frame(spark, [*ODD, *[prose(n % 37, n) for n in range(60)]])
    hist = token_counts.histogram(docs)
    coder = bpe.coder()
    lengths = [len(coder.encode(r.text or "")) for r in docs.collect()]
    by = {r.length: r for r in hist.collect()}
    cut = {r.context: (r.tokens_kept, r.documents_cut) for r in token_counts.truncated_totals(hist, [0, 10, 10**6]).collect()}
    assert cut == {c: (sum(min(x, c) for x in lengths), sum(x > c for x in lengths)) for c in (0, 10, 10**6)}
    assert token_counts.quantiles(hist, [0.5]).first().length == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.histogram(docs.limit(0)).count() == 0
    assert sorted(by) == sorted(set(lengths))
    for n, r in by.items():
        assert r.documents == lengths.count(n)
        assert r.documents_upto == sum(x <= n for x in lengths)
        assert r.documents_over == sum(x > n for x in lengths)
        assert r.tokens_truncated == sum(min(x, n) for x in lengths)


# 5


def test_bpe_against_the_merge_procedure(spark):
    ranks = bpe.load()
    merges = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.coder()
    r = random.Random(9)
    texts = ["", "a", "  two  spaces  ", "naïve Ünïcode 中文 🎉 words", "x" * 3000, prose(300, 4), "tabs\tand\nlines \n\n  end "]
    texts += ["".join(r.choice("abcdefgh  \n12'éß中") for _ in range(200)) for _ in range(100)]
    stretches = bpe.backtracking()
    for t in texts:
        want = merges.encode_ordinary(t)
        assert coder.encode(t) == want
        assert np.frombuffer(stretches.ids(t), np.int32).tolist() == want


def test_bpe_special_cases(spark):
    docs = frame(spark, ODD)
    rows = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert rows[0].token_ids is None and rows[0].round_trip is None
    assert rows[1].token_ids == [] and all(rows[i].round_trip for i in range(1, 9))
    assert bpe.round_trip(docs.limit(0)).count() == 0
    coded = bpe.encode(docs, ids="ids")
    assert coded.columns == [*docs.columns, "ids"]
    bad = spark.createDataFrame([(1, [10**6])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception):
        bpe.decode(bad, ids="ids").collect()


# 6


def brute_knn(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        far = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 6), j) for j, w in zip(ids, x) if j != i)
        out[i] = [(j, d) for d, j in far[:k]]
    return out


def test_knn_join_against_all_pairs(spark):
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(c, 0.3, (60, 5)) for c in range(4)])
    x[10] = x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, cell string")
    got = {}
    for r in knn.knn_join(df, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    want = brute_knn(range(len(x)), x, 7)
    assert got.keys() == want.keys()
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want)


def test_knn_join_in_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_ROWS", 60)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    g = np.random.default_rng(7)
    # one cell holds a third of the rows, many of them equal
    x = np.concatenate([g.normal(c % 5, 0.2 + c % 3, (50, 4)) for c in range(8)] + [np.repeat(g.normal(9, 0.01, (20, 4)), 10, 0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = brute_knn(range(len(x)), x, 6)
    for asked in (None, F.col("vec_id") % 3 == 0):
        got = {}
        for r in knn.knn_join(df, 6, queries=asked).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
        assert got == {i: w for i, w in want.items() if asked is None or i % 3 == 0}


def test_knn_join_special_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 9.0]), (3, None), (None, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.neighbor_id, r.rank, r.distance) for r in knn.knn_join(df, 10).collect()}
    assert got == {(1, 2, 1, 9.0), (2, 1, 1, 9.0)}
    assert knn.knn_join(df, queries=F.col("vec_id") == 99).count() == 0
    assert knn.knn_join(df.limit(0)).count() == 0 and knn.knn_join(df.filter("vec_id = 1")).count() == 0


# 7


def test_line_dedup_deletes_shared_blocks(spark):
    block = "\n".join(prose(8, 50 + i) for i in range(4))
    other = "\n".join(prose(9, 80 + i) for i in range(3))
    texts = [f"own start\n{block}\nmiddle one\n{other}\nend", f"{other}\nsecond\n{block}", f"third\n{block}\nlast", prose(30, 99), "short line\nown", "short line\nmore"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts), removed="gone", found_in="by").collect()}
    assert [got[i].text for i in range(6)] == [texts[0], "second", "third\nlast", *texts[3:]]
    assert [got[i].gone for i in range(6)] == [0, 7, 4, 0, 0, 0]
    assert got[1].by == [0] and got[2].by == [0] and got[2].n_chars == len("third\nlast")


def test_line_dedup_special_cases(spark):
    docs = frame(spark, [*ODD, prose(30, 1), prose(30, 1), prose(30, 1)], ids=[*range(9), 10, 10, None])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r.text)
    # a NULL doc_id is the first holder, so both rows of document 10 lose the line
    assert rows[None] == [prose(30, 1)] and rows[10] == ["", ""]
    assert all(rows[i] == [ODD[i]] for i in range(9))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_leaves_no_shared_anchor(spark):
    """A long passage goes though more short lines are shared in the other order; blank lines don't part it."""
    passage, menu = prose(60, 31), ["Home", "About", "Contact"]
    parts = [prose(6, 32), prose(6, 33)]
    texts = ["\n".join([passage, *menu]), "\n".join([*menu, passage]), "\n".join(parts), "\n\n".join(parts)]
    got = [r.text for r in line_dedup.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "\n".join(menu), texts[2], ""]
    r = random.Random(9)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 25))] for _ in range(2))
        words = [0 if x == 0 else 3 for x in b]
        gone = set(line_dedup.common_blocks(a, b, words, 10))
        left = ["-" if j in gone else str(x) for j, x in enumerate(b) if x or j in gone]
        runs = {"".join(left[j : j + 4]) for j in range(len(left) - 3)}
        whole = "".join(str(x) for x in a if x)
        assert not any("-" not in x and x in whole for x in runs)


def common_lines(a, b, least):
    """Lines of ``b`` in runs of ``least`` words that ``a`` holds too, lines without words being passed over; by trying all runs."""
    worded = lambda x: any(map(str.isalnum, x))
    one = [tuple(x.split()) for x in a if worded(x)]
    at = [j for j, x in enumerate(b) if worded(x)]
    two = [tuple(b[j].split()) for j in at]
    runs = {tuple(one[i:e]) for i in range(len(one)) for e in range(i + 1, len(one) + 1)}
    return {k for i in range(len(two)) for e in range(i + 1, len(two) + 1) if sum(map(len, two[i:e])) >= least and tuple(two[i:e]) in runs for k in range(at[i], at[e - 1] + 1)}


def test_line_dedup_against_all_earlier_documents(spark):
    """Few, short lines, so that blocks overlap, change order and have tails: what goes is what all earlier documents hold."""
    r = random.Random(12)
    kinds = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((1, 2, 3, 3, 4, 5, 6, 7, 10, 12))] + ["", "--"]
    docs = [[r.choice(kinds) for _ in range(r.randint(1, 9))] for _ in range(160)]
    docs += [[kinds[8]], [kinds[8], kinds[2]], [kinds[8], kinds[2]]]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, ["\n".join(d) for d in docs])).collect()}
    for i, d in enumerate(docs):
        gone = set().union(*(common_lines(o, d, line_dedup.MIN_WORDS) for o in docs[:i])) if i else set()
        # lines without words at a block's edge may go with it
        assert [x for x in got[i].split("\n") if any(map(str.isalnum, x))] == [x for j, x in enumerate(d) if j not in gone and any(map(str.isalnum, x))], i
    assert got[162] == ""


def test_patience_finds_common_subsequences():
    r = random.Random(4)
    for _ in range(50):
        a, b = ([r.randrange(12) for _ in range(r.randrange(30))] for _ in range(2))
        m = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


# 8


def test_licenses_find_and_resolve(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\")"
    texts = [f"/* {apache} */", "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "GNU General\n * Public License version 3", "all about mitosis and bsdiff", "Copyright (c) 2020 someone", "CC BY 4.0"]
    got = {}
    for r in licenses.scan(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.kind))
        assert texts[r.doc_id][r.start : r.end] == r.matched
    assert ("Apache-2.0", "notice") in got[0] and len(got[0]) == 1
    assert got[1] == [("MIT OR Apache-2.0", "tag")]
    assert got[2][0][0] == "GPL-3.0" and 3 not in got and got[5] == [("CC-BY-4.0", "name")] and 4 in got


def test_licenses_resolution_against_pairs():
    r = random.Random(6)
    rules = licenses.rules()
    assert len(rules) >= 200
    for _ in range(200):
        found = []
        for _ in range(r.randrange(12)):
            a = r.randrange(20)
            found.append((a, a + 1 + r.randrange(8), r.choice(rules)))
        kept = []
        for m in sorted(found, key=lambda m: (-m[2].priority, m[0] - m[1], m[0], m[2].number)):
            if not any((s <= m[0] and m[1] <= e) or (m[0] <= s and e <= m[1]) for s, e, _ in kept):
                kept.append(m)
        assert licenses.resolve(found) == sorted(kept, key=lambda m: m[0])


def test_license_keywords_lose_nothing():
    """The two filters find what trying every rule does."""
    texts = ["Released under the MIT license. See LICENSE for details", "dual: gpl-2.0+ or CDDL", "this is BSD 3-clause, © 2019", "cc\nby-sa 4.0"]
    for t in texts:
        every = licenses.resolve([m for rule in licenses.rules() for m in licenses._matches(t, rule)])
        assert licenses.detect(t) == every and every


def example(pattern, r):
    """A text built from a regex's parse tree: random branches, few repeats."""
    from re import _constants as C, _parser
    groups = {}

    def one(items):
        negated = items[0][0] is C.NEGATE

        def holds(c):
            for op, v in items[negated:]:
                if op is C.LITERAL and ord(c) == v or op is C.RANGE and v[0] <= ord(c) <= v[1]:
                    return True
                if op is C.CATEGORY:
                    plain = {C.CATEGORY_SPACE: c.isspace(), C.CATEGORY_DIGIT: c.isdigit(), C.CATEGORY_WORD: c.isalnum() or c == "_"}
                    if plain.get(v, False) or v is C.CATEGORY_NOT_SPACE and not c.isspace():
                        return True
            return False

        fit = [c for c in map(chr, [10, *range(32, 127), *range(160, 1000), *range(8190, 8260)]) if holds(c) != negated]
        return r.choice([c for c in fit if c in " \nab12"] or fit)

    def build(tree):
        out = []
        for op, v in tree:
            if op is C.LITERAL:
                out.append(chr(v))
            elif op in (C.NOT_LITERAL, C.ANY):
                out.append("a")
            elif op is C.IN:
                out.append(one(v))
            elif op is C.BRANCH:
                out.append(build(r.choice(v[1])))
            elif op is C.SUBPATTERN:
                out.append(build(v[3]))
                groups[v[0]] = out[-1]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                out += [build(v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 1)))]
            elif op is C.GROUPREF:
                out.append(groups[v])
            else:
                assert op in (C.AT, C.ASSERT, C.ASSERT_NOT), op
        return "".join(out)

    return build(_parser.parse(pattern.pattern, pattern.flags))


def test_every_license_rule_passes_the_filters():
    for rule in licenses.rules():
        texts = [t for seed in range(40) if rule.pattern.search(t := example(rule.pattern, random.Random(seed)))]
        assert texts and all(rule.number in licenses.tried(t) for t in texts), (rule.number, rule.keywords)
    assert [m[2].license for t in ("see https://scripts.sil.org/OFL", "Tcl/Tk license") for m in licenses.detect(t)] == ["OFL-1.1", "TCL"]


def test_licenses_special_cases(spark):
    docs = frame(spark, [*ODD, "MIT license", "MIT license"], ids=[*range(9), None, None])
    rows = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(None, "MIT")] * 2
    assert licenses.scan(docs.limit(0)).count() == 0


# 9


def pcm(x):
    return (np.clip(np.round(x * 127 + 128), 0, 255)).astype(np.uint8).tobytes()


def test_media_aligns_noisy_excerpts(spark):
    whole = media.synthetic(1, 20)
    noise = np.random.default_rng(3).normal(0, 0.01, len(whole)).astype(np.float32)
    start = 50 * media.HOP
    rows = [(1, pcm(whole)), (2, pcm((whole + noise)[start : start + 6 * media.RATE])), (3, pcm(media.synthetic(2, 8))), (4, pcm(whole))]
    df = spark.createDataFrame(rows, "doc_id bigint, media binary")
    got = {r.doc_id: r for r in media.match(media.fingerprint(df, "media")).collect()}
    assert got[1].matches == [] and got[3].matches == []
    (m,) = got[2].matches
    assert (m.doc_id, m.offset) == (1, -50) and m.bit_error < 0.1 and m.length > 100
    (c,) = got[4].matches
    assert (c.doc_id, c.offset, c.bit_error) == (1, 0, 0.0) and got[4].duration_ms == 20_000


def test_media_items_against_a_plain_version():
    x = media.synthetic(5, 3)
    image, _ = media.chroma(x, np.array([0, len(x)]))
    items, _ = media.fingerprints(x, np.array([0, len(x)]))
    cuts = media.thresholds()
    for at in (0, 7, len(items) - 1):
        value = 0
        for k, f in enumerate(media.FILTERS):
            one, two = (np.concatenate([image[at + a : at + b, c:d].ravel() for a, b, c, d in side]).mean(dtype=np.float64) for side in media._areas(*f))
            level = int((np.log((one + 0.01) / (two + 0.01)) > cuts[:, k]).sum())
            value = value << 2 | int(media._GRAY[level])
        assert value == int(np.uint32(items[at].view(np.uint32)))


def test_media_offset_histogram_against_all_offsets():
    g = np.random.default_rng(8)
    for shift in (-30, 0, 25):
        a = g.integers(-(2**31), 2**31, 80).astype(np.int32)
        b = g.integers(-(2**31), 2**31, 80).astype(np.int32)
        lo, hi = max(0, shift), min(80, 80 + shift)
        b[lo:hi] = a[lo - shift : hi - shift]
        assert media.align(a, b)[:3] == (shift, lo, hi - lo)
    assert media.align(a, g.integers(-(2**31), 2**31, 80).astype(np.int32)) is None


def test_media_waves_and_special_cases(spark):
    import io
    import wave

    x = media.synthetic(4, 2)
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        up = np.repeat(np.interp(np.arange(2 * len(x)) / 2, np.arange(len(x)), x), 2)
        w.writeframes((up * 32000).astype("<i2").tobytes())
    rows = [(1, None), (2, b""), (3, b"a"), (4, b"RIFFxxxxWAVEbroken"), (5, buf.getvalue()), (None, pcm(x)), (6, pcm(x)), (6, pcm(x)), (7, b"\x80" * 60_000), (8, b"\x80" * 60_000)]
    df = spark.createDataFrame([(i, m, "z") for i, m in rows], "doc_id bigint, media binary, digest string")
    out = media.match(media.fingerprint(df, "media")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint is None and by[2].fingerprint == [] and len(by[3].fingerprint) == 1 and len(by[4].fingerprint) == 1
    assert by[5].duration_ms == 2000 and [m.doc_id for m in by[6].matches] == [5]
    assert by[None].matches == [] and [m.doc_id for m in by[8].matches] == [7]
    assert media.match(media.fingerprint(df.limit(0), "media")).count() == 0


def test_media_aligns_all_pairs(spark):
    """Recordings whose common items all have earlier holders, each another one, are aligned with each other too."""
    x, hop = media.synthetic(7, 16), media.HOP
    rows = list(enumerate(map(pcm, (x[: 270 * hop], x[230 * hop :], x, x[10 * hop :], x[20 * hop : 160 * hop], x[40 * hop : 180 * hop]))))
    out = {r.doc_id: {m.doc_id: (m.offset, m.length) for m in r.matches} for r in media.match(media.fingerprint(spark.createDataFrame(rows, "doc_id bigint, media binary"), "media")).collect()}
    assert out[2].keys() == {0, 1} and out[3].keys() == {0, 1, 2} and out[5].keys() == {0, 2, 3, 4}
    assert out[3][2][0] == -10 and out[3][2][1] > 400 and out[5][4][0] == -20


@pytest.mark.parametrize("items", [1 << 20, 300])
def test_media_search_against_all_pairs(spark, monkeypatch, items):
    """About 40 random excerpts with noise, in one block or many: the search gives what aligning every pair gives."""
    monkeypatch.setattr(media, "QUERY_ITEMS", items)
    monkeypatch.setattr(media, "BLOCK_ITEMS", items)
    monkeypatch.setattr(media, "PORTION", 50)
    r = np.random.default_rng(4)
    base = [media.synthetic(40 + i, 6) for i in range(3)]
    rows = []
    for i in range(40):
        x = base[i % 3]
        a = int(r.integers(0, len(x) // 2)) // media.HOP * media.HOP
        part = x[a : a + int(r.integers(4000, len(x) - a))]
        rows.append((i, pcm(part + (r.normal(0, 0.005, len(part)) if i % 4 else 0))))
    rows += [(50 + i, rows[i][1]) for i in (3, 8)]
    prints = media.fingerprint(spark.createDataFrame(rows, "doc_id bigint, media binary"), "media")
    got = {x.doc_id: x for x in media.match(prints, F.col("doc_id") % 2 == 0).collect()}
    assert all((got[i].matches is None) == (i % 2 == 1) for i in got) and (got[53].first, got[53].copies, got[3].first) == (3, 2, 3)
    fp = {i: np.array(x.fingerprint, np.int32) for i, x in got.items()}
    links = 0
    for q in (i for i in fp if i % 2 == 0 and i < 50):
        want = {}
        for o in (o for o in fp if o != q and o < 50):
            if len(set(fp[q].tolist()) & set(fp[o].tolist())) >= media.SHARED and (m := media.align(fp[o], fp[q])):
                want[o] = m[:3]
        assert {m.doc_id: (m.offset, m.start, m.length) for m in got[q].matches} == want
        links += len(want)
    assert links > 100 and 8 in {m.doc_id for m in got[58].matches}
    lists = list(fp.values())
    flat, ptr = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    pairs = [p for i, j in media.candidates(flat, ptr, flat, ptr) for p in zip(i.tolist(), j.tolist())]
    sets = [set(x.tolist()) for x in lists]
    assert sorted(pairs) == [(i, j) for i in range(len(sets)) for j in range(len(sets)) if len(sets[i] & sets[j]) >= media.SHARED]


def test_media_matches_short_recordings(spark):
    x = media.synthetic(9, 0.75)
    rows = [(1, pcm(x)), (2, pcm(x)), (3, pcm(x[:-media.HOP])), (4, pcm(x[:2000])), (5, pcm(x[:2000])), (6, pcm(media.synthetic(10, 0.75)))]
    out = {r.doc_id: r for r in media.match(media.fingerprint(spark.createDataFrame(rows, "doc_id bigint, media binary"), "media")).collect()}
    assert 2 < len(out[3].fingerprint) < len(out[1].fingerprint) < media.SEGMENT and len(out[4].fingerprint) == 1
    assert [(m.doc_id, m.offset) for m in out[2].matches] == [(1, 0)] == [(m.doc_id, m.offset) for m in out[3].matches]
    assert [m.doc_id for m in out[5].matches] == [4] and not out[6].matches and not out[1].matches


# 10


def brute_mix(rows, weights, size):
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    wanted = {s: Fraction(1) if weights is None else Fraction(weights.get(s) or 0) for s in sizes}
    each = {s: w / sum(wanted.values()) * (len(rows) if size is None else size) / sizes[s] for s, w in wanted.items()}
    out, total = {}, {}
    for i, s in sorted(rows):
        a = total.get(s, 0)
        b = total[s] = a + each[s]
        o = Fraction(mixing.offset(), mixing.UNIT)
        out[i] = floor(b + o) - floor(a + o)
    return {i: n for i, n in out.items() if n}


def test_mixing_against_prefix_sums(spark):
    sources = ["a"] * 50 + ["b"] * 7 + ["c"] * 3
    docs = frame(spark, [prose(3, i) for i in range(60)], sources=sources)
    for weights, size in ((None, None), ({"a": 1, "b": 2.5}, 100), ({"a": 0, "b": None, "c": 1}, 10), ({"a": 1, "c": 100_000}, 1_450_000)):
        got = {r.doc_id: r["count"] for r in mixing.sample(docs, weights, size, copy_no="k").groupBy("doc_id").count().collect()}
        assert got == brute_mix(list(enumerate(sources)), weights, size)


def test_mixing_special_cases(spark):
    docs = frame(spark, [*ODD, "same", "same"], ids=[*range(7), None, None, 30, 30], sources=[None, "a", "a", None, "b", "b", "b", "b", "b", "b", "b"])
    assert mixing.sample(docs.withColumn("copy_no", F.lit("x"))).columns == [*docs.columns, "copy_no", "copy_no1"]
    assert mixing.targets(["a", "b"], {"a": float("nan"), "b": 3, "c": 1}, 7) == {"b": 7 * mixing.UNIT}
    # 14.5 of 1,450,014.5 rows: rounded expected copies of each row would lose the source's share
    assert mixing.targets(["a", "b"], {"a": 1, "b": 100_000}, 145_001_450)["a"] == 1450 * mixing.UNIT
    out = mixing.sample(docs, copy_no="k")
    assert out.columns == [*docs.columns, "k"]
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(sum(counts.values()) - 11) <= 3 and all(abs(n - 11 / 3) < 1.01 for n in counts.values()) and None in counts
    assert mixing.sample(docs.limit(0)).count() == 0 and mixing.sample(docs, {"nowhere": 1.0}).count() == 0
