"""Line dedup by pairwise alignment.

A line's identity is its sequence of words. For each line of a document the
shortest runs of lines from there on, and up to there, with at least MIN_WORDS
words are its anchors. The anchors inside a common block of that many words cover
all its lines, and both documents have them. Documents that share anchors are
aligned with patience diff, and the aligned common blocks of at least MIN_WORDS
words are deleted from the later document (the one of the greater doc_id).

An anchor that n documents share gives n - 1 pairs, each with the anchor's
first holder: a rare one pairs just the documents that overlap, and a frequent
one costs one alignment per document instead of n**2. That loses nothing, as each
line of a block lies in an anchor, whose first holder is enough to delete it, and
no anchor is left out. After an alignment the lines it didn't delete are aligned
again until nothing is found. A rising chain can miss a block in another order, or
a part of one that overlaps another; where a shared anchor isn't deleted whole,
all common runs of MIN_WORDS words are deleted, as a suffix automaton finds them.
So exactly the lines go that lie in a run of MIN_WORDS words that an earlier
document holds too. The first holder of a block keeps it.

Only fingerprints move in the search: line hashes are shuffled, texts once, to
meet the lists of lines to delete.

Defined results. NULL and empty texts stay as they are. Lines without a word
are deleted only inside a block, or at its edge where they're aligned with it, and
don't part its anchors. Repeats within one document stay. Rows with
the same doc_id and text are one document and get the same result; rows with
the same doc_id and other texts are ordered by a hash of the text. A NULL doc_id
comes before all others. A document that loses all its lines has an empty text.
An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from bisect import bisect_left
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import arrow_safe, cut, fresh, keyed_join, read, saved

#: Words that a common block must have to be deleted.
MIN_WORDS = 10


def _anchors(ln: K.Lines, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the shortest runs of at least ``min_words`` words from each line with words on, and up to each, where the document has one; sorted by document."""
    worded = np.flatnonzero(ln.words > 0)
    total = np.concatenate([[0], np.cumsum(ln.words[worded])])
    ptr = np.searchsorted(worded, ln.ptr)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    i = np.arange(len(worded))
    on_end = np.searchsorted(total, total[:-1] + min_words, "left")
    on = on_end <= ptr[doc + 1]
    up_start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    up = up_start >= ptr[doc]
    first, end = np.concatenate([i[on], up_start[up]]), np.concatenate([on_end[on], i[up] + 1])
    own = np.concatenate([doc[on], doc[up]])
    order = np.argsort(own, kind="stable")
    first, end, own = first[order], end[order], own[order]
    h, span, lines = ln.hash[worded[first]].copy(), end - first, ln.hash[worded]
    for k in range(1, int(span.max()) if len(span) else 0):
        more = np.flatnonzero(span > k)
        h[more] = K.mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + lines[first[more] + k])
    return own, h


def _line_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.chunks(batch.column("text")):
                ln = K.lines(t)
                own, h = _anchors(ln, min_words)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(t.first, t.n), "rid": batch.column("rid").slice(t.first, t.n),
                    "hashes": K.ragged(ln.hash.view(np.int64), ln.ptr, pa.int64()), "words": K.ragged(ln.words.astype(np.int32), ln.ptr, pa.int32()),
                    "anchors": K.ragged(h.view(np.int64), np.searchsorted(own, np.arange(t.n + 1)), pa.int64()),
                })

    return run


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs`` (sorted by the first number) in which the second rises too, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[k], ends[k] = b, i
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that two ranges have in common and that are unique in both; if there are none, the k-th occurrence in one goes with the k-th in the other."""
    at_a: dict[int, list[int]] = {}
    for i in range(a0, a1):
        at_a.setdefault(a[i], []).append(i)
    at_b: dict[int, list[int]] = {}
    for j in range(b0, b1):
        if b[j] in at_a:
            at_b.setdefault(b[j], []).append(j)
    unique = [(at_a[x][0], js[0]) for x, js in at_b.items() if len(js) == 1 and len(at_a[x]) == 1 and x]
    if not unique:
        unique = [p for x, js in at_b.items() for p in zip(at_a[x], js)]
    return sorted(unique)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The matched (line of a, line of b), both rising. Lines of ``b`` below 0 in a masked copy match nothing if ``a`` lacks them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = a0, b0
        for i, j in _rising(_common(a, b, a0, a1, b0, b1)):
            out.append((i, j))
            if i > x and j > y:
                todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        if (x > a0 or y > b0) and x < a1 and y < b1:
            todo.append((x, a1, y, b1))
    return sorted(out)


def _windows(seq: list[int], size: dict[int, int], min_words: int) -> dict[int, int]:
    """Place -> end of the shortest run of at least ``min_words`` words from there; a line without a size parts runs."""
    out, end, n = {}, 0, 0
    for i, x in enumerate(seq):
        if end < i:
            end, n = i, 0
        while n < min_words and end < len(seq) and seq[end] in size:
            n += size[seq[end]]
            end += 1
        if n >= min_words:
            out[i] = end
        if end > i:
            n -= size[x]
    return out


def _longest(a: list[int | None], b: list[int | None]) -> list[int]:
    """For each place of ``b`` the length of the longest run from there on that ``a`` holds; by a suffix automaton, in linear time."""
    link, length, step, last = [-1], [0], [{}], 0
    for x in reversed(a):
        new, p = len(link), last
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] != length[p] + 1:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q], q = twin, twin
            link[new] = q
        last = new
    out, at, n = [0] * len(b), 0, 0
    for j in range(len(b) - 1, -1, -1):
        x = b[j]
        while x is not None and at and x not in step[at]:
            at = link[at]
            n = length[at]
        if x is not None and x in step[at]:
            at, n = step[at][x], n + 1
        else:
            at, n = 0, 0
        out[j] = n
    return out


def _left(a: list[int], b: list[int], words: list[int], found: set[int], min_words: int) -> set[int]:
    """Lines of ``b`` in runs of at least ``min_words`` words that ``a`` holds too, wherever, if ``found`` lacks some of a shared anchor's."""
    size = {x: n for x, n in zip(b, words) if x}
    place = [j for j, x in enumerate(b) if x]
    one, two = [x for x in a if x], [b[j] for j in place]
    for x, y, at in ((one, two, place), (one[::-1], two[::-1], place[::-1])):
        held = {tuple(x[i:end]) for i, end in _windows(x, size, min_words).items()}
        if any(tuple(y[i:end]) in held and not found.issuperset(at[i:end]) for i, end in _windows(y, size, min_words).items()):
            break
    else:
        return set()
    total = [0, *np.cumsum([size[x] for x in two]).tolist()]
    out: set[int] = set()
    done = 0
    for j, n in enumerate(_longest([x if x in size else None for x in one], two)):
        end = j + n
        if end > done and total[end] - total[j] >= min_words:
            out.update(range(place[j], place[end - 1] + 1))
            done = end
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of ``b`` in common blocks with ``a`` of at least ``min_words`` words; ``b`` is aligned again without them until none is left, then searched for what no alignment took."""
    found: set[int] = set()
    masked: list[int | None] = list(b)
    while True:
        new: list[int] = []
        run: list[int] = []
        was = (-2, -2)
        for i, j in [*patience(a, masked), (-9, -9)]:
            if (i, j) != (was[0] + 1, was[1] + 1):
                if sum(words[k] for k in run) >= min_words:
                    new += run
                run = []
            run.append(j)
            was = (i, j)
        if not new:
            return sorted(found | _left(a, b, words, found, min_words))
        found.update(new)
        for j in new:
            masked[j] = None


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(*(row[c] for c in ("other", "hashes", "words")), min_words) for row in batch.select(["other", "hashes", "words"]).to_pylist()]
            ptr = np.concatenate([[0], np.cumsum([len(g) for g in gone])]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column("rid"), "id": batch.column("id"), "lines": pa.array([len(h) for h in batch.column("hashes")], pa.int32()),
                "gone": K.ragged(np.array([j for g in gone for j in g], np.int32), ptr, pa.int32()),
            })

    return run


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ptr = np.concatenate([[0], np.cumsum(np.asarray(batch.column("lines")), dtype=np.int64)])
        keep = np.ones(int(ptr[-1]), bool)
        gone = batch.column("gone")
        keep[np.repeat(ptr[:-1], np.asarray(gone.value_lengths())) + np.asarray(gone.flatten())] = False
        yield pa.RecordBatch.from_pydict({"rid": batch.column("rid"), "keep": K.ragged(keep, ptr, pa.bool_()), "found_in": batch.column("found_in")})


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, keep, found_in) of each document that loses lines: a flag per line, and the doc_ids of the earlier holders. rid is xxhash64(doc_id, text).

    A pair to align is a row of its own, so a document that shares lines with many others fills no task.
    """
    arrow_safe(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("rid", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("anchors", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"), "text").filter("text != ''").mapInArrow(_line_rows(min_words), schema)
    rows = saved(rows, "lines")
    held = rows.select("id", "rid", F.explode(F.array_distinct("anchors")).alias("anchor"))
    who = F.struct("id", "rid")
    led = held.groupBy("anchor").agg(F.min(who).alias("lead"), F.max(who).alias("last")).filter("lead != last").select("anchor", "lead")
    pairs = held.join(led, "anchor").filter(F.col("lead") != who).select(F.col("lead.rid").alias("first"), "rid").distinct()
    lead = rows.select(F.col("rid").alias("first"), "id", F.col("hashes").alias("other")).dropDuplicates(["first"])
    own = rows.select("rid", "hashes", "words").dropDuplicates(["rid"])
    out = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", kind), T.StructField("lines", T.IntegerType()), T.StructField("gone", T.ArrayType(T.IntegerType()))])
    aligned = saved(pairs.join(lead, "first").join(own, "rid").select("rid", "id", "other", "hashes", "words").mapInArrow(_align(min_words), out).filter("size(gone) > 0"), "blocks")
    lines = aligned.select("rid", F.explode("gone").alias("line")).groupBy("rid").agg(F.collect_set("line").alias("gone"))
    by = aligned.groupBy("rid").agg(F.first("lines").alias("lines"), F.array_sort(F.collect_set("id")).alias("found_in"), F.count("id").alias("named"), F.count("*").alias("n"))
    # collect_set leaves out a NULL doc_id, which comes before all others
    by = by.withColumn("found_in", F.when(F.col("named") < F.col("n"), F.concat(F.array(F.lit(None).cast(kind)), "found_in")).otherwise(F.col("found_in"))).select("rid", "lines", "found_in")
    final = T.StructType([T.StructField("rid", T.LongType()), T.StructField("keep", T.ArrayType(T.BooleanType())), T.StructField("found_in", T.ArrayType(kind))])
    return by.join(lines, "rid").mapInArrow(_flags, final)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None, found_in: str | None = None) -> DataFrame:
    """``docs`` without the lines that earlier documents hold; n_chars, if there, follows the text.

    ``removed`` and ``found_in`` name new columns for the number of deleted
    lines and the doc_ids that hold them.
    """
    rid, keep, by = (fresh(docs, c) for c in ("rid", "keep", "found_in"))
    gone = cut(deletions(docs, min_words)).select(F.col("rid").alias(rid), F.col("keep").alias(keep), F.col("found_in").alias(by))
    # a row is as wide as its document has lines, so the size is checked in bytes
    size = gone.agg(F.sum(F.size(keep) + 16 * F.size(by) + 48)).first()[0] or 0
    joined = keyed_join(docs.withColumn(rid, F.xxhash64("doc_id", "text")), gone, rid, "left", -(-size // 48))
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: F.get(F.col(keep), i)), "\n"))
    new = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(keep).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    columns = [F.col(c) for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size(F.filter(keep, lambda x: ~x)), F.lit(0)).alias(removed))
    if found_in:
        columns.append(F.coalesce(F.col(by), F.array().cast(new.schema[by].dataType)).alias(found_in))
    return new.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left, how many lines went and which documents hold them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed="removed_lines", found_in="found_in")
