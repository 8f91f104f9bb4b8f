"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

A recording becomes overlapping frames; a frame's spectrum is summed by pitch
class (12 values, scaled to unit length). Over this image of pitch classes and
time, 16 rectangle filters are evaluated with an integral image, and each answer
is quantised to two Gray-coded bits, which gives one packed 32-bit integer per
frame. The quantiser's thresholds are quartiles over a synthetic recording made
from a fixed seed.

Recordings with equal fingerprints are collapsed into a class; its first stands
for all. The search takes a stated set of queries against all classes (without
one, every class against all earlier ones). Every pair of a query and a class
that share SHARED items (packed integers) is aligned: the histogram of the offsets
between equal items picks the offset, and the segment there with the fewest wrong
bits is the match. No pair is left out, however frequent its items.

Only fingerprints, some 2 % of the bytes, are shuffled. Queries and classes are cut
into blocks of bounded numbers of items, and each pair of blocks is solved by
itself, its pairs in portions, so neither a frequent item nor a large class fills
a task's memory, and no pair is shuffled before it's aligned.

The media column holds RIFF/WAVE files (8 or 16 bit PCM, any channels and rate)
or raw unsigned 8-bit PCM at RATE; the corpus' own tables have no audio, so the
query reads each document's bytes, all of them, as raw PCM.

Defined results. NULL media give a NULL fingerprint, empty ones an empty one; both
are of no class.
Recordings too short for one item are padded with silence to one, and the last
frame is padded likewise. Rows with a NULL doc_id get a fingerprint, no class and no
matches. Repeated rows get equal results. Rows of the same doc_id with other
media are recordings of their own. Equal fingerprints of any length above 0 are
copies; other matches need SHARED equal items and a segment of SEGMENT items, or
of all items of the shorter recording if it has fewer. A malformed WAVE header makes the bytes raw
PCM. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import arrow_safe, read, saved

RATE, WINDOW, HOP = 8000, 1024, 256
LOWEST, HIGHEST = 220.0, 3520.0
#: (kind, first pitch class, pitch classes, frames): what two areas of the image a filter compares.
FILTERS = (
    ("pitch", 0, 4, 4), ("pitch", 4, 4, 4), ("pitch", 8, 4, 4), ("pitch", 2, 8, 12), ("pitch", 0, 12, 16),
    ("mid_pitch", 0, 6, 6), ("mid_pitch", 6, 6, 6), ("mid_pitch", 3, 9, 12),
    ("time", 0, 6, 8), ("time", 6, 6, 8), ("time", 0, 12, 16),
    ("cross", 0, 6, 8), ("cross", 6, 6, 8), ("cross", 2, 8, 14),
    ("mid_time", 0, 12, 15), ("mid_time", 4, 4, 9),
)
SPAN = max(f[3] for f in FILTERS)
#: Equal items that two recordings must have, votes that an offset needs, items of a segment, and its share of wrong bits.
SHARED, VOTES, SEGMENT, MAX_ERROR = 2, 2, 8, 0.2
#: Frames transformed at once.
FRAMES = 2048
#: Items of a block of queries and of a block of classes, and pairs of equal items looked at together.
QUERY_ITEMS, BLOCK_ITEMS, PORTION = 1 << 20, 1 << 20, 1 << 21

_GRAY = np.array([0, 1, 3, 2], np.uint32)
_WINDOW = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


@functools.cache
def _pitch_classes() -> np.ndarray:
    """The matrix that sums a power spectrum by pitch class."""
    frequency = np.fft.rfftfreq(WINDOW, 1 / RATE)
    use = (frequency >= LOWEST) & (frequency < HIGHEST)
    out = np.zeros((len(frequency), 12), np.float32)
    note = np.round(12 * np.log2(frequency[use] / LOWEST)).astype(int) % 12
    out[np.flatnonzero(use), note] = 1
    return out


def wave(data: bytes) -> np.ndarray | None:
    """The samples of a RIFF/WAVE file, mono at RATE, from -1 to 1; None if it isn't one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, channels, rate, bits = 12, 0, 0, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 16:
            coding, channels = int.from_bytes(body[:2], "little"), int.from_bytes(body[2:4], "little")
            rate, bits = int.from_bytes(body[4:8], "little"), int.from_bytes(body[14:16], "little")
            if coding != 1:
                return None
        elif kind == b"data":
            if not channels or not rate or bits not in (8, 16):
                return None
            whole = len(body) // (channels * bits // 8) * (channels * bits // 8)
            x = np.frombuffer(body[:whole], np.uint8 if bits == 8 else "<i2").astype(np.float32)
            x = (x - 128) / 128 if bits == 8 else x / 32768
            x = x.reshape(-1, channels).mean(1)
            if rate != RATE and len(x):
                x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x).astype(np.float32)
            return x
        at += 8 + size + size % 2
    return None


def _signal(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(samples, offsets) of a chunk of recordings."""
    size = np.diff(t.off)
    signal = (t.raw.astype(np.float32) - 128) / 128
    riff = [i for i in np.flatnonzero(size >= 12) if t.raw[t.off[i]] == 82 and t.raw[t.off[i] : t.off[i] + 4].tobytes() == b"RIFF"]
    if not riff:
        return signal, t.off
    parts = [signal[a:b] for a, b in zip(t.off[:-1], t.off[1:])]
    for i in riff:
        x = wave(t.raw[t.off[i] : t.off[i + 1]].tobytes())
        parts[i] = parts[i] if x is None else x
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def chroma(signal: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x 12, row pointers): the pitch classes of each recording [off[i], off[i+1]). The end is padded with silence."""
    size = np.diff(off)
    count = np.where(size > 0, np.maximum(-(-np.maximum(size - WINDOW, 0) // HOP) + 1, SPAN), 0)
    ptr = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    start = off[owner] + (np.arange(len(owner)) - ptr[owner]) * HOP
    stop = off[owner + 1]
    out = np.zeros((len(owner), 12), np.float32)
    within = np.arange(WINDOW)
    matrix = _pitch_classes()
    for a in range(0, len(owner), FRAMES):
        s, e = start[a : a + FRAMES, None], stop[a : a + FRAMES, None]
        at = s + within
        frame = np.where(at < e, signal[np.minimum(at, len(signal) - 1)], np.float32(0)) * _WINDOW
        spectrum = np.fft.rfft(frame, axis=1)
        bands = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ matrix
        norm = np.sqrt((bands**2).sum(1, keepdims=True))
        out[a : a + FRAMES] = np.divide(bands, norm, out=np.zeros_like(bands), where=norm > 1e-4)
    return out, ptr


def _areas(kind: str, y: int, h: int, w: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """The two areas (frames from, to, pitch classes from, to) that a filter compares."""
    if kind == "pitch":
        return [(0, w, y, y + h // 2)], [(0, w, y + h // 2, y + h)]
    if kind == "time":
        return [(0, w // 2, y, y + h)], [(w // 2, w, y, y + h)]
    if kind == "cross":
        a, b = w // 2, y + h // 2
        return [(0, a, y, b), (a, w, b, y + h)], [(a, w, y, b), (0, a, b, y + h)]
    if kind == "mid_pitch":
        a, b = y + h // 3, y + 2 * h // 3
        return [(0, w, a, b)], [(0, w, y, a), (0, w, b, y + h)]
    a, b = w // 3, 2 * w // 3
    return [(a, b, y, y + h)], [(0, a, y, y + h), (b, w, y, y + h)]


def answers(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The filters' answers (log ratio of the areas' means) at the frames ``at``, from the integral image."""
    total = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])
    out = np.empty((len(at), len(FILTERS)))
    for k, f in enumerate(FILTERS):
        means = []
        for side in _areas(*f):
            area = sum((b - a) * (d - c) for a, b, c, d in side)
            means.append(sum(total[at + b, d] - total[at + a, d] - total[at + b, c] + total[at + a, c] for a, b, c, d in side) / area)
        out[:, k] = np.log((means[0] + 0.01) / (means[1] + 0.01))
    return out


def synthetic(seed: int, seconds: float) -> np.ndarray:
    """A recording of chords and noise."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = int(seconds * RATE)
    x = rng.normal(0, 0.05, n)
    at = 0
    while at < n:
        end = min(n, at + int(rng.uniform(0.05, 0.6) * RATE))
        t = np.arange(end - at) / RATE
        for _ in range(int(rng.integers(1, 5))):
            x[at:end] += rng.uniform(0.05, 0.3) * np.sin(2 * np.pi * LOWEST * 2 ** (rng.integers(0, 48) / 12) * t)
        at = end
    return np.clip(x, -1, 1).astype(np.float32)


@functools.cache
def thresholds() -> np.ndarray:
    """Each filter's quartiles over a minute of synthetic recording."""
    x = synthetic(20240131, 60)
    image, _ = chroma(x, np.array([0, len(x)]))
    return np.quantile(answers(image, np.arange(len(image) - SPAN + 1)), [0.25, 0.5, 0.75], axis=0)


def fingerprints(signal: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, row pointers) of recordings."""
    image, ptr = chroma(signal, off)
    count = np.maximum(np.diff(ptr) - SPAN + 1, 0)
    own = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    at = ptr[row] + np.arange(len(row)) - own[row]
    items = np.zeros(len(at), np.uint32)
    cuts = thresholds()
    if len(at):
        values = answers(image, at)
        for k in range(len(FILTERS)):
            level = sum((values[:, k] > c).astype(np.intp) for c in cuts[:, k])
            items = (items << np.uint32(2)) | _GRAY[level]
    return items.view(np.int32), own


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float] | None:
    """(offset, start, length, bit error) of the best common segment: b[start:start+length] against a from start - offset on; None if there's none."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    lo, hi = np.searchsorted(ranked, b, "left"), np.searchsorted(ranked, b, "right")
    votes = np.zeros(len(a) + len(b), np.int64)
    hit = np.flatnonzero(hi > lo)
    n = hi[hit] - lo[hit]
    ends = np.cumsum(n)
    done = 0
    while done < len(hit):  # in parts of about a million pairs, so that long equal stretches don't fill the memory
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 1_000_000, "right")))
        j, m = hit[done:until], n[done:until]
        k = np.repeat(lo[j] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
        votes += np.bincount(np.repeat(j, m) - order[k] + len(a), minlength=len(votes))
        done = until
    if not len(hit) or votes.max() < VOTES:
        return None
    best, least = None, min(SEGMENT, len(a), len(b))
    for offset in (np.flatnonzero(votes == votes.max()) - len(a)).tolist():
        first, last = max(0, offset), min(len(b), len(a) + offset)
        wrong = np.bitwise_count((b[first:last] ^ a[first - offset : last - offset]).view(np.uint32)).astype(np.int64) if last > first else np.zeros(0, np.int64)
        gain = np.concatenate([[0.0], np.cumsum(32 * MAX_ERROR - wrong)])
        low = np.minimum.accumulate(gain)
        end = int(np.argmax(gain - low))
        start = int(np.argmin(gain[: end + 1]))
        if end - start >= least:
            error = float(wrong[start:end].sum()) / (32 * (end - start))
            found = (gain[start] - gain[end], abs(offset), offset, first + start, end - start, error)
            best = found if best is None else min(best, found)
    return best and best[2:]


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column("media")
        for t in K.chunks(media):
            signal, off = _signal(t)
            items, own = fingerprints(signal, off)
            null = media.slice(t.first, t.n).is_null()
            lists = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(items), mask=null)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(t.first, t.n),
                "duration_ms": pa.array(np.diff(off) * 1000 // RATE, pa.int64(), mask=np.asarray(null)), "fingerprint": lists,
            })


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, row pointers) of a list column without NULLs."""
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    return np.asarray(one.flatten()), np.concatenate([[0], np.cumsum(np.asarray(one.value_lengths()), dtype=np.int64)])


def _distinct(items: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of the distinct items of each row, by row."""
    key = np.unique(np.repeat(np.arange(len(ptr) - 1, dtype=np.uint64), np.diff(ptr)) << np.uint64(32) | items.view(np.uint32))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def candidates(a: np.ndarray, a_ptr: np.ndarray, b: np.ndarray, b_ptr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs that share SHARED items, in portions."""
    rows_b, items_b = _distinct(b, b_ptr)
    order = np.argsort(items_b, kind="stable")
    rows_b, items_b = rows_b[order], items_b[order]
    rows_a, items_a = _distinct(a, a_ptr)
    lo = np.searchsorted(items_b, items_a, "left")
    n = np.searchsorted(items_b, items_a, "right") - lo
    rows_a, lo, n = rows_a[n > 0], lo[n > 0], n[n > 0]
    edge = np.append(np.flatnonzero(np.diff(rows_a, prepend=-1)), len(rows_a))
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(edge) - 1:
        end = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + PORTION, "right")) - 1)
        i, j = edge[at], edge[end]
        m = n[i:j]
        k = np.repeat(lo[i:j] - (total[i:j] - total[i]), m) + np.arange(int(m.sum()))
        pair, count = np.unique(np.repeat(rows_a[i:j], m) * len(b_ptr) + rows_b[k], return_counts=True)
        pair = pair[count >= SHARED]
        yield pair // len(b_ptr), pair % len(b_ptr)
        at = end


def _search(earlier: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Matches of the queries ``left`` among the classes ``right``."""
        keep, out = ([], []), []
        if left.num_rows and right.num_rows:
            (b, b_ptr), (a, a_ptr) = (_lists(t.column("fp")) for t in (left, right))
            digest_b, digest_a = (np.asarray(t.column("digest").combine_chunks()) for t in (left, right))
            first_b, first_a = (t.column("first").to_pylist() for t in (left, right))
            for i, j in candidates(a, a_ptr, b, b_ptr):
                other = digest_a[i] != digest_b[j]
                for i, j in zip(i[other].tolist(), j[other].tolist()):
                    if earlier and (first_a[i], digest_a[i]) > (first_b[j], digest_b[j]):
                        continue
                    found = align(a[a_ptr[i] : a_ptr[i + 1]], b[b_ptr[j] : b_ptr[j + 1]])
                    if found:
                        keep[0].append(j)
                        keep[1].append(i)
                        out.append(found)
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        j, i = (pa.array(k, pa.int64()) for k in keep)
        found = [left.column("digest").take(j), right.column("first").take(i), *(pa.array(c, k) for c, k in zip(columns, kinds))]
        return pa.table(found, names=["digest", "first", "offset", "start", "length", "bit_error"])

    return run


def fingerprint(docs: DataFrame, media: str) -> DataFrame:
    """(doc_id, duration_ms, fingerprint) of every row's recording in the column ``media``."""
    arrow_safe(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("duration_ms", T.LongType()), T.StructField("fingerprint", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", F.col(media).alias("media")).mapInArrow(_print_rows, schema)


def match(prints: DataFrame, queries: Column | None = None) -> DataFrame:
    """``prints`` with ``first``, the least doc_id of the recording's class (those of an equal fingerprint), ``copies``, its number of rows, and ``matches``.

    A match is (doc_id, offset, start, length, bit_error) in frames of HOP
    samples: items [start, start + length) equal those of the class of doc_id
    from start - offset on, but for a share bit_error of the bits. With ``queries``,
    a condition on the rows, they get all classes they align with, and other rows
    get NULL; without, each row gets the classes of lesser doc_id. A copy has its
    own class among its matches, if it isn't the class' first.
    """
    spark = prints.sparkSession
    kind = prints.schema["doc_id"].dataType
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    keyed = saved(prints.withColumn("asked", asked).withColumn("digest", F.xxhash64("fingerprint")), "prints")
    named = keyed.filter("doc_id is not null and size(fingerprint) > 0")
    same = saved(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("asked").alias("asked"), F.first("fingerprint").alias("fp")), "recordings")
    able = same.filter(F.size(F.array_distinct("fp")) >= SHARED)
    items = F.sum(F.size("fp"))
    all_items, asked_items = able.agg(items, F.sum(F.when(F.col("asked"), F.size("fp")))).first()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = max(1, -(-(asked_items or 0) // QUERY_ITEMS))
    # a block of classes may be smaller, so that all cores have one
    many = max(1, -(-(all_items or 0) // BLOCK_ITEMS), min(2 * parts // some, (all_items or 0) // 4096))
    columns = ["digest", "first", "fp"]
    block = lambda n: F.expr(f"int(pmod(digest, {n}))")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    left = able.filter("asked").select(*columns, block(some).alias("q"), every(many).alias("b"))
    right = able.select(*columns, every(some).alias("q"), block(many).alias("b"))
    found = T.StructType([T.StructField("digest", T.LongType()), T.StructField("first", kind), *(T.StructField(c, T.IntegerType()) for c in ("offset", "start", "length")), T.StructField("bit_error", T.DoubleType())])
    aligned = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(_search(queries is None), found)
    one = F.struct(F.col("first").alias("doc_id"), "offset", "start", "length", F.round("bit_error", 6).alias("bit_error"))
    by = aligned.groupBy("digest").agg(F.array_sort(F.collect_list(one)).alias("found"))
    rows = keyed.join(same.select("digest", "first", "copies").join(by, "digest", "left"), "digest", "left")
    copy = F.struct(F.col("first").alias("doc_id"), F.lit(0).alias("offset"), F.lit(0).alias("start"), F.size("fingerprint").alias("length"), F.lit(0.0).alias("bit_error"))
    none = F.array().cast(by.schema["found"].dataType)
    copies = F.when((F.col("doc_id") > F.col("first")) & (F.size("fingerprint") > 0), F.array(copy)).otherwise(none)
    own = F.col("doc_id").isNotNull()
    matches = F.when(own, F.array_sort(F.concat(copies, F.coalesce("found", none)))).otherwise(none)
    of_class = [F.when(own, F.col(c)).alias(c) for c in ("first", "copies")]
    return rows.select("doc_id", "duration_ms", "fingerprint", *of_class, F.when(F.col("asked"), matches).alias("matches"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document's bytes as a recording; the queries, those of a doc_id divisible by 100, with all their matches among all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("media"))
    return match(fingerprint(docs, "media"), F.col("doc_id") % 100 == 0)
