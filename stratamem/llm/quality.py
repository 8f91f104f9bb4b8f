"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features`` turns a batch of texts into a matrix of statistics with the byte
kernels. ``fit`` bins each statistic at its quantiles and grows trees level by
level from gradient and hessian histograms. The ensemble is flattened into
arrays (feature, threshold, left child, value), and a batch is scored by
following all its rows down each tree at once with numpy.

The training sample is bounded by ``SAMPLE`` labelled rows, chosen by the hash
of doc_id; scoring covers every document and its whole text. The model (some
tens of KB, of fixed size) is all that is broadcast.

Defined results. NULL and empty texts have quality 0 and are rejected, as they
hold nothing to train on. Rows with a NULL doc_id are scored like others but
never used for training; neither are labels of unknown documents or NULL
labels. Repeated rows get equal scores. With no usable label, or labels of one
class, nothing can be told apart and every non-empty text is kept (quality 1).
An empty table gives an empty result. Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import arrow_safe, fresh, read

#: The most labelled documents used for training.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA = 60, 5, 64, 0.2, 1.0
THRESHOLD = 0.5
_U = np.uint64

_COMMON = (
    "the of and to in is that for it on with as was by at from this are be or an not you have "
    "der die das und ist nicht ein eine mit von zu den des sich auf für "
    "le la les de des et un une est que qui pour dans par sur avec au "
    "el los las y en que un una por con para del se es lo"
)


def _fingerprints(text: str) -> np.ndarray:
    return np.unique(K.words(next(K.chunks(pa.array([text])))).hash)


_COMMON_HASHES = _fingerprints(_COMMON)

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "space": [32],
    "feed": [10],
    "stop": [46, 33, 63],
    "bang": [33],
    "comma": [44, 59, 58],
    "pipe": [124],
    "mark": [ord(c) for c in "#$%&*+=<>@\\^_`~{}[]"],
    "quote": [34, 39, 40, 41],
    "slash": [47],
    "high": [*range(128, 256)],
    "tail": [*range(128, 192)],
}
_BIT = {name: i for i, name in enumerate(_CLASSES)}
NAMES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "top_word", "repeated_neighbour", "distinct_pairs", "log_lines", "words_a_line", "distinct_lines", "short_lines",
    *(f"{c}_share" for c in ("upper", "lower", "digit", "space", "stop", "bang", "comma", "pipe", "mark", "quote", "slash", "high")),
    "common_words", "capital_words", "words_a_stop", "marks_a_word", "long_words",
)


def _per_doc(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by row pointer, empty rows being 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def features(t: K.Texts) -> np.ndarray:
    """A row of statistics (NAMES) for each document of a chunk."""
    n = t.n
    size = np.diff(t.off)
    seen = np.zeros((n, len(_CLASSES)))
    histogram = np.bincount(np.repeat(np.arange(n, dtype=np.int64) << 8, size) + t.raw, minlength=n << 8).reshape(n, 256)
    for name, members in _CLASSES.items():
        seen[:, _BIT[name]] = histogram[:, members].sum(1)
    w, ln = K.words(t), K.lines(t)
    count = np.diff(w.ptr)
    chars = np.maximum(size - seen[:, _BIT["tail"]], 1)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = _per_doc(length, w.ptr) / some
    spread = np.sqrt(np.maximum(_per_doc(length**2, w.ptr) / some - mean**2, 0))
    doc = w.doc()
    tdoc, _, tf = K.term_counts(doc, w.hash)
    distinct = np.bincount(tdoc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, tdoc, tf)
    again = np.zeros(len(doc))
    if len(doc) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    pdoc, ph = K.shingles(w, 2)
    pairs = np.bincount(K.term_counts(pdoc, ph)[0], minlength=n) / np.maximum(np.bincount(pdoc, minlength=n), 1)
    n_lines = np.maximum(np.diff(ln.ptr), 1)
    ldoc = np.repeat(np.arange(n), np.diff(ln.ptr))
    lines = np.bincount(K.term_counts(ldoc, ln.hash)[0], minlength=n)
    short = _per_doc(ln.words < 4, ln.ptr)
    at = np.minimum(np.searchsorted(_COMMON_HASHES, w.hash), len(_COMMON_HASHES) - 1)
    common = _per_doc(_COMMON_HASHES[at] == w.hash, w.ptr)
    first = t.raw[w.start] if len(doc) else np.zeros(0, np.uint8)
    capital = _per_doc((first >= 65) & (first <= 90), w.ptr)
    share = lambda name: seen[:, _BIT[name]] / np.maximum(size, 1)
    columns = [np.log1p(chars), np.log1p(count), mean, spread, distinct / some, top / some, _per_doc(again, w.ptr) / some, pairs, np.log1p(n_lines), count / n_lines, lines / n_lines, short / n_lines]
    columns += [share(c) for c in ("upper", "lower", "digit", "space", "stop", "bang", "comma", "pipe", "mark", "quote", "slash", "high")]
    columns += [common / some, capital / some, count / (seen[:, _BIT["stop"]] + 1), (seen[:, _BIT["mark"]] + seen[:, _BIT["bang"]] + seen[:, _BIT["pipe"]]) / some, _per_doc(length > 15, w.ptr) / some]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Trees:
    """A flattened ensemble. Inner node i of tree k goes right where x[feature[k, i]] > cut[k, i]; a leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, by following all rows level by level; children of node i are 2i+1 and 2i+2."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss, from histograms of BINS quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.full((TREES, nodes), -1, np.int64), np.zeros((TREES, nodes), np.float32), np.zeros((TREES, nodes))
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = np.log(p / (1 - p))
    total = np.full(n, base)
    column = np.arange(m) * BINS
    for k in range(TREES):
        prob = 1 / (1 + np.exp(-total))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH + 1):
            lo, width = 2**level - 1, 2**level
            live = np.flatnonzero(at >= lo)
            if not len(live):
                break
            slot = at[live] - lo
            sg, sh = np.bincount(slot, g[live], width), np.bincount(slot, h[live], width)
            value[k, lo : lo + width] = -RATE * sg / (sh + LAMBDA)
            if level == DEPTH:
                break
            key = ((slot * m * BINS)[:, None] + column + binned[live]).ravel()
            hg = np.bincount(key, np.repeat(g[live], m), width * m * BINS).reshape(width, m, BINS).cumsum(2)
            hh = np.bincount(key, np.repeat(h[live], m), width * m * BINS).reshape(width, m, BINS).cumsum(2)
            rg, rh = sg[:, None, None] - hg, sh[:, None, None] - hh
            gain = hg**2 / (hh + LAMBDA) + rg**2 / (rh + LAMBDA) - (sg**2 / (sh + LAMBDA))[:, None, None]
            gain[(hh < 1) | (rh < 1)] = 0
            gain = gain.reshape(width, -1)
            best = gain.argmax(1)
            for s in np.flatnonzero(gain[np.arange(width), best] > 1e-6):
                j, b = divmod(int(best[s]), BINS)
                if b < len(edges[j]):
                    feature[k, lo + s], cut[k, lo + s] = j, edges[j][b]
            f = feature[k, at[live]]
            go = f >= 0
            who = live[go]
            at[who] = 2 * at[who] + 1 + (x[who, f[go]] > cut[k, at[who]])
        total += value[k, at]
    return Trees(feature, cut, value, base)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in K.chunks(batch.column("text")):
            x = features(t)
            yield pa.RecordBatch.from_pydict({"quality": batch.column("quality").slice(t.first, t.n), "x": K.ragged(x.ravel(), np.arange(t.n + 1) * x.shape[1], pa.float32())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Fits the trees on at most ``sample`` labelled documents of ``docs``; None if there aren't two classes."""
    arrow_safe(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most `sample` rows of 12 bytes
    rows = docs.select("doc_id", "text").filter("text != ''").join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_feature_rows, "quality int, x array<float>").toArrow()
    y = rows.column("quality").to_numpy().astype(np.float64)
    if len(y) < 2 or y.min() == y.max():
        return None
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    order = np.lexsort((*x.T, y))  # the order of rows that Spark gives doesn't count
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees | None, name: str = "quality_score") -> DataFrame:
    """``docs`` with its quality score from 0 to 1 in the new column ``name``, or the next free name (quality_score1, ...) if there is such a column."""
    name = fresh(docs, name)
    spark = docs.sparkSession
    arrow_safe(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            text = batch.column("text")
            out = np.empty(batch.num_rows)
            for t in K.chunks(text):
                out[t.first : t.first + t.n] = np.where(np.diff(t.off) > 0, 1.0 if trees is None else trees.score(features(t)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def reject_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those of a quality score under ``threshold``; all columns stay."""
    name = fresh(docs, "quality_score")
    return score(docs, train(docs, labels), name).filter(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality_score and keep of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.round("quality_score", 6).alias("quality_score"), (F.col("quality_score") >= THRESHOLD).alias("keep"))
