"""Byte-level numpy kernels shared by the text operators.

Arrow hands a batch of texts over as one UTF-8 buffer with offsets. The kernels
below work on that buffer for all its documents at once: words, lines and
shingles get 64-bit fingerprints from a prefix polynomial modulo 2**64, so no
Python object is made per word. Texts are taken whole; a batch is cut between
documents only, to keep the temporary arrays inside the CPU caches.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII bytes;
case is folded for ASCII and Latin-1 letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240131))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_VALUE[65:91] = _VALUE[97:123]
_WORD = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    _WORD[_a:_b] = 1
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1, 2 * len(self.up))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_WORD_TABLE = bytes(_WORD)


class _Scratch:
    """Temporary arrays that are used again for each chunk; none of them leaves this module."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> _Scratch:
        if not CHUNK_BYTES <= self.n <= max(4 * CHUNK_BYTES, 2 * n) or self.n < n:
            self.n = max(n, CHUNK_BYTES)
            self.index, self.value, self.total = np.empty(self.n, np.intp), np.empty(self.n, np.uint64), np.empty(self.n + 1, np.uint64)
            self.shift = np.empty(self.n, np.uint8)
        return self


_SCRATCH = _Scratch()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, int64 offsets, is-null) of a string or binary column, without a copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offs, kind, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    return raw, off, null


@dataclass
class Texts:
    """Consecutive documents of a batch: rows [first, first+n), their bytes and relative offsets."""

    first: int
    raw: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cuts a column between documents into pieces of about ``size`` bytes (a longer document is one piece). NULL counts as empty."""
    raw, off, _ = buffers(column)
    n, row = len(off) - 1, 0
    size = max(1, size)
    while row < n:
        end = int(np.searchsorted(off, off[row] + size, "right")) - 1
        end = min(n, max(end, row + 1), row + (1 << 19))
        yield Texts(row, raw[off[row] : off[end]], off[row : end + 1] - off[row])
        row = end


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with upper-case Latin-1 letters (UTF-8 C3 80..9E) in lower case; ASCII case is folded by the value table."""
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        nxt = raw[lead + 1]
        up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        if len(up):
            raw = raw.copy()
            raw[up] += 0x20
    return raw


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray  # words of document i are [ptr[i], ptr[i+1])

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words(t: Texts) -> Words:
    """All words of the documents, with fingerprints."""
    n = len(t.raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, np.uint64), np.zeros(t.n + 1, np.int64))
    is_word = np.frombuffer(t.raw.tobytes().translate(_WORD_TABLE), np.uint8)
    s = _SCRATCH.upto(n)
    beside = s.shift[:n]
    inner = t.off[1:-1]
    beside[0], beside[1:] = 0, is_word[:-1]
    beside[inner[inner < n]] = 0
    start = np.flatnonzero(is_word > beside)
    beside[-1], beside[:-1] = 0, is_word[1:]
    beside[inner[inner > 0] - 1] = 0
    end = np.flatnonzero(is_word > beside) + 1
    up, down = _POWERS.upto(n + 1)
    index, value, total = s.index[:n], s.value[:n], s.total[: n + 1]
    index[:] = folded(t.raw)
    np.take(_VALUE, index, out=value, mode="wrap")
    np.multiply(value, up[:n], out=value)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(start, end, h, np.searchsorted(start, t.off))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of every run of ``size`` words; a shorter document with words gives one shingle of them all."""
    count = np.diff(w.ptr)
    total = len(w.hash)
    if not total:
        return w.doc(), w.hash
    runs = np.maximum(count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), runs)
    base = np.concatenate([[0], np.cumsum(runs)[:-1]])
    pos = np.arange(len(doc)) + np.repeat(w.ptr[:-1] - base, runs)
    h = w.hash[pos]
    short = np.flatnonzero((count > 0) & (count < size))
    for k in range(1, size):
        part = w.hash[np.minimum(pos + k, total - 1)]
        few = short[count[short] <= k]
        part[base[few]] = 0
        h = (h * U64(0x9E3779B97F4A7C15)) ^ (part + U64(k))
        h = mix(h)
    return doc, h


#: term_counts keeps this many bits of a fingerprint, so that it sorts with the document's number as one integer.
TERM_BITS = 44


def term_counts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, 44-bit fingerprint), sorted, with how often each occurs. At most 2**20 documents a chunk."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    key = np.sort((doc.astype(np.uint64) << U64(TERM_BITS)) | (h >> U64(64 - TERM_BITS)))
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> U64(TERM_BITS)).astype(np.int64), key & U64((1 << TERM_BITS) - 1), np.diff(np.append(at, len(h)))


@dataclass
class Lines:
    start: np.ndarray
    end: np.ndarray  # of the line's bytes without the line feed
    hash: np.ndarray  # of its words; 0 if it has none
    words: np.ndarray
    ptr: np.ndarray


def lines(t: Texts) -> Lines:
    """Lines (cut at LF) with a fingerprint of their words. A non-empty document has one line more than line feeds."""
    w = words(t)
    n = len(t.raw)
    feed = np.flatnonzero(t.raw == 10)
    filled = np.flatnonzero(np.diff(t.off) > 0)
    start = np.sort(np.concatenate([t.off[filled], feed + 1]), kind="stable")
    end = np.sort(np.concatenate([t.off[filled + 1], feed]), kind="stable")
    # a document that ends with LF has an empty last line, which starts where the next one does
    first = np.searchsorted(w.start, start)
    last = np.searchsorted(w.start, end)
    count = last - first
    up, down = _POWERS.upto(max(n, len(w.hash)) + 1)
    total = np.empty(len(w.hash) + 1, np.uint64)
    total[0] = 0
    np.cumsum((w.hash | U64(1)) * up[: len(w.hash)], out=total[1:])
    h = mix((total[last] - total[first]) * down[first] + count.astype(np.uint64))
    h[count == 0] = 0
    per_doc = np.zeros(t.n, np.int64)
    per_doc[filled] = 1
    if len(feed):
        per_doc += np.bincount(np.searchsorted(t.off, feed, "right") - 1, minlength=t.n)
    return Lines(start, end, h, count, np.concatenate([[0], np.cumsum(per_doc)]))


def ragged(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row pointers, without a copy."""
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, kind))
