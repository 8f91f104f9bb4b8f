"""Byte-pair encoding with a backtracking encoder, and decoding with an offset table.

The encoder gives exactly the tokens of the merge procedure without doing the
merges. An Aho-Corasick automaton over the vocabulary finds, for each place of a
piece, the longest token that starts there. The encoder takes it if it may
follow the token before (the pair-compatibility test), or else the next shorter
token, or else steps back; places that led nowhere are remembered, so the time
is linear in the piece. Two tokens are compatible if the merge procedure
applied to their joined bytes leaves both as they are; the answers go into a
table that grows as pairs are met.

Texts are first cut into pieces by the tokenizer's pattern. Text between two
spaces is encoded once and kept in a bounded table of token bytes, so a
document's ids are one join of byte strings, which becomes an Arrow list column
without a Python object per token.

Decoding puts all tokens' bytes into one array with offsets and gathers the
bytes of a whole batch of id lists at once.

Defined results. A NULL text gives NULL ids, an empty text an empty list; the
same for decoding. Bytes are UTF-8; ids outside the vocabulary raise an error.
Repeated rows give equal lists, an empty table an empty result. Extra columns
are kept.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import arrow_safe, fresh, read

#: Vocabulary in the rank-file format: base64 of a token's bytes and its rank, by line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded stretches of text, and pieces, that a worker keeps; the tables start anew when they're full.
KEPT = 150_000


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Bpe:
    """Encoder and decoder of one vocabulary of ranks (a token's id is its rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        #: next_shorter[i]: the longest token that is a proper prefix of token i, or -1.
        self.next_shorter = [-1] * size
        for b, i in ranks.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in ranks:
                    self.next_shorter[i] = ranks[b[:n]]
                    break
        #: The two tokens that merge into token i, or (i, i) for one that no merge makes; and the merges by pair.
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[int, int] = {}
        for i in sorted(ranks.values()):
            b = self.bytes[i]
            left = self.next_shorter[i]
            while left >= 0:
                right = ranks.get(b[len(self.bytes[left]) :])
                if right is not None and left < i and right < i and self._fits(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left << 32 | right] = i
                    break
                left = self.next_shorter[left]
        self.compatible.clear()
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.regex = regex.compile(PATTERN)

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' joined bytes end in these two tokens: no earlier merge crosses the seam."""
        merged, parts = self.merged, self.parts
        limit = 1 << 62
        while True:
            over = merged.get(left << 32 | right)
            if over is not None and over < limit:
                return False
            if left > right:
                limit = left
                left = parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 250_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def piece(self, b: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        n = len(b)
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(b.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, token
        tokens: list[int] = []
        at, token = 0, longest[0]
        dead = bytearray(n + 1)
        lengths, fits, shorter = self.bytes, self.fits, self.next_shorter
        while True:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(lengths[token])
                if not dead[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                if at == n:
                    return tokens
                token = longest[at]
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = tokens.pop()
                at -= len(lengths[token])
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.regex.findall(text) for i in self.piece(p.encode())]

    def decode_batch(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of id lists [ptr[i], ptr[i+1])."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.bytes)):
            raise ValueError("an id is outside the vocabulary")
        start = self.offsets[ids]
        length = self.offsets[ids + 1] - start
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        step = np.ones(total, np.int64)
        first = end - length
        some = np.flatnonzero(length)
        if len(some):
            here, since = start[some], first[some]
            step[since] = here
            step[since[1:]] -= here[:-1] + length[some][:-1] - 1
            np.cumsum(step, out=step)
        return self.joined[step] if total else np.zeros(0, np.uint8), np.concatenate([[0], end])[ptr]


@lru_cache(maxsize=2)
def coder(path: str = VOCABULARY) -> Bpe:
    return Bpe(load(path))


class Stretches:
    """A text's ids as int32 bytes, from the ids of its stretches between spaces, each encoded once and kept.

    A space that precedes something starts a new piece, so a text can be cut
    before each space; only runs of white space that end in a space reach over
    such a cut, and texts with those are encoded piece by piece.
    """

    def __init__(self, pieces: Callable[[str], list[str]], encode: Callable[[str], list[int]], kept: int = KEPT) -> None:
        self.pieces, self.encode, self.kept = pieces, encode, kept
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    def of(self, stretch: str) -> bytes:
        """The ids of a stretch, which become known."""
        memo = self.known_pieces
        if len(memo) >= self.kept:
            memo.clear()
        parts = []
        for p in self.pieces(stretch):
            ids = memo.get(p)
            if ids is None:
                ids = memo[p] = array("i", self.encode(p)).tobytes()
            parts.append(ids)
        got = self.known[stretch] = parts[0] if len(parts) == 1 else b"".join(parts)
        return got

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        known, of = self.known, self.of
        if len(known) >= self.kept:
            known.clear()
        get = known.get
        if "  " in text or (text[-1] == " " and text[:-1] != text[:-1].rstrip()):
            return b"".join([get(p) or of(p) for p in self.pieces(text)])
        first, *rest = text.split(" ")
        out = [of(first)] if first else []
        out += [get(w) or of(w) for w in map(" ".__add__, rest)]
        return b"".join(out)


@lru_cache(maxsize=2)
def backtracking(path: str = VOCABULARY) -> Stretches:
    bpe = coder(path)
    return Stretches(bpe.regex.findall, lambda p: bpe.piece(p.encode()))


def encoded(texts: pa.Array, stretches: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row pointers) of a column of texts; NULL gives no ids."""
    parts = [stretches.ids(s) if s else b"" for s in texts.to_pylist()]
    ptr = np.concatenate([[0], np.cumsum([len(p) >> 2 for p in parts], dtype=np.int64)])
    return np.frombuffer(b"".join(parts), np.int32), ptr


def _pieces_of(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in a column."""
    _, off, _ = K.buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in the new column ``ids``, or the next free name (token_ids1, ...) if there is such a column."""
    ids = fresh(docs, ids)
    arrow_safe(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = backtracking(vocabulary)
        for batch in (b for whole in batches for b in _pieces_of(whole, "text")):
            text = batch.column("text")
            flat, ptr = encoded(text, stretches)
            lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat), mask=text.is_null() if text.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the id lists ``ids`` in the new column ``text``, or the next free name (decoded1, ...) if there is such a column."""
    text = fresh(df, text)
    arrow_safe(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                batch = whole.slice(row, 512)
                lists = batch.column(ids)
                ptr = np.asarray(lists.offsets).astype(np.int64)
                flat = np.asarray(lists.values.slice(ptr[0], ptr[-1] - ptr[0]).cast(pa.int64()))
                raw, off = bpe.decode_batch(flat, ptr - ptr[0])
                out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
                out = out.cast(pa.string())
                if lists.null_count:
                    out = pa.compute.if_else(lists.is_null(), None, out)
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids of each document, and whether decoding the ids gives the text again (NULL for a NULL text)."""
    ids, back = fresh(docs, "token_ids"), fresh(docs, "decoded")
    both = decode(encode(docs.select("doc_id", "text"), vocabulary, ids), vocabulary, ids, back)
    return both.select("doc_id", F.size(ids).alias("n_tokens"), F.col(ids).alias("token_ids"), (F.col("text") == F.col(back)).alias("round_trip"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, each list decoded again and compared."""
    return round_trip(read(spark, sf_dir, "documents"))
