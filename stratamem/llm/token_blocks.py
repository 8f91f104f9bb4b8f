"""Token ids as compressed binary blocks: adaptive context mixing and a range coder.

A document's ids are cut into blocks of at most BLOCK ids. Every block starts
from a fresh model, carries the CRC-32 of its ids and decodes by itself. An id is
coded as up to five events:

1. where the last two ids (order 2) or the last one (order 1) were met before:
   is the id the one that followed then? Its probability mixes what the orders 2,
   1 and 0 expect of such a prediction, each from its own hits so far, with
   weights that follow from how well each has coded the block so far;
2. if not, is it the order-1 prediction, where that differs?
3. if not, a symbol: how far back the id was last met (the bit length of the
   distance), or, for a new one, the bit length of the id;
4. the remaining bits of that distance or id, up to 15 at once.

All statistics are counts of the block's earlier ids, brought up to date at the
positions of ``_STEP``. So what the encoder needs isn't a state that changes with
each id, but counts and sums over all ids before: sorted by context they are runs,
and by position cumulative sums. The model of a whole batch of blocks is
evaluated by array operations; only the coder's interval is advanced event by
event, in step for all blocks. All arithmetic is in integers, so that any
machine decodes what another encoded.

Defined results. A NULL text gives one row with NULL n_tokens, crc32 and
payload; an empty text one with 0 ids and an empty payload. Repeated rows give
equal blocks. Rows with a NULL doc_id are coded like others. An empty table gives
an empty result. A payload that doesn't decode to ids of its CRC raises an error.
Ids run from 0 to 2**31 - 1. Other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import VOCABULARY, _pieces_of, encoded
from .common import arrow_safe, read
from .tokens import library

BLOCK = 4096
#: Blocks that are decoded in step, and ids whose model is evaluated at once (addresses of their contexts fit into 16 bits).
LANES, CHUNK = 2048, 1 << 15
#: Blocks whose events are coded in step, so many that an array operation's fixed cost is small; fewer if their events take this much memory (4 bytes each, and as much again for words).
TOGETHER, MOST_EVENTS = 8192, 1 << 25
_U = np.uint64
_ONE = 1 << 16  # the total of a distribution
_LOW, _HALF, _ONE32, _WORD, _LEAST = np.uint32(0xFFFF), np.uint32(16), np.uint32(1), _U(16), _U(1 << 32)

#: Position within a block -> how often the statistics were brought up to date before it.
_EDGES = np.array([0, 4, 8, 16, 32, 64, 128, 192, *range(256, BLOCK, 128)])
_STEP = np.searchsorted(_EDGES, np.arange(BLOCK), "right") - 1
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
#: Symbols: bit lengths of a distance less one, then bit lengths of an id.
_NEAR, _SIZES = 12, 32
_SYMBOLS = _NEAR + _SIZES
_PRIOR = np.array([4] * _NEAR + [4] * 17 + [1] * (_SIZES - 17), np.int64)
_GAIN = 8
_INVERSE = np.array([0, *((1 << 32) // np.arange(1, BLOCK * _GAIN + int(_PRIOR.sum()) + 1))], np.int64)
#: State of a context: never met, then by the run of right predictions in it (0 after a wrong one, 1 if met once).
_RUN = np.array([1, 2, 3, 4, 4, 5, 5, 5], np.int64)
_STATES = 6
_SURE = np.array([2, 2, 4, 6, 7, 7], np.int64)  # hits of 8 that a state's prediction is taken to have had
_COUNTS = 8
_LOG = np.round(-256 * np.log2((np.arange(4096) + 0.5) / 4096)).astype(np.int64)  # cost of a probability, in 1/256 bit
_EXP = np.round(65536 * 2.0 ** (-np.arange(8192) / 512)).astype(np.int64)  # weight by how much more than the best an order has cost


def _low_id(a: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of an id among 2**bits."""
    return ((a * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)


def _low_pair(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of a pair of ids among 2**bits."""
    return ((((a * 0x85EBCA77 + b * 0x9E3779B1) & 0xFFFFFFFF) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - bits)


def _slot_bits(length: np.ndarray) -> np.ndarray:
    return _BITS[np.maximum(length, 1) - 1].astype(np.int64)


def _odds(hits: np.ndarray, every: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Probabilities, of 2**16, of a hit in each state, from its counts and how many hits of one event, in eighths, it starts with."""
    return np.clip((hits * 8 + prior) * _INVERSE[8::8][every] >> 16, 256, _ONE - 256)


def _flags(p: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The events of hits of probability ``p`` and misses."""
    return np.where(hit, (p - 1) << 16, p | (_ONE - 1 - p) << 16)


def _weights(cost: np.ndarray) -> np.ndarray:
    """Shares, of 2**16, of the orders by what each has cost so far (.., 3)."""
    w = _EXP[np.minimum(cost - cost.min(-1, keepdims=True), len(_EXP) - 1)]
    return w * _ONE // w.sum(-1, keepdims=True)


def _cumulative(counts: np.ndarray) -> np.ndarray:
    """Limits, of 2**16, of each symbol by its count so far (.., symbols + 1)."""
    mass = counts * _GAIN + _PRIOR
    out = np.zeros((*mass.shape[:-1], _SYMBOLS + 1), np.int64)
    np.cumsum(mass, -1, out=out[..., 1:])
    out *= _INVERSE[out[..., -1:]]
    out >>= 16
    return out


_SURE2, _SURE1 = np.repeat(_SURE, 3), np.repeat(_SURE, 3)
_SURE0 = np.full(_COUNTS, 4, np.int64)
_SECOND = np.full(_STATES, 2, np.int64)


class _Chains:
    """For each position the one before it with the same context, and the run of right predictions along such links."""

    def __init__(self, address: np.ndarray, same, at: np.ndarray) -> None:
        """``address``: slot of each context; ``same(i, j)``: whether two places of ``at`` have the same context."""
        self.order = np.argsort(address.astype(np.uint16), kind="stable")
        self.place = at[self.order]
        self.linked = np.zeros(len(at), bool)
        if len(at) > 1:
            here, back = self.place[1:], self.place[:-1]
            near = address[self.order]
            self.linked[1:] = (near[1:] == near[:-1]) & same(here, back)

    def runs(self, right: np.ndarray) -> np.ndarray:
        """Run of right predictions up to each (in the order of the chains), 1 at a chain's first."""
        i = np.arange(len(right))
        start = np.where(self.linked, np.where(right, -1, i), i - 1)
        return i - np.maximum.accumulate(start) if len(i) else i


def _events(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(events, row pointers) of blocks [ptr[i], ptr[i+1]) of ``ids``; an event is start | (frequency - 1) << 16, of 2**16."""
    n, length = len(ids), np.diff(ptr)
    bits_of = _slot_bits(length)
    size = 1 << bits_of
    block = np.repeat(np.arange(len(length)), length)
    spot = np.arange(n)
    t = spot - ptr[block]
    base = (np.cumsum(size) - size)[block]
    bits = bits_of[block]

    # order 0: the last place of the same id, and how often it was met; order 1: what follows such places
    zero = _Chains(base + _low_id(ids, bits), lambda i, j: ids[i] == ids[j], spot)
    link = np.flatnonzero(zero.linked)
    here, back = zero.place[link], zero.place[link - 1]
    before0 = np.full(n, -1)
    before0[here] = back
    times = np.empty(n, np.int64)
    times[zero.place] = zero.runs(zero.linked)
    before1 = np.full(n + 1, -1)
    before1[here + 1] = back + 1
    before1 = before1[:n]
    before1[ptr[:-1][length > 0]] = -1
    can = np.flatnonzero(before1 >= 0)
    back1 = before1[can]
    told1, x = ids[back1], ids[can]
    right1 = told1 == x
    right = np.zeros(n + 1, bool)
    right[can] = right1
    run = np.empty(n + 1, np.int64)
    run[zero.place + 1] = zero.runs(right[zero.place + 1])
    state1 = _RUN[np.minimum(run[back1], 7)]

    # order 2, where order 1 has a prediction too
    at = np.flatnonzero(t >= 2)
    a, b = ids[at - 2], ids[at - 1]
    two = _Chains(base[at] + _low_pair(a, b, bits[at]), lambda i, j: (ids[i - 1] == ids[j - 1]) & (ids[i - 2] == ids[j - 2]), at)
    link = np.flatnonzero(two.linked)
    here, back = two.place[link], two.place[link - 1]
    before2 = np.full(n, -1)
    before2[here] = back
    right = np.zeros(n, bool)
    right[here] = ids[back] == ids[here]
    run = np.empty(n, np.int64)
    run[two.place] = two.runs(right[two.place])
    back2 = before2[can]
    has2 = np.flatnonzero(back2 >= 0)
    state2, kind = np.zeros(len(can), np.int64), np.zeros(len(can), np.int64)
    told, hit, back = told1.copy(), right1.copy(), back1.copy()
    back[has2] = back2[has2]
    told[has2] = ids[back[has2]]
    hit[has2] = told[has2] == x[has2]
    state2[has2] = _RUN[np.minimum(run[back[has2]], 7)]
    kind[has2] = 1 + (told[has2] == told1[has2])

    # rows of statistics: one for each block and step
    rows = np.where(length > 0, _STEP[np.maximum(length, 1) - 1] + 1, 0)
    row0 = np.cumsum(rows) - rows
    row = row0[block] + _STEP[t]
    total = int(rows.sum())
    lead = np.repeat(row0, rows)

    def earlier(counts: np.ndarray) -> np.ndarray:
        """Sums over a block's earlier rows."""
        sums = np.zeros((len(counts) + 1, counts.shape[1]), np.int64)
        np.cumsum(counts, 0, out=sums[1:])
        return sums[:-1] - sums[lead]

    def known(key: np.ndarray, width: int) -> np.ndarray:
        return earlier(np.bincount(key, minlength=total * width).reshape(total, width))

    # 1: the prediction of the highest order that has one
    r = row[can]
    key2, key1, key0 = state2 * 3 + kind, state1 * 3 + kind, np.minimum(_BITS[times[back]], _COUNTS - 1)
    miss = ~hit
    flip = miss * _ONE
    chance, cost = [], np.empty((total, 3), np.int64)
    edge = np.searchsorted(r, np.arange(total + 1))
    sums = np.zeros(len(can) + 1, np.int64)
    for o, (key, width, prior) in enumerate(((key2, 3 * _STATES, _SURE2), (key1, 3 * _STATES, _SURE1), (key0, _COUNTS, _SURE0))):
        k = r * width + key
        odds = _odds(known(k[hit], width), known(k, width), prior).ravel()[k]
        chance.append(odds)
        np.cumsum(_LOG[np.abs(odds - flip) >> 4], out=sums[1:])
        cost[:, o] = earlier(np.diff(sums[edge])[:, None])[:, 0]
    w = np.ascontiguousarray(_weights(cost).T)
    p = w[0][r] * chance[0]
    p += w[1][r] * chance[1]
    p += w[2][r] * chance[2]
    p >>= 16
    slots = np.zeros((n, 5 if n and int(ids.max()) >> 16 else 4), np.uint32)
    slots[can, 0] = _flags(np.clip(p, 64, _ONE - 64), hit)

    # 2: the order-1 prediction
    other = np.flatnonzero(miss & (kind == 1))
    hit2 = right1[other]
    k = r[other] * _STATES + state1[other]
    slots[can[other], 1] = _flags(_odds(known(k[hit2], _STATES), known(k, _STATES), _SECOND).ravel()[k], hit2)

    # 3: the symbol
    miss[other] = ~hit2
    rest = before1 < 0
    rest[can] = miss
    at = np.flatnonzero(rest)
    r, back = row[at], before0[at]
    near = back >= 0
    value = np.where(near, at - back, ids[at])
    if slots.shape[1] == 5:
        high = value >> 16
        long = np.where(high > 0, 16 + _BITS[high & 0xFFFF].astype(np.int64), _BITS[value & 0xFFFF])
    else:
        long = _BITS[value].astype(np.int64)
    symbol = long + np.where(near, -1, _NEAR)
    limits = _cumulative(known(r * _SYMBOLS + symbol, _SYMBOLS)).ravel()
    k = r * (_SYMBOLS + 1) + symbol
    start = limits[k]
    slots[at, 2] = start | (limits[k + 1] - start - 1) << 16

    # 4: the bits below the highest, at most 15 at once
    value -= (1 << long) >> 1
    if slots.shape[1] == 5:
        c = 32 - np.maximum(long, 17)
        slots[at, 4] = np.where(long > 16, (value >> 15) << c | ((1 << c) - 1) << 16, 0)
        value &= (1 << 15) - 1
    c = 17 - np.clip(long, 1, 16)
    slots[at, 3] = np.where(long > 1, value << c | ((1 << c) - 1) << 16, 0)
    flat = slots.ravel()
    used = np.flatnonzero(flat)
    return flat[used], np.searchsorted(used, ptr * slots.shape[1])


def _code(events: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words, row pointers) of the range coders of all blocks: 48-bit low, carries settled at the end."""
    length = np.diff(ptr)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    lanes = int((length > 0).sum())
    next_, room = ptr[:-1][order].copy(), length + 3
    origin = np.cumsum(room) - room
    pos = origin.copy()
    out = np.zeros(int(room.sum()), np.uint32)
    low, span = np.zeros(len(order), _U), np.full(len(order), 1 << 48, _U)

    def emit(at: np.ndarray) -> None:
        place, value = pos[at], low[at]
        out[place] = value >> _U(32)
        pos[at] = place + 1
        low[at] = (value & _U(0xFFFFFFFF)) << _U(16)

    active = np.searchsorted(-length, -np.arange(int(length[0]) if lanes else 0), "left")
    event, start, wide, part = np.empty(lanes, np.uint32), np.empty(lanes, np.uint32), np.empty(lanes, _U), np.empty(lanes, bool)
    for m in active.tolist():
        here, step, e, a, w = next_[:m], span[:m], event[:m], start[:m], wide[:m]
        np.take(events, here, out=e, mode="clip")
        here += 1
        np.bitwise_and(e, _LOW, out=a)
        e >>= _HALF
        e += _ONE32
        step >>= _WORD
        np.multiply(step, a, out=w)
        low[:m] += w
        step *= e
        small = np.flatnonzero(np.less(step, _LEAST, out=part[:m]))
        if len(small):
            emit(small)
            span[small] <<= _WORD
    for _ in range(3):
        emit(np.arange(lanes))
    used = pos - origin
    back = np.argsort(order, kind="stable")
    end = np.cumsum(used[back])
    spot = np.arange(int(end[-1]) if len(end) else 0) + np.repeat((origin[back] - (end - used[back])), used[back])
    words = out[spot]
    while True:
        over = np.flatnonzero(words >> 16)
        if not len(over):
            return words.astype(np.uint16), np.concatenate([[0], end])
        words[over] &= 0xFFFF
        words[over - 1] += 1


def modelled(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(events, row pointers) of blocks [ptr[i], ptr[i+1]) of ids, none of them longer than BLOCK."""
    if len(ids) and (int(ids.min()) < 0 or int(np.diff(ptr).max()) > BLOCK):
        raise ValueError("an id is negative or a block too long")
    events, sizes, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    while at < len(ptr) - 1:
        end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + CHUNK, "right")) - 1)
        e, own = _events(ids[ptr[at] : ptr[end]].astype(np.int64), ptr[at : end + 1] - ptr[at])
        events.append(e)
        sizes.append(own[1:] + sizes[-1][-1])
        at = end
    return np.concatenate(events), np.concatenate(sizes)


def payloads(events: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row pointers): the payloads of blocks of events."""
    words, own = _code(events, ptr)
    return words.astype(">u2").view(np.uint8), own * 2


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of ids."""
    ptr = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype(np.int64)
    raw, own = payloads(*modelled(np.concatenate(blocks) if blocks else np.zeros(0, np.int64), ptr))
    return [raw[a:b].tobytes() for a, b in zip(own[:-1], own[1:])]


class _Decoder:
    """Range decoders, one per lane."""

    def __init__(self, payloads: list[bytes]) -> None:
        lanes = len(payloads)
        longest = max(len(p) for p in payloads) // 2
        self.words = np.zeros((longest + 4, lanes), _U)
        for i, p in enumerate(payloads):
            w = np.frombuffer(p[: len(p) // 2 * 2], ">u2")
            self.words[: len(w), i] = w
        self.code = (self.words[0] << _U(32)) | (self.words[1] << _U(16)) | self.words[2]
        self.range, self.pos = np.full(lanes, 1 << 48, _U), np.full(lanes, 3)

    def value(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.code[at] // (self.range[at] >> _U(16)), _U(_ONE - 1)).astype(np.int64)

    def take(self, at: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        step = self.range[at] >> _U(16)
        self.code[at] -= step * start.astype(_U)
        step *= freq.astype(_U)
        self.range[at] = step
        small = at[step < _U(1 << 32)]
        pos = np.minimum(self.pos[small], len(self.words) - 1)
        self.code[small] = (self.code[small] << _U(16)) | self.words[pos, small]
        self.pos[small] += 1
        self.range[small] <<= _U(16)

    def flag(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        hit = self.value(at) < p
        self.take(at, np.where(hit, 0, p), np.where(hit, p, _ONE - p))
        return hit

    def symbol(self, at: np.ndarray, limits: np.ndarray) -> np.ndarray:
        found = np.minimum((self.value(at)[:, None] >= limits[:, 1:]).sum(1), limits.shape[1] - 2)
        row = np.arange(len(found))
        start = limits[row, found]
        self.take(at, start, limits[row, found + 1] - start)
        return found

    def bits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        found = self.value(at) >> (16 - count)
        self.take(at, found << (16 - count), np.left_shift(1, 16 - count))
        return found


def _decode(coder: _Decoder, length: np.ndarray) -> np.ndarray:
    """ids[t, lane] for t < length[lane]; lanes are sorted by falling length. The same model as in ``_events``, an id of every lane at a time."""
    lanes, longest = len(length), int(length[0])
    every = np.arange(lanes)
    ids = np.full((longest + 1, lanes), -1, np.int64)
    bits = _slot_bits(length)
    last0, last2 = np.full((1 << int(bits[0]), lanes), -1, np.int16), np.full((1 << int(bits[0]), lanes), -1, np.int16)
    run1, run2, times = (np.ones((longest + 1, lanes), np.int16) for _ in range(3))
    count2, count1, count0 = (np.zeros((lanes, w, 2), np.int64) for w in (3 * _STATES, 3 * _STATES, _COUNTS))
    count_second, count_symbol = np.zeros((lanes, _STATES, 2), np.int64), np.zeros((lanes, _SYMBOLS), np.int64)
    cost = np.zeros((lanes, 3), np.int64)
    next1 = np.full(lanes, -1)
    active = np.searchsorted(-length, -np.arange(longest), "left")
    edges = set(_EDGES.tolist())
    for t, m in enumerate(active.tolist()):
        at = every[:m]
        if t in edges:
            odds2, odds1, odds0, odds_second = (_odds(c[:m, :, 1], c[:m].sum(-1), prior) for c, prior in ((count2, _SURE2), (count1, _SURE1), (count0, _SURE0), (count_second, _SECOND)))
            limits, w = _cumulative(count_symbol[:m]), _weights(cost[:m])
        before1 = next1[:m]
        told1 = ids[before1, at]
        state1 = np.where(before1 >= 0, _RUN[np.minimum(run1[before1, at], 7)], 0)
        before2, raw2, told2, state2 = np.full(m, -1), np.full(m, -1), np.full(m, -1), np.zeros(m, np.int64)
        if t >= 2:
            a, b = ids[t - 2, :m], ids[t - 1, :m]
            slot2 = _low_pair(a, b, bits[:m])
            q = last2[slot2, at].astype(np.int64)
            raw2 = np.where((q >= 0) & (ids[q - 1, at] == b) & (ids[q - 2, at] == a), q, -1)
            before2 = np.where(before1 >= 0, raw2, -1)
            last2[slot2, at] = t
            told2 = ids[raw2, at]
            state2 = np.where(before2 >= 0, _RUN[np.minimum(run2[before2, at], 7)], 0)
        x = np.full(m, -1)
        done = np.zeros(m, bool)
        can = np.flatnonzero(before1 >= 0)
        if len(can):
            b2 = before2[can] >= 0
            kind = np.where(b2, 1 + (told1[can] == told2[can]), 0)
            key2, key1 = state2[can] * 3 + kind, state1[can] * 3 + kind
            key0 = np.minimum(_BITS[times[np.where(b2, before2[can], before1[can]), can]], _COUNTS - 1)
            chance = [odds2[can, key2], odds1[can, key1], odds0[can, key0]]
            share = w[can]
            p = np.clip((share[:, 0] * chance[0] + share[:, 1] * chance[1] + share[:, 2] * chance[2]) >> 16, 64, _ONE - 64)
            hit = coder.flag(can, p)
            for o, (counts, key) in enumerate(((count2, key2), (count1, key1), (count0, key0))):
                counts[can, key, hit.astype(np.int64)] += 1
                cost[can, o] += _LOG[np.where(hit, chance[o], _ONE - chance[o]) >> 4]
            won = can[hit]
            x[won] = np.where(before2[won] >= 0, told2[won], told1[won])
            done[won] = True
            other = can[~hit & (kind == 1)]
            if len(other):
                hit = coder.flag(other, odds_second[other, state1[other]])
                count_second[other, state1[other], hit.astype(np.int64)] += 1
                won = other[hit]
                x[won] = told1[won]
                done[won] = True
        rest = np.flatnonzero(~done)
        if len(rest):
            symbol = coder.symbol(rest, limits[rest])
            count_symbol[rest, symbol] += 1
            near = symbol < _NEAR
            long = np.where(near, symbol + 1, symbol - _NEAR)
            count = np.maximum(long - 1, 0)
            value = (1 << long) >> 1
            some = count > 0
            if some.any():
                value[some] += coder.bits(rest[some], np.minimum(count[some], 15))
            many = count > 15
            if many.any():
                value[many] += coder.bits(rest[many], count[many] - 15) << 15
            x[rest] = np.where(near, ids[np.clip(t - value, 0, longest), rest], value)
        ids[t, :m] = x
        slot0 = _low_id(x, bits[:m])
        q = last0[slot0, at].astype(np.int64)
        q = np.where((q >= 0) & (ids[q, at] == x), q, -1)
        last0[slot0, at] = t
        times[t, :m] = np.where(q >= 0, times[q, at] + 1, 1)
        run1[t, :m] = np.where(before1 >= 0, np.where(told1 == x, np.minimum(run1[before1, at] + 1, 99), 0), 1)
        run2[t, :m] = np.where(raw2 >= 0, np.where(told2 == x, np.minimum(run2[raw2, at] + 1, 99), 0), 1)
        next1[:m] = np.where(q >= 0, q + 1, -1)
    return ids


def expand(payloads: list[bytes], lengths: list[int], checks: list[int]) -> list[np.ndarray]:
    """The ids of each block; ValueError if they aren't those of its CRC."""
    order = np.argsort([-n for n in lengths], kind="stable")
    out = [np.zeros(0, np.int32)] * len(payloads)
    for first in range(0, len(order), LANES):
        part = [i for i in order[first : first + LANES] if lengths[i]]
        if part:
            length = np.array([lengths[i] for i in part])
            ids = _decode(_Decoder([payloads[i] for i in part]), length)
            for j, i in enumerate(part):
                out[i] = ids[: length[j], j].astype(np.int32)
    for ids, check in zip(out, checks):
        if zlib.crc32(ids.tobytes()) != check:
            raise ValueError("a block's ids don't have its checksum")
    return out


_FIELDS = [T.StructField("rid", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("crc32", T.LongType()), T.StructField("payload", T.BinaryType())]


def encode_blocks(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, rid, block, n_tokens, crc32, payload): the blocks of every document, numbered from 0; rid is xxhash64(doc_id, text)."""
    arrow_safe(docs.sparkSession)

    def finished(rows: list[dict[str, pa.Array]], events: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        raw, own = payloads(np.concatenate(events), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
        out = {c: pa.concat_arrays([r[c] for r in rows]) for c in rows[0]}
        null = np.asarray(out["n_tokens"].is_null())
        out["payload"] = pa.Array.from_buffers(pa.binary(), len(null), [pa.array(~null).buffers()[1], pa.py_buffer(own.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library(vocabulary)
        rows, events, sizes, blocks, held = [], [], [], 0, 0
        for batch in (b for whole in batches for b in _pieces_of(whole, "text")):
            text = batch.column("text")
            gone = np.asarray(text.is_null())
            flat, ptr = encoded(text, coder)
            count = np.maximum(-(-np.diff(ptr) // BLOCK), 1)
            row = np.repeat(np.arange(len(count)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            limits = np.append(ptr[row] + number * BLOCK, len(flat))
            view = memoryview(flat)
            checks = [zlib.crc32(view[a:b]) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
            at, gone = pa.array(row), gone[row]
            rows.append({
                "doc_id": batch.column("doc_id").take(at), "rid": batch.column("rid").take(at), "block": pa.array(number.astype(np.int32)),
                "n_tokens": pa.array(np.diff(limits).astype(np.int32), mask=gone), "crc32": pa.array(np.array(checks, np.int64), mask=gone),
            })
            e, own = modelled(flat, limits)
            events.append(e)
            sizes.append(np.diff(own))
            blocks, held = blocks + len(row), held + len(e)
            if blocks >= TOGETHER or held >= MOST_EVENTS:
                yield finished(rows, events, sizes)
                rows, events, sizes, blocks, held = [], [], [], 0, 0
        if rows:
            yield finished(rows, events, sizes)

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *_FIELDS]))


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, rid, block, token_ids) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens")
            known = [i for i, v in enumerate(n.to_pylist()) if v is not None]
            ids: list = [None] * batch.num_rows
            data = [batch.column(c).to_pylist() for c in ("payload", "n_tokens", "crc32")]
            for i, v in zip(known, expand(*([d[i] for i in known] for d in data))):
                ids[i] = v
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "rid", "block")}, "token_ids": pa.array(ids, pa.list_(pa.int32()))})

    kind = T.StructType([blocks.schema["doc_id"], *_FIELDS[:2], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return blocks.select("doc_id", "rid", "block", "n_tokens", "crc32", "payload").mapInArrow(run, kind)


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, token_ids): the documents whole again, one row per document of a rid. Rows that repeat doc_id and text give one; other texts of a doc_id give rows of their own; a NULL text gives NULL ids."""
    parts = decode_blocks(blocks.dropDuplicates(["rid", "block"])).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("block", "token_ids"))).alias("parts"))
    return parts.select("doc_id", F.flatten(F.transform("parts", lambda p: p["token_ids"])).alias("token_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_blocks(read(spark, sf_dir, "documents"))
