"""Context-mixing range coder for token ids, run over many independent blocks in lockstep with numpy.

Within a block, ids are known by their place in the order of first appearance. Three predictions are made of each:
the id that last followed the previous two (order 2), the one that last followed the previous one (order 1), and the
counts of all ids of the block so far (order 0). Whether the order-2 guess is right is coded with a probability that a
small logistic mixer makes of the records of both guesses and of the order-0 probability of the guessed id; if it is
wrong, whether the order-1 guess is right, by a second mixer over orders 1 and 0. If that is wrong too, an adaptive
flag tells ids that are new to the block: a known one is coded by its order-0 probability, a new one by its bit length
under adaptive counts and the bits below the leading one. Everything goes through the range coder, and all arithmetic
is on integers, so that any machine decodes what another has written. Ids have up to 32 bits. Every block starts from
the same empty state.

A block's bytes are the coder's words (32 bits, little-endian).
"""

from __future__ import annotations

import math

import numpy as np

BLOCK_IDS = 2048  # and the most ids that a block can hold
SLOTS = 1 << 10
CLASSES = 33  # bit lengths of ids
REFRESH = 32  # ids between two refreshes of the distribution of bit lengths
_P2, _P1, _PN, _P0 = 10, 8, 8, 12  # bits of the probabilities; those of the three flags sum to less than 32
_32, _1, _16 = np.uint64(32), np.uint64(1), np.uint64(16)
_LOW = np.uint64((1 << 32) - 1)
_ALL = np.uint64((1 << 64) - 1)
#: squash[d + 2048] = 4096 / (1 + exp(-d / 256)); stretch is its inverse
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2048, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
#: a context holds its guess and, in the low four bits, how often it was right of late
_RIGHT = np.array([min(c + 1, 15) for c in range(16)], np.int32)
_WRONG = np.array([c >> 1 for c in range(16)], np.int32)
#: bits stored below the leading one, and the least id, of each class
_DOWN = np.array([max(k - 1, 0) for k in range(CLASSES)], np.uint64)
_BASE = np.array([1 << k >> 1 for k in range(CLASSES)], np.uint64)
_STEP = np.arange(16)


class _Lanes:
    """The models of ``n`` blocks; ids are places in the order of first appearance."""

    def __init__(self, n: int) -> None:
        self.lane = np.arange(n)
        self.table = [np.zeros(n * SLOTS, np.int32) for _ in range(2)]
        self.hit2 = np.full(n * 16, 1 << 15, np.int32)  # by the order-2 guess's record
        self.hit1 = np.full(n * 32, 1 << 15, np.int32)  # by the order-1 guess's record and whether both agree
        self.fresh = np.full(n * 8, 1 << 15, np.int32)  # whether a missed id is new, by the last three
        self.w2 = [np.full(n, w, np.int32) for w in (40_000, 40_000, 8_000)]  # orders 2, 1, 0
        self.w1 = [np.full(n, w, np.int32) for w in (45_000, 12_000)]  # orders 1, 0
        self.count = np.ones(n * CLASSES, np.int32)
        # order 0: counts of ids, and their sums over 16 and 256
        self.c0, self.c1, self.c2 = np.zeros(n * 8, np.int32), np.zeros(n * 128, np.int32), np.zeros(n * 2048, np.int32)
        self.a = self.b = np.zeros(n, np.int32)
        self.news = np.zeros(n, np.int32)
        self.t = 0
        self.slots, self.of2, self.of1, self.of0, self.ofn = self.lane * SLOTS, self.lane * 16, self.lane * 32, self.lane * CLASSES, self.lane * 8
        self.ofc = self.lane * 2048

    def refresh(self) -> None:
        c = self.count.reshape(-1, CLASSES).astype(np.int64)
        total = c.sum(axis=1, keepdims=True)
        ends = np.cumsum(c, axis=1) * ((1 << _P0) - CLASSES) // total + np.arange(1, CLASSES + 1)
        self.ends = ends
        self.flat_ends = ends.reshape(-1)
        self.flat_sizes = np.diff(ends, axis=1, prepend=0).reshape(-1)
        self.count = np.where(total > 1 << 12, c + 1 >> 1, c).astype(np.int32).reshape(-1)

    def look(self) -> None:
        h = self.a * 40503
        self.at1 = self.slots + (h >> 3 & SLOTS - 1)
        self.at2 = self.slots + (h + self.b * 25717 >> 4 & SLOTS - 1)
        self.e1, self.e2 = self.table[0].take(self.at1), self.table[1].take(self.at2)
        self.g1, self.g2 = self.e1 >> 4, self.e2 >> 4
        self.s1, self.s2 = self.e1 & 15, self.e2 & 15
        self.same = self.g1 == self.g2
        self.i2 = self.of2 + self.s2
        self.i1 = self.of1 + (self.s1 + (self.same.view(np.int8) << 4))
        self.h2, self.h1 = self.hit2.take(self.i2), self.hit1.take(self.i1)
        self.st2, self.st1 = _STRETCH.take(self.h2 >> 4), _STRETCH.take(self.h1 >> 4)
        self.z2, self.z1 = (_STRETCH.take(np.minimum((self.c2.take(self.ofc + g) << 12) // (self.t + 2), 4095)) for g in (self.g2, self.g1))
        # a quarter of the weights keeps the products within 32 bits
        dot = (self.w2[0] >> 2) * self.st2 + (self.w2[1] >> 2) * self.st1 + (self.w2[2] >> 2) * self.z2 >> 14
        self.m2 = _SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2048)
        dot = (self.w1[0] >> 2) * self.st1 + (self.w1[1] >> 2) * self.z1 >> 14
        self.m1 = _SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2048)
        self.p2 = np.maximum(self.m2 >> 12 - _P2, 1).astype(np.uint64)
        self.p1 = np.maximum(self.m1 >> 12 - _P1, 1).astype(np.uint64)
        self.iN = self.ofn + self.news
        self.hN = self.fresh.take(self.iN)
        self.pn = np.minimum(np.maximum(self.hN >> 16 - _PN, 1), (1 << _PN) - 1).astype(np.uint64)

    def learn(self, slots: np.ndarray, y2: np.ndarray, y1: np.ndarray, new: np.ndarray, missed: np.ndarray) -> None:
        """``y1``: whether the order-1 guess was right, asked for or not; ``missed``: neither guess was right."""
        one = y2.astype(np.int32)
        err = ((one << 12) - self.m2) * 6
        self.w2 = [np.minimum(np.maximum(w + (st * err >> 16), -160_000), 160_000) for w, st in zip(self.w2, (self.st2, self.st1, self.z2))]
        asked = ~(y2 | self.same)
        err = ((y1.astype(np.int32) << 12) - self.m1) * 6 * asked
        self.w1 = [np.minimum(np.maximum(w + (st * err >> 16), -200_000), 200_000) for w, st in zip(self.w1, (self.st1, self.z1))]
        self.hit2[self.i2] = self.h2 + (one * 65535 - self.h2 >> 5)
        self.hit1[self.i1] = self.h1 + (y1 * np.int32(65535) - self.h1 >> 5)
        self.fresh[self.iN] = np.where(missed, self.hN + (new * np.int32(65535) - self.hN >> 5), self.hN)
        self.news = (self.news << 1 | new) & 7
        entry = slots << 4
        for table, at, e, s, y in ((self.table[0], self.at1, self.e1, self.s1, y1), (self.table[1], self.at2, self.e2, self.s2, y2)):
            kept = np.where(y, _RIGHT.take(s), _WRONG.take(s)) + (e - s)
            table[at] = np.where((s <= 1) & ~y, entry, kept)
        at = self.ofc + slots
        self.c2[at] += 1
        self.c1[at >> 4] += 1
        self.c0[at >> 8] += 1
        self.t += 1
        self.b, self.a = self.a, slots

    def rows(self, k: np.ndarray, top: np.ndarray | None, mid: np.ndarray | None) -> np.ndarray:
        """Order-0 sums of lanes ``k``: over 256 ids, over 16 within ``top``, or of single ids within ``mid``."""
        if top is None:
            return self.c0.reshape(-1, 8)[k]
        if mid is None:
            return self.c1.reshape(-1, 16)[k * 8 + top]
        return self.c2.reshape(-1, 16)[k * 128 + mid]


def _settle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a coder word can go out. Small intervals astride a word's edge are cut to their larger side, in place."""
    small = np.flatnonzero(hi - lo < _LOW)
    if len(small):
        a, b = lo[small], hi[small]
        edge = b & ~_LOW
        astride = edge > a
        left = astride & (edge - a > b - edge)
        hi[small] = np.where(left, edge - _1, b)
        lo[small] = np.where(astride & ~left, edge, a)
    return lo ^ hi <= _LOW


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id of each row: its place in the order of first appearance, and whether it appears first here."""
    n, length = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, axis=1)
    start = np.ones((n, length), bool)
    start[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    at = np.maximum.accumulate(np.where(start, np.arange(length), 0), axis=1)
    first = np.empty_like(order)
    np.put_along_axis(first, order, np.take_along_axis(order, at, axis=1), axis=1)
    new = first == np.arange(length)
    return np.take_along_axis(np.cumsum(new, axis=1) - 1, first, axis=1), new


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


class _Out:
    """Coder words as they go out, by phase."""

    def __init__(self, n: int, phases: int) -> None:
        self.words, self.goes, self.at = np.zeros((phases, n), np.uint32), np.zeros((phases, n), bool), 0

    def send(self, lo: np.ndarray, hi: np.ndarray, k=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        go = _settle(lo, hi)
        self.goes[self.at, k] = go
        self.words[self.at, k] = lo >> _32
        self.at += 1
        s = go * _32
        return lo << s, hi << s | (_1 << s) - _1


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids``: blocks x length, under 2 ** 32, of at most ``BLOCK_IDS`` columns. The bytes of each block."""
    n, length = ids.shape
    if length > BLOCK_IDS:
        raise ValueError(f"a block holds at most {BLOCK_IDS} ids")
    m, out = _Lanes(n), _Out(n, 3 * length + 2)
    lo, hi = np.zeros(n, np.uint64), np.full(n, _ALL, np.uint64)
    places, firsts = _places(ids)
    places, firsts = np.ascontiguousarray(places.T, np.int32), np.ascontiguousarray(firsts.T)
    columns = np.ascontiguousarray(ids.T, np.uint64)
    for t in range(length):
        if t % REFRESH == 0:
            m.refresh()
        x, new = places[t], firsts[t]
        m.look()
        y2, y1 = (x == m.g2) & ~new, (x == m.g1) & ~new
        cut = lo + (hi - lo >> np.uint64(_P2)) * m.p2
        hi, lo = np.where(y2, cut - _1, hi), np.where(y2, lo, cut)
        ask = ~(y2 | m.same)
        cut = lo + (hi - lo >> np.uint64(_P1)) * m.p1
        hi, lo = np.where(ask & y1, cut - _1, hi), np.where(ask & ~y1, cut, lo)
        missed = ~(y2 | y1)
        cut = lo + (hi - lo >> np.uint64(_PN)) * m.pn
        hi, lo = np.where(missed & new, cut - _1, hi), np.where(missed & ~new, cut, lo)
        lo, hi = out.send(lo, hi)
        k = np.flatnonzero(missed & ~new)
        if len(k):
            s = x[k].astype(np.int64)
            each = np.arange(len(k))
            below, size = np.zeros(len(k), np.int64), None
            for row, j in ((m.rows(k, None, None), s >> 8), (m.rows(k, s >> 8, None), s >> 4 & 15), (m.rows(k, s >> 8, s >> 4), s & 15)):
                size = row[each, j]
                below += row.cumsum(axis=1)[each, j] - size
            a = lo[k]
            r = (hi[k] - a) // np.uint64(t)
            a += r * below.astype(np.uint64)
            lo[k], hi[k] = out.send(a, a + (r * size.astype(np.uint64) - _1), k)
        k = np.flatnonzero(new)
        if len(k):
            value = columns[t][k]
            c = _bit_lengths(value)
            at, down = m.of0[k] + c, _DOWN[c]
            low = value - _BASE[c]
            a = lo[k]
            r, f = hi[k] - a >> np.uint64(_P0), m.flat_sizes.take(at)
            a += r * (m.flat_ends.take(at) - f).astype(np.uint64)
            r *= f.astype(np.uint64)
            bits = np.minimum(down, _16)
            r >>= bits
            a += r * (low & (_1 << bits) - _1)
            lo[k], hi[k] = out.send(a, a + (r - _1), k)
            m.count[at] += 24
            k, low, down = k[down > _16], low[down > _16], down[down > _16]
            if len(k):
                a = lo[k]
                r = hi[k] - a >> down - _16
                a += r * (low >> _16)
                lo[k], hi[k] = out.send(a, a + (r - _1), k)
        m.learn(x, y2, y1, new, missed)
    out.words[out.at], out.words[out.at + 1] = lo >> _32, lo & _LOW
    out.goes[out.at : out.at + 2] = True
    goes = out.goes[: out.at + 2]
    sent = np.ascontiguousarray(out.words[: out.at + 2].T)[np.ascontiguousarray(goes.T)].astype("<u4")
    return [w.tobytes() for w in np.split(sent, np.cumsum(goes.sum(axis=0))[:-1])]


def decode_blocks(blocks: list[bytes], length: int) -> np.ndarray:
    """The ids of blocks that ``encode_blocks`` made: blocks x length."""
    n = len(blocks)
    m = _Lanes(n)
    words = np.frombuffer(b"".join(blocks) + bytes(8), "<u4").astype(np.uint64)
    at = np.cumsum([0, *(len(b) // 4 for b in blocks[:-1])])
    most = len(words) - 1
    lo, hi, v = np.zeros(n, np.uint64), np.full(n, _ALL, np.uint64), words[at] << _32 | words[at + 1]
    at = at + 2
    known = np.zeros((n, length), np.uint64)  # the ids of each block in the order of first appearance
    seen = np.zeros(n, np.int64)
    ids = np.zeros((length, n), np.uint64)

    def take(a: np.ndarray, b: np.ndarray, k=slice(None)) -> None:
        go = _settle(a, b)
        s = go * _32
        lo[k], hi[k] = a << s, b << s | (_1 << s) - _1
        w = at[k]
        v[k] = np.where(go, v[k] << _32 | words.take(np.minimum(w, most)), v[k])
        at[k] = w + go

    for t in range(length):
        if t % REFRESH == 0:
            m.refresh()
        m.look()
        cut = lo + (hi - lo >> np.uint64(_P2)) * m.p2
        y2 = v < cut
        b, a = np.where(y2, cut - _1, hi), np.where(y2, lo, cut)
        ask = ~(y2 | m.same)
        cut = a + (b - a >> np.uint64(_P1)) * m.p1
        y1 = ask & (v < cut)
        b, a = np.where(y1, cut - _1, b), np.where(ask & ~y1, cut, a)
        missed = ~(y2 | y1)
        cut = a + (b - a >> np.uint64(_PN)) * m.pn
        new = missed & (v < cut)
        b, a = np.where(new, cut - _1, b), np.where(missed & ~new, cut, a)
        take(a, b)
        x = np.where(y2, m.g2, m.g1)
        k = np.flatnonzero(missed & ~new)
        if len(k):
            each = np.arange(len(k))
            a = lo[k]
            r = (hi[k] - a) // np.uint64(max(t, 1))
            u = np.minimum((v[k] - a) // r, np.uint64(max(t, 1) - 1)).astype(np.int64)
            below, size, s, top = np.zeros(len(k), np.int64), None, None, None
            for level in range(3):
                row = m.rows(k, None if level == 0 else top, s if level == 2 else None)
                ends = row.cumsum(axis=1)
                j = np.minimum((ends <= u[:, None]).sum(axis=1), row.shape[1] - 1)
                size = row[each, j]
                skip = ends[each, j] - size
                below, u = below + skip, u - skip
                s = j if level == 0 else s * 16 + j
                top = s if level == 0 else top
            x[k] = s
            a += r * below.astype(np.uint64)
            take(a, a + (r * size.astype(np.uint64) - _1), k)
        k = np.flatnonzero(new)
        if len(k):
            a = lo[k]
            r = hi[k] - a >> np.uint64(_P0)
            u = np.minimum((v[k] - a) // r, np.uint64((1 << _P0) - 1)).astype(np.int64)
            c = np.minimum((m.ends[k] <= u[:, None]).sum(axis=1), CLASSES - 1)
            place, down = m.of0[k] + c, _DOWN[c]
            f = m.flat_sizes.take(place)
            a += r * (m.flat_ends.take(place) - f).astype(np.uint64)
            r *= f.astype(np.uint64)
            bits = np.minimum(down, _16)
            r >>= bits
            low = np.minimum((v[k] - a) // r, (_1 << bits) - _1)
            a += r * low
            take(a, a + (r - _1), k)
            m.count[place] += 24
            wide = down > _16
            if wide.any():
                w, extra = k[wide], down[wide] - _16
                a = lo[w]
                r = hi[w] - a >> extra
                more = np.minimum((v[w] - a) // r, (_1 << extra) - _1)
                a += r * more
                take(a, a + (r - _1), w)
                low[wide] |= more << _16
            x[k] = seen[k]
            known[k, seen[k]] = _BASE[c] + low
            seen[k] += 1
        ids[t] = known[m.lane, x]
        x = x.astype(np.int32)
        m.learn(x, y2, (x == m.g1) & ~new, new, missed)
    return ids.T
