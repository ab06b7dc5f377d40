"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block holds up to BLOCK ids. Its distinct ids are listed once, and ids are coded as ranks in that list. The probability of a rank
is a mixture of three models: (count(rank) + e2 * [order 2 says rank] + e1 * [order 1 says rank]) / (ORDER0 + e2 + e1). Order 2 says the rank that last
followed the two ranks before (told apart by SLOTS hashes), order 1 the one that last followed the rank before, and order 0 has the ranks' counts so far, scaled to
ORDER0. The weights e2 and e1 depend on how often either context has been right in a row, on whether they agree, and on whether one of them was right for the
id before, and follow how often each has been right in this block. Counts and weights take effect at
ever wider steps (FIRST, then at twice as many ids).

A rank has one interval, its order-0 interval widened by what the contexts add to it, so nothing is spent on an escape. Blocks do not
depend on each other, so many are coded in step: each numpy call works on one id of every block. All
arithmetic is on whole numbers below 2**53 in float64, hence exact. The range has 48 bits and gives 24-bit words, one for an id at most; a carry is
added to the word before and passed on at the end. An encoder knows all ids, so it asks the models for a whole block at once, and only the range goes step by step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np

BLOCK, FIRST, SLOTS, ORDER0 = 8192, 64, 4096, 1 << 14
#: Blocks that are coded in step.
LANES = 512
TOP, WORD = float(1 << 48), float(1 << 24)
HEADER = struct.Struct("<4sIIIII")  # magic, ids, distinct ids, bytes of their list, bytes of code, crc32 of the ids
MAGIC = b"CMB5"
#: Contexts: runs of order 2 (0: not seen, 1: seen, 2: right the last time, to LONGEST), of order 1, whether both say the same, and whether one was right for the id before.
LONGEST = 3
CLASSES = 4 * (LONGEST + 1) ** 2


def _prior() -> np.ndarray:
    """Starting counts of (order 2 right, only order 1 right, neither) by context."""
    out = np.empty((CLASSES, 3))
    for c in range(CLASSES):
        k2, k1, agree = c >> 4, c >> 2 & 3, c >> 1 & 1
        two = (0.01, 0.35, 0.7, 0.9)[k2]
        one = 0.0 if agree else (1 - two) * (0.01, 0.15, 0.35, 0.5)[k1]
        out[c] = 6 * two, 6 * one, 6 * (1 - two - one)
    return out


def _weights(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of orders 2 and 1 from how often they were right (last axis as in _prior)."""
    return tuple(np.floor(np.minimum(seen[..., i] / seen[..., 2], 60.0) * ORDER0) for i in (0, 1))


def _times(coded: np.ndarray, n: int) -> np.ndarray:
    """What codes (4 * context + 2 * whether order 2 was right + whether order 1 was) of n contexts add to what was seen."""
    times = np.bincount(coded, minlength=n * 4).reshape(-1, 4)
    return np.stack([times[:, 2] + times[:, 3], times[:, 1], times[:, 0]], 1)


def _turns(size: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches between which counts and weights take effect."""
    at, stop = 0, FIRST
    while at < size:
        yield at, min(stop, size)
        at, stop = stop, 2 * stop


class _Lanes:
    """The models of all blocks that are decoded in step, from nothing. `one` has by rank what order 1 says, as a place in low times 4, and its run, `two` the same of order 2 by slot."""

    def __init__(self, distinct: np.ndarray, steps: int):
        n = self.n = len(distinct)
        self.base = np.concatenate([[0], np.cumsum(distinct + 1)])  # each lane has one place more, for its end
        self.distinct = distinct
        size = int(self.base[-1])
        self.count, self.low, self.wide = np.zeros(size, np.uint16), np.zeros(size, np.float32), np.zeros(size, np.uint16)
        self.one, self.two = (np.repeat(self.base[:-1].astype(np.int32) << 2, k) for k in (distinct + 1, SLOTS))
        self.seen = np.tile(_prior(), (n, 1))
        self.coded, self.ranks = np.zeros((steps, n), np.uint8), np.zeros((steps, n), np.uint16)
        #: The rank at each of the ORDER0 places of every lane.
        self.table = np.zeros(n * ORDER0, np.uint16)
        self.refresh()

    def refresh(self) -> None:
        self.e2, self.e1 = _weights(self.seen)
        self.total = self.e2 + self.e1 + ORDER0
        # Counts so far of each lane in 0 .. ORDER0, each rank at least 1. A few lanes at a time, so that little is held meanwhile.
        for first in range(0, self.n, 16):
            distinct, begin = self.distinct[first : first + 16], self.base[first : first + 17]
            part, base = slice(begin[0], begin[-1]), begin[:-1] - begin[0]
            last, lane_of = base + distinct, np.repeat(np.arange(len(base)), distinct + 1)
            weight = self.count[part] * 4.0 + 0.5
            weight[last] = 0
            c = np.concatenate([[0.0], np.cumsum(weight)])
            # By lane from 0 on, as the encoder adds up.
            share = (ORDER0 - distinct) / np.add.reduceat(weight, base)
            below = c[:-1] - c[base][lane_of]
            rank = np.arange(len(weight)) - base[lane_of]
            low = np.floor(below * share[lane_of]) + rank
            low[last] = ORDER0
            wide = np.diff(low, append=0.0)
            wide[last] = 0
            self.low[part], self.wide[part] = low, wide
            self.table[first * ORDER0 : (first + len(base)) * ORDER0] = np.repeat(rank.astype(np.uint16), wide.astype(np.int64))

    def turn(self, part: slice) -> None:
        """Take the steps of a stretch into counts and weights. Lanes that have ended count on, and nobody asks them."""
        for at in range(part.start, part.stop, 512):
            some = slice(at, min(at + 512, part.stop))
            self.count += np.bincount((self.ranks[some] + self.base[:-1]).ravel(), minlength=len(self.count)).astype(np.uint16)
            self.seen += _times((self.coded[some] + np.arange(self.n) * (4 * CLASSES)).ravel(), self.n * CLASSES)
        self.refresh()


def _said(rank: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a block the rank that last followed its context (0 if nothing followed it yet), and its run."""
    order = np.argsort(context, kind="stable")
    c, r = context[order], rank[order]
    again = np.zeros(len(c), bool)
    again[1:] = c[1:] == c[:-1]
    said = np.zeros_like(r)
    said[1:] = r[:-1]
    said *= again
    # Ids since the last one that was first or wrong.
    place = np.arange(len(c))
    since = place - np.maximum.accumulate(np.where((r == said) & again, -1, place))
    run = again.astype(np.uint8)
    run[1:] += np.minimum(since[:-1], LONGEST - 1).astype(np.uint8) * again[1:]
    out = np.empty_like(said), np.empty_like(run)
    out[0][order], out[1][order] = said, run
    return out


def _intervals(rank: np.ndarray, distinct: int) -> np.ndarray:
    """Begin, width and total of each id of a block (below 2**24, so float32 holds them): all that the models say, as their contexts are known when a block is encoded."""
    before = np.zeros((2, len(rank)), np.uint16)
    before[0, 1:], before[1, 2:] = rank[:-1], rank[:-2]
    q1, run1 = _said(rank, before[0])
    q2, run2 = _said(rank, before[0] * np.uint16(509) + before[1] & np.uint16(SLOTS - 1))
    right1, right2 = q1 == rank, q2 == rank
    context = run2 * 16 + run1 * 4 + (q1 == q2) * np.uint8(2)
    context[1:] += (right1 | right2)[:-1]
    coded = context * 4 + right2 * np.uint8(2) + right1
    # Counts and weights by stretch: what all stretches before have.
    n = len(turns := list(_turns(len(rank))))
    stretch = np.repeat(np.arange(n, dtype=np.int32), [b - a for a, b in turns])
    upto = lambda x: np.cumsum(x, 0) - x
    e2, e1 = _weights(_prior() + upto(_times(coded + stretch * (4 * CLASSES), n * CLASSES).reshape(n, CLASSES, 3)))
    weight = np.zeros((n, distinct + 1))
    weight[:, 1:] = np.cumsum(upto(np.bincount(rank + stretch * distinct, minlength=n * distinct).reshape(n, distinct)) * 4 + 0.5, 1)
    low = np.floor(weight * ((ORDER0 - distinct) / weight[:, -1:])) + np.arange(distinct + 1)
    low[:, -1] = ORDER0
    at = stretch * (distinct + 1)
    here = low.take(at + rank)
    w2, w1 = (e.take(context + stretch * CLASSES) for e in (e2, e1))
    out = np.empty((3, len(rank)), np.float32)
    out[0] = here + w2 * (low.take(at + q2) < here) + w1 * (low.take(at + q1) < here)
    out[1] = low.take(at + rank + 1) - here + w2 * right2 + w1 * right1
    out[2] = w2 + w1 + ORDER0
    return out


def _list_distinct(ids: np.ndarray) -> bytes:
    gap = np.diff(ids, prepend=-1) - 1
    wide = gap >= 255
    return zlib.compress(np.minimum(gap, 255).astype(np.uint8).tobytes() + gap[wide].astype("<u4").tobytes(), 1)


def _read_distinct(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    gap = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(data[n:], "<u4")
    return np.cumsum(gap + 1) - 1


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's rank among them."""
    if ids.max() >= 1 << 18:
        distinct, rank = np.unique(ids, return_inverse=True)
        return distinct, rank.astype(np.uint16)
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    distinct = np.flatnonzero(seen)
    of = np.zeros(len(seen), np.uint16)
    of[distinct] = np.arange(len(distinct))
    return distinct, of.take(ids)


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of about equal size, of at most BLOCK ids each, with headers; LANES of them in step."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks: list[bytes] = []
    bounds = np.arange(n_blocks + 1) * len(ids) // max(n_blocks, 1)
    for first in range(0, n_blocks, LANES):
        blocks += _encode([ids[a:b] for a, b in zip(bounds[first : first + LANES], bounds[first + 1 : first + LANES + 1], strict=False)])
    return blocks


def _encode(parts: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))  # so that those still open come first
    sizes = np.array([len(parts[i]) for i in order])
    n, steps, lists = len(order), int(sizes[0]), []
    said = np.zeros((3, n, steps), np.float32)
    for lane, i in enumerate(order):
        distinct, rank = _ranked(parts[i])
        lists.append(distinct)
        said[:, lane, : sizes[lane]] = _intervals(rank, len(distinct))
    # Only the range goes step by step: every lane gives a word of each row, and need says whether it is one.
    low, wide = np.zeros(n), np.full(n, TOP)
    # A rank takes 21 bits at most, as no total exceeds 121 * ORDER0, so one word is enough. Every lane gives one at each step, and needs says which count.
    words, needs = np.zeros((steps + 2, n), np.int32), np.zeros((steps + 2, n), bool)
    for first in range(0, steps, 64):
        some = said[:, :, first : first + 64].transpose(2, 0, 1).astype(np.float64)
        open_ = np.searchsorted(-sizes, -np.arange(first, first + len(some)), side="left").tolist()
        for t, ((begin, width, total), m) in enumerate(zip(some, open_, strict=True), first):
            if m < n:
                begin[m:], width[m:], total[m:] = 0, 1, 1  # a lane that has ended stays as it is
            wide /= total
            np.floor(wide, out=wide)
            begin *= wide
            low += begin
            wide *= width
            need = np.less(wide, WORD, out=needs[t])
            # By arithmetic, as a mask that nobody can foretell is slow.
            word = low * (1 / WORD)
            np.floor(word, out=word)
            words[t] = word
            word *= need
            word *= WORD
            low -= word
            more = need * (WORD - 1)
            more += 1
            low *= more
            wide *= more
    for t in (steps, steps + 1):
        words[t], needs[t] = np.floor(low * (1 / WORD)), True
        low = (low - words[t] * WORD) * WORD
    blocks = [b""] * n
    for lane, i in enumerate(order):
        code = words[:, lane][needs[:, lane]]
        # Bit 24 of a word is the carry into the word before.
        while (carry := code >> 24).any():
            code &= 0xFFFFFF
            code[:-1] += carry[1:]
        listed, code = _list_distinct(lists[lane].astype(np.int64)), code.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        crc = zlib.crc32(parts[i].astype("<u4").tobytes())
        blocks[i] = HEADER.pack(MAGIC, len(parts[i]), len(lists[lane]), len(listed), len(code), crc) + listed + code
    return blocks


Block = tuple[int, np.ndarray, bytes, int]


def read_blocks(f, end: int) -> Iterator[list[Block]]:
    """(ids, distinct ids, code, crc32) of the blocks of an open file up to a place, LANES at a time."""
    at, held = 0, []
    while at < end:
        f.seek(at)
        magic, size, distinct, listed, code, crc = HEADER.unpack(f.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        data = f.read(listed + code)
        held.append((size, _read_distinct(data[:listed], distinct), data[listed:], crc))
        at += HEADER.size + listed + code
        if len(held) == LANES:
            yield held
            held = []
    if held:
        yield held


def split_blocks(data: bytes) -> list[Block]:
    return [b for group in read_blocks(BytesIO(data), len(data)) for b in group]


def decode(blocks: list[Block]) -> np.ndarray:
    """The ids of all blocks, in order; a block that does not match its checksum raises ValueError."""
    parts = [x for i in range(0, len(blocks), LANES) for x in _decode(blocks[i : i + LANES])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _decode(blocks: list[Block]) -> list[np.ndarray]:
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    sizes = np.array([blocks[i][0] for i in order])
    steps = int(sizes[0])
    m = _Lanes(np.array([len(blocks[i][1]) for i in order]), steps)
    words = np.zeros((m.n, max(len(b[2]) for b in blocks) // 3 + 4), np.int32)
    for lane, i in enumerate(order):
        w = np.frombuffer(blocks[i][2], np.uint8).reshape(-1, 3)
        words[lane, : len(w)] = w @ np.array([1, 1 << 8, 1 << 16], np.int32)
    flat, place = words.reshape(-1), np.arange(m.n) * words.shape[1]
    code = flat[place] * WORD + flat[place + 1]
    place = place + 2
    wide = np.full(m.n, TOP)
    at, slot, hashed, right = m.base[:-1], np.arange(m.n) * SLOTS, np.zeros(m.n, np.int64), np.zeros(m.n, bool)
    # Stretches in which the same lanes are open and counts stay.
    ends = np.unique(np.concatenate([[b for _, b in _turns(steps)], sizes])).tolist()
    turns = {b: a for a, b in _turns(steps) if b < steps}
    for first, stop in zip([0, *ends[:-1]], ends, strict=True):
        n = int(np.searchsorted(-sizes, -first, side="left"))
        if first in turns or not first:
            if first:
                m.turn(slice(turns[first], first))
            table, one, two, low, wides, e2, e1, totals = m.table, m.one, m.two, m.low, m.wide, m.e2.ravel(), m.e1.ravel(), m.total.ravel()
        code, wide, place, at, slot, hashed, right = code[:n], wide[:n], place[:n], at[:n], slot[:n], hashed[:n], right[:n]
        base, lane_at, lane_slot, klass = m.base[:n], np.arange(n) * ORDER0, np.arange(n) * SLOTS, np.arange(n) * CLASSES
        for t in range(first, stop):
            # What orders 2 and 1 say: places y in low, weights w, order-0 places p.
            s1, x2, x1 = at, two.take(slot), one.take(at)
            y2, y1 = x2 >> 2, x1 >> 2
            x2 &= LONGEST
            x1 &= LONGEST
            context = x2 * 4
            context += x1
            context *= 2
            context += y1 == y2
            context *= 2
            context += right
            k = klass + context
            w2, w1, total = e2.take(k), e1.take(k), totals.take(k)
            p2, p1 = low.take(y2), low.take(y1)
            wide /= total
            np.floor(wide, out=wide)
            v = code / wide
            np.floor(v, out=v)
            total -= 1
            np.minimum(v, total, out=v)
            # Take out what the contexts add, first the one that stands lower, to find the order-0 place.
            first_w = np.where(p2 < p1, w2, w1)
            d = v - np.minimum(p2, p1)
            np.maximum(d, 0.0, out=d)
            v -= np.minimum(d, first_w, out=d)
            d = v - np.maximum(p2, p1)
            np.maximum(d, 0.0, out=d)
            first_w -= w1
            first_w -= w2
            v -= np.minimum(d, -first_w, out=d)
            where = v.astype(np.int64)
            where += lane_at
            rank = table.take(where)
            at = base + rank
            here = low.take(at)
            right2, right1 = y2 == at, y1 == at
            here = here + (w2 * (p2 < here) + w1 * (p1 < here))
            here *= wide
            code -= here
            w2 *= right2
            w1 *= right1
            w2 += w1
            w2 += wides.take(at)
            wide *= w2
            # By arithmetic, as a mask that nobody can foretell is slow.
            need = wide < WORD
            more = need * (WORD - 1)
            more += 1
            code *= more
            wide *= more
            code += flat.take(place) * need
            place += need
            new = (at << 2).astype(np.int32)
            new += 1
            for x, says, by, was in ((x2, two, slot, right2), (x1, one, s1, right1)):
                np.minimum(x, LONGEST - 1, out=x)
                x *= was
                x += new
                says[by] = x
            right = right1 | right2
            context *= 2
            context += right2
            context *= 2
            context += right1
            m.coded[t, :n], m.ranks[t, :n] = context, rank
            # The slot of the ranks now and before.
            slot = rank * np.int64(509)
            hashed, slot = rank, slot + hashed
            slot &= SLOTS - 1
            slot += lane_slot
    ranks = m.ranks
    del m, table, one, two, low, wides, words, flat
    parts = [np.zeros(0, np.uint32)] * len(blocks)
    for lane, i in enumerate(order):
        size, own, _, crc = blocks[i]
        parts[i] = own[ranks[:size, lane]].astype(np.uint32)
        if zlib.crc32(parts[i].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    return parts
