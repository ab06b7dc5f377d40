"""Vectorised words and hashes over Arrow text: no Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For letters only: ASCII other than letters and digits turns to space.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not (chr(b).isalnum())]] = 0x20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them, from 0."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    o = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return b, o - o[0] if len(o) else np.zeros(1, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def hash_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; spans that share a hash under one seed differ under another."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) + 1,), np.uint64, padded, 0, (1,))  # eight bytes from each position
    h = length.astype(np.uint64) * M1 + np.uint64(seed)
    at, left, who = start, length, None
    while len(at):
        part = mix(((h if who is None else h[who]) ^ (wide[at] & _KEEP[np.minimum(left, 8)])) * M1)
        if who is None:
            h = part
        else:
            h[who] = part
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    return h


class Words:
    """Words of a batch of texts: byte start and length, document number, and hash of each."""

    def __init__(self, text: pa.Array, table: np.ndarray | None = None, hashes: bool = True, seed: int = 0):
        buf, self.offsets = raw(text)
        self.buf = table[buf] if table is not None else buf
        n = len(self.offsets) - 1
        letter = ~SPACE[self.buf]
        edge = np.empty(len(buf), bool)
        if len(buf):
            edge[0] = letter[0]
            edge[1:] = letter[1:] & ~letter[:-1]
        first = self.offsets[:-1]
        first = first[(first < self.offsets[1:])]
        edge[first] = letter[first]  # a word ends with its text
        self.start = np.flatnonzero(edge)
        last = np.empty(len(buf), bool)
        if len(buf):
            last[-1] = letter[-1]
            last[:-1] = letter[:-1] & (~letter[1:] | edge[1:])
        self.length = np.flatnonzero(last) + 1 - self.start
        self.count = np.diff(np.searchsorted(self.start, self.offsets))
        self.doc = np.repeat(np.arange(n), self.count)
        self.bounds = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = hash_spans(self.buf, self.start, self.length, seed) if hashes else None

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k-word window, with its document; a text of fewer words gives its whole sequence, one without words nothing."""
        h, n = self.hash, len(self.hash)
        if n >= k:
            s = h[: n - k + 1].copy()
            for j in range(1, k):
                s = s * M1 + h[j : n - k + 1 + j]
            ok = self.doc[: n - k + 1] == self.doc[k - 1 :]
            s, d = mix(s[ok]), self.doc[: n - k + 1][ok]
        else:
            s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(few):
            extra = []
            for i in few:
                v = np.uint64(int(self.count[i]))
                with np.errstate(over="ignore"):
                    for x in h[self.bounds[i] : self.bounds[i + 1]]:
                        v = v * M1 + x
                extra.append(v)
            s = np.concatenate([s, mix(np.array(extra, np.uint64))])
            d = np.concatenate([d, few])
            order = np.argsort(d, kind="stable")
            s, d = s[order], d[order]
        return s, d


def code_points(text: pa.Array) -> np.ndarray:
    return pc.utf8_length(text).to_numpy(zero_copy_only=False)
