"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

Benchmark items are cut into overlapping windows of at most WINDOW characters. A window of m characters that is within k edits of a
region shares at least (its q-grams) - k * q of them with it, in one band of diagonals. A window's text is indexed once,
with all items that hold it. Documents are scanned once: a bitmap of benchmark q-grams and a
running count over the text leave few regions; there, hits are counted by window and overlapping band, and the bands
that reach the bound are verified by a banded edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, slices, without
from .textops import LETTERS, raw

#: Items shorter than a q-gram have none and are left out; those too short for an edit are looked for as they are.
Q, WINDOW, STRIDE, LEAST = 12, 96, 32, 12
#: Characters for each edit that a window may have.
CHARACTERS_AN_EDIT = 16
#: The benchmark is worked through in blocks of about so many bytes, so that what is broadcast is bounded.
BLOCK_BYTES = 4_000_000
BITMAP = 20
#: The least number of shared q-grams that makes a region.
SHARED = 12
#: Hits that are laid out at once, and candidates that are aligned at once.
HITS, ALIGNED = 2_000_000, 512


def normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case texts with every run of other ASCII than letters and digits as one space; offsets; place of each in the bytes of the lower-case text."""
    low = pc.utf8_lower(text)
    buf, offsets = raw(low)
    buf = LETTERS[buf]
    keep = np.ones(len(buf), bool)
    if len(buf):
        keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = True
    at = np.flatnonzero(keep)
    whole = buf[at]
    at = at[(whole & 0xC0) != 0x80]
    return np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32), np.searchsorted(at, offsets), at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for the Q characters from each place on, made of those for 1, 2, 4 and 8."""
    h, k = np.concatenate([codes, np.zeros(Q, np.uint32)]).astype(np.uint64), int(0xD6E8FEB86659FD93)
    n, part, step = len(codes), {}, 1
    while step <= Q:
        part[step] = h
        h = h * np.uint64(pow(k, step, 1 << 64)) + np.concatenate([h[step:], np.zeros(step, np.uint64)])
        step *= 2
    return part[8][:n] * np.uint64(pow(k, 4, 1 << 64)) + part[4][8 : 8 + n]


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP)


@dataclass
class Index:
    windows: list[np.ndarray]
    items: list[list]  # of each window, an entry for each time that an item holds it
    budget: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted q-grams that are counted
    first: np.ndarray  # of each, its first entry in window and place; one more at the end
    window: np.ndarray
    place: np.ndarray
    order: np.ndarray  # of each entry, number of the q-gram times the windows, plus the window: ascending
    bitmap: np.ndarray


def build(items: list[tuple[object, str]]) -> Index:
    held: dict[str, list] = {}
    for item, text in items:
        data = normal(pa.array([text or ""]))[0].tobytes().decode("utf-32-le").strip()
        if len(data) < LEAST:
            continue
        stops = [*range(WINDOW, len(data), STRIDE), len(data)] if len(data) > WINDOW else [len(data)]
        for stop in stops:
            held.setdefault(data[max(0, stop - WINDOW) : stop], []).append(item)
    windows = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in held]
    g, w, p = [], [], []
    for i, data in enumerate(windows):
        n = len(data) - Q + 1
        g.append(grams(data)[:n])
        w.append(np.full(n, i))
        p.append(np.arange(n))
    g, w, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((g, np.uint64), (w, np.int64), (p, np.int64)))
    order = np.argsort(g, kind="stable")
    g, w, p = g[order], w[order], p[order]
    length = np.array([len(x) for x in windows], np.int64)
    own = length - Q + 1
    # At least SHARED q-grams must be shared: where the lemma asks for fewer, fewer edits are allowed.
    budget = np.maximum(np.minimum(length // CHARACTERS_AN_EDIT, (own - SHARED) // Q), 0)
    gram, first = np.unique(g, return_index=True)
    bitmap = np.zeros(1 << BITMAP, bool)
    bitmap[_bucket(gram)] = True
    return Index(windows, list(held.values()), budget, own - budget * Q, gram, np.append(first, len(g)), w, p, np.repeat(np.arange(len(gram)), np.diff(np.append(first, len(g)))) * len(windows) + w, bitmap)


def _string(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def banded(pattern: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits with which the pattern is found anywhere in a region, and where that match ends. The region is a diagonal band, so each row is as wide as the band."""
    n = len(region)
    row = np.zeros(n + 1, np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(pattern.tolist()):
        best = np.empty(n + 1, np.int32)
        best[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (region != c), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def banded_many(patterns: list[np.ndarray], regions: list[np.ndarray]) -> list[tuple[int, int]]:
    """banded() of many patterns, each in its region. What fills up a short region matches nothing, so no match gains by it."""
    length = np.array([len(x) for x in patterns])
    n = max(len(x) for x in regions)
    pattern, region = np.zeros((len(patterns), length.max()), np.uint32), np.full((len(patterns), n), 0xFFFFFFFF, np.uint32)
    for i, (x, y) in enumerate(zip(patterns, regions, strict=True)):
        pattern[i, : len(x)], region[i, : len(y)] = x, y
    row, steps = np.zeros((len(patterns), n + 1), np.int32), np.arange(n + 1, dtype=np.int32)
    out = [(0, 0)] * len(patterns)
    for i in range(pattern.shape[1]):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (region != pattern[:, i : i + 1]), out=best[:, 1:])
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        for at in np.flatnonzero(length == i + 1).tolist():
            end = int(np.argmin(row[at]))
            out[at] = int(row[at, end]), end
    return out


def _candidates(at: np.ndarray, where: np.ndarray, offsets: np.ndarray, ix: Index, low: int = 0, high: int | None = None) -> Iterator[np.ndarray]:
    """Bands (window, document, band) that reach their bound, from places of indexed q-grams in ascending order and the q-grams' numbers.

    More hits than HITS are laid out in parts: of places, which overlap by more than a window's region, then of windows.
    """
    high = len(ix.windows) if high is None else high
    begin, stop = ix.first[where], ix.first[where + 1]
    if low or high < len(ix.windows):
        begin, stop = (np.searchsorted(ix.order, where * len(ix.windows) + w) for w in (low, high))
    times = stop - begin
    total = int(times.sum())
    if not total:
        return
    if total > HITS:
        middle, overlap = (int(at[0]) + int(at[-1])) // 2, 4 * WINDOW
        if at[-1] - at[0] > 4 * overlap:
            for part in (at < middle + overlap, at >= middle):
                yield from _candidates(at[part], where[part], offsets, ix, low, high)
            return
        if high - low > 1:
            half = (low + high) // 2
            for a, b in ((low, half), (half, high)):
                yield from _candidates(at, where, offsets, ix, a, b)
            return
    pos = np.repeat(at, times)
    entry = np.repeat(begin, times) + (np.arange(total) - np.repeat(np.cumsum(times) - times, times))
    win, off = ix.window[entry], ix.place[entry]
    doc = np.searchsorted(offsets, pos, side="right") - 1
    inside = pos + Q <= offsets[doc + 1]
    pos, win, off, doc = pos[inside], win[inside], off[inside], doc[inside]
    if not len(pos):
        return
    diagonal = pos - off + WINDOW  # over the whole slice, so a band belongs to one place of one document
    band = diagonal // (ix.budget[win] + 1)
    # Bands of twice the budget that overlap by half: each hit counts in its own band and in the one before.
    key = np.concatenate([np.stack([win, doc, band, off], 1), np.stack([win, doc, band - 1, off], 1)])
    key = key[np.lexsort((key[:, 3], key[:, 2], key[:, 1], key[:, 0]))]
    key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(1)])]
    new = np.concatenate([[True], (key[1:, :3] != key[:-1, :3]).any(1)])
    groups, first = key[new, :3], np.flatnonzero(new)
    yield groups[np.diff(np.append(first, len(key))) >= ix.bound[groups[:, 0]]]


def find(text: pa.Array, ix: Index) -> list[tuple[int, object, int, int, int, int]]:
    """(document, item, windows found, least edits, start, end), start and end in code points of the text."""
    buf, offsets, place = normal(text)
    if len(buf) < Q or not len(ix.gram):
        return []
    g = grams(buf)
    may = ix.bitmap[_bucket(g)]
    # A window's region holds its q-grams within m + k places: count there, against the lowest bound.
    span = WINDOW + WINDOW // CHARACTERS_AN_EDIT
    c = np.zeros(len(buf) + span, np.int32)
    np.cumsum(may, dtype=np.int32, out=c[1 : len(buf) + 1])
    c[len(buf) + 1 :] = c[len(buf)]
    starts = np.flatnonzero(c[span:] - c[:-span] >= int(ix.bound.min()))
    if not len(starts):
        return []
    at = np.flatnonzero(may)
    before = np.searchsorted(starts, at, side="right") - 1
    at = at[(before >= 0) & (at - starts[np.maximum(before, 0)] < span)]
    where = np.minimum(np.searchsorted(ix.gram, g[at]), len(ix.gram) - 1)
    hit = ix.gram[where] == g[at]
    at, where = at[hit], where[hit]
    found: dict[tuple[int, object], list[int]] = {}
    done: set[tuple[int, int]] = set()
    for good in _candidates(at, where, offsets, ix):
        for i in range(0, len(good), ALIGNED):
            some = [(w, d, b) for w, d, b in good[i : i + ALIGNED].tolist() if (w, d) not in done]
            lows, regions = [], []
            for w, d, b in some:
                k, data = int(ix.budget[w]), ix.windows[w]
                low = max(int(offsets[d]), b * (k + 1) - WINDOW - k)
                lows.append(low)
                regions.append(buf[low : min(int(offsets[d + 1]), (b + 2) * (k + 1) - WINDOW + len(data) + k)])
            plain = [_string(r).find(_string(ix.windows[w])) for r, (w, _, _) in zip(regions, some, strict=True)]
            rest = [n for n, p in enumerate(plain) if p < 0]
            aligned = dict(zip(rest, banded_many([ix.windows[some[n][0]] for n in rest], [regions[n] for n in rest]), strict=True)) if rest else {}
            for n, (w, d, _) in enumerate(some):
                size = len(ix.windows[w])
                edits, end = aligned.get(n, (0, plain[n] + size))
                if edits > ix.budget[w] or (w, d) in done:
                    continue
                done.add((w, d))
                s, e = int(place[max(lows[n] + end - size, int(offsets[d]))]), int(place[lows[n] + end - 1]) + 1
                for item in ix.items[w]:
                    old = found.setdefault((d, item), [0, edits, s, e])
                    found[d, item] = [old[0] + 1, min(old[1], edits), min(old[2], s), max(old[3], e)]
    if not found:
        return []
    low, bounds = raw(pc.utf8_lower(text))
    lead = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    return [(d, item, n, edits, int(lead[s] - lead[bounds[d]]), int(lead[e] - lead[bounds[d]])) for (d, item), (n, edits, s, e) in sorted(found.items(), key=lambda x: x[0][0])]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of about BLOCK_BYTES bytes, one at a time at the driver. Rows without text or item_id are left out."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = total // BLOCK_BYTES + 1
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item of which at least one window is found in it.

    docs: doc_id, text; benchmark: item_id, text. Result: doc_id, item_id, n_windows, edits (of the best
    window), start and end (code points of the lower-case text that the found windows span). Items shorter than LEAST characters after
    normalisation are left out, those under 24 must occur without an edit; a text of any length is one piece of work; null and empty texts have no leaks; items repeated in the benchmark give a row for each block at most;
    an empty table on either side gives an empty result.
    """
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item}, n_windows int, edits int, start int, end int"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build(block))

        def on(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, text in slices(batches):
                rows = find(text, shared.value)
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = [item_type, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", "item_id", "n_windows", "edits", "start", "end"])

        one = docs.select("doc_id", "text").mapInArrow(on, schema)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage. Rows with a null doc_id are kept only if no row with a null doc_id leaks."""
    return without(docs, cut(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks"))
