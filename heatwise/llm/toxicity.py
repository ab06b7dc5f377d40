"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Training: tokens of labelled documents (equal texts once) are counted by class, for the word and for its
leading 4, 5 and 6 bytes. A token's share of the toxic class is a Dirichlet posterior whose prior is the
share of its next shorter prefix; its score is the log-odds less a drift, so that ordinary text
scores below zero. Ruzzo and Tompa's linear scan finds all maximal scoring segments. Karlin and Altschul's
statistics of clean text turn a segment's score S in a text of n tokens into the excess
lambda * S - ln(K * n); the sum of a document's positive excesses goes through a logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, slices, small
from .textops import LETTERS, Words, mix

#: Hash buckets of each level bound the model, whatever the vocabulary: leading bytes, then whole words.
LEVELS = (4, 5, 6, 0)
BITS = (18, 18, 18, 19)
DRIFT, LOWEST, HIGHEST = 1.0, -4.0, 6.0
BINS = 200
MAX_LABELS = 2_000_000
_KEEP = [np.uint64((1 << (8 * n)) - 1) for n in range(9)]


def _buckets(w: Words) -> list[np.ndarray]:
    padded = np.concatenate([w.buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(w.buf) + 1,), np.uint64, padded, 0, (1,))[w.start]
    out = []
    for level, bits in zip(LEVELS, BITS, strict=True):
        if level:
            keep = np.array(_KEEP, np.uint64)[np.minimum(w.length, level)]
            h = mix((wide & keep) * np.uint64(0x9E3779B97F4A7C15))
        else:
            h = w.hash
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class Model:
    toxic: list[np.ndarray]
    clean: list[np.ndarray]
    scale: float
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float] = (-4.0, 2.0)

    def token_scores(self, w: Words) -> np.ndarray:
        share = np.full(len(w.start), 0.5, np.float32)
        prior = np.float32(2 * self.scale)
        for b, t, c in zip(_buckets(w), self.toxic, self.clean, strict=True):
            share = (t[b] + prior * share) / (t[b] + c[b] + prior)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.clip(np.log(share / (1 - share)) - DRIFT, LOWEST, HIGHEST)

    def excess(self, scores: list[float], n: int) -> float:
        floor = math.log(self.k * max(n, 1))
        return sum(max(0.0, self.lam * s - floor) for s in scores)

    def probability(self, z: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(z)))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's scan over runs of positive scores."""
    pos = np.flatnonzero(scores > 0)
    if not len(pos):
        return []
    cum = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    first = pos[np.concatenate([[True], np.diff(pos) > 1])]
    last = pos[np.concatenate([np.diff(pos) > 1, [True]])] + 1
    # start, end, sum before, sum after, and the last one before it whose sum before is smaller: a search jumps along these, so all searches together are linear.
    found: list[tuple[int, int, float, float, int]] = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        left, right, j = cum[a], cum[b], len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < right:
            a, left, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((a, b, left, right, j))
    return [(a, b, r - s) for a, b, s, r, _ in found]


def _segments(text: pa.Array, model: Model) -> tuple[Words, np.ndarray, dict[int, list[tuple[int, int, float]]]]:
    w = Words(text, LETTERS)
    s = model.token_scores(w)
    docs = np.unique(w.doc[s > 0])
    return w, s, {int(d): maximal_segments(s[w.bounds[d] : w.bounds[d + 1]]) for d in docs}


def _count(train: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, 1 << b), np.int64) for b in BITS]
        for batch, text in slices(batches):
            w = Words(text, LETTERS)
            label = batch.column(1).to_numpy(zero_copy_only=False)[w.doc]
            for s, b in zip(sums, _buckets(w), strict=True):
                for y in (0, 1):
                    s[y] += np.bincount(b[label == y], minlength=s.shape[1])
        for level, s in enumerate(sums):
            at = np.flatnonzero(s.any(axis=0))
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), level, np.int32)), pa.array(part.astype(np.int32)), pa.array(s[0, part]), pa.array(s[1, part])], names=["level", "bucket", "clean", "toxic"])

    # At most one row per bucket comes to the driver: 2**18 * 3 + 2**19.
    rows = train.select("text", "toxic").mapInArrow(on, "level int, bucket int, clean long, toxic long").groupBy("level", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    level, bucket = rows.column("level").to_numpy(), rows.column("bucket").to_numpy()
    clean, toxic = [np.zeros(1 << b, np.float32) for b in BITS], [np.zeros(1 << b, np.float32) for b in BITS]
    for i in range(len(BITS)):
        own = level == i
        clean[i][bucket[own]] = rows.column("clean").to_numpy()[own]
        toxic[i][bucket[own]] = rows.column("toxic").to_numpy()[own]
    return clean, toxic


def _karlin(hist: np.ndarray, middle: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1."""
    p = hist / max(hist.sum(), 1)
    if not (p * middle).sum() < 0 or not (p[middle > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * middle, 600))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through binned labels, by Newton's steps with a small ridge."""
    a, b = -3.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n1 - (n0 + n1) * p).sum(), ((n1 - (n0 + n1) * p) * x).sum()]) - 0.1 * np.array([a, b])
        v = (n0 + n1) * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
    return float(a), float(max(b, 1e-3))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> Model:
    """_fit() with small batches of texts, so that a worker holds little beside the executor's heap."""
    with arrow_rows(docs.sparkSession):
        return _fit(docs, labels, use)


def _fit(docs: DataFrame, labels: DataFrame, use: Column | None) -> Model:
    """Fit on the documents of which labels(doc_id, toxic) are known, for those doc_id of which `use` holds.

    Rows with a null text, doc_id or label are left out; of equal texts one stands for all, with the larger label.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = (known if use is None else known.where(use)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(small(known, MAX_LABELS), "doc_id")
    one = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("doc_id", F.struct(-F.col("_toxic"), "doc_id")).alias("doc_id"), F.max("_toxic").alias("toxic")).select("doc_id", "toxic")
    one = cut(one, "toxic-train")
    data = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(small(one, MAX_LABELS), "doc_id")
    clean, toxic = _count(data)
    scale = float(clean[-1].sum() / max(toxic[-1].sum(), 1.0)) or 1.0
    model = Model([t * np.float32(scale) for t in toxic], clean, max(scale, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = (HIGHEST - LOWEST) / BINS

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros(BINS, np.int64)
        kind = pa.list_(pa.float64())
        for batch, text in slices(batches):
            w, s, found = _segments(text, shared.value)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.clip(((s[label[w.doc] == 0] - LOWEST) / width).astype(np.int64), 0, BINS - 1)
            hist += np.bincount(at, minlength=BINS)
            seg = [[x[2] for x in found.get(i, [])] for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(w.count.astype(np.int64)), pa.array(seg, kind), pa.nulls(len(text), pa.list_(pa.int64()))], names=["toxic", "n", "segs", "hist"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([[]], kind), pa.array([hist], pa.list_(pa.int64()))], names=["toxic", "n", "segs", "hist"])

    seen = cut(data.select("text", "toxic").mapInArrow(on, "toxic int, n long, segs array<double>, hist array<long>"), "toxic-segments")
    hist = np.zeros(BINS, np.int64)
    for r in seen.where("toxic = -1").select(F.posexplode("hist").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        hist[r["i"]] = r["v"]
    model.lam = _karlin(hist, LOWEST + (np.arange(BINS) + 0.5) * width)
    over = seen.where("toxic = 0").select(F.size(F.filter("segs", lambda s: s >= 1.0)).alias("c")).agg(F.sum("c").alias("c")).first()["c"] or 0
    model.k = max(over, 1) * math.exp(min(model.lam, 50.0)) / max(int(hist.sum()), 1)
    floor = F.log(F.lit(model.k) * F.greatest(F.col("n"), F.lit(1)))
    z = F.aggregate("segs", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), s * model.lam - floor))
    bins = seen.where("toxic >= 0").select("toxic", F.least(F.floor(F.log1p(z) * 20), F.lit(400)).alias("b")).groupBy("b").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).toPandas()
    if len(bins):
        model.curve = _logistic((bins["b"].to_numpy(float) + 0.5) / 20, bins["n0"].to_numpy(float), bins["n1"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, and passages (first word, end word, score), in words of letters and digits.

    Null and empty texts get the score of a text without evidence; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, text in slices(batches):
            w, _, found = _segments(text, m)
            p = np.full(len(text), m.probability(0.0))
            keep: list[list[tuple[int, int, float]]] = [[] for _ in range(len(text))]
            for d, segs in found.items():
                n = int(w.count[d])
                p[d] = m.probability(m.excess([x[2] for x in segs], n))
                keep[d] = [x for x in segs if m.excess([x[2]], n) > 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in k] for k in keep], pa.list_(passage))], names=["doc_id", "score", "predicted", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(on, f"doc_id {kind}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
