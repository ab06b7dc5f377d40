"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward recursion.

A state emits a class of words, and a class emits a word. The TOP most frequent words are classes of their own; the other words fall
into SHAPES classes by their first and last bytes, and within a class a word has its share of the training counts, less the mass of the
words seen once, which stands for words not seen. So the model's size is fixed, while the counts of all words stay in a
table that texts are joined with. Training finds starting values with states that hold for a whole document, then frees the
transitions in rounds of Baum-Welch. All rounds, and scoring, run through whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .textops import LOWER, Words, mix

TOP, SHAPES, STATES = 30_000, 4096, 8
WHOLE_ROUNDS, FREE_ROUNDS = 3, 3
#: Tokens that a worker handles at once.
STRETCH = 800_000
END = np.uint64(0x0E0D)  # stands for the end of a text; no word has this hash but by chance
CLASSES = TOP + SHAPES + 1
MOST_COUNTS = 1_500_000
_LOW3 = np.uint64(0xFFFFFF)
_LOW2 = np.uint64(0xFFFF)


def shapes(w: Words) -> np.ndarray:
    """Class by the first two and last three bytes of a word."""
    padded = np.concatenate([np.zeros(8, np.uint8), w.buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(w.buf) + 9,), np.uint64, padded, 0, (1,))
    # A word's last three bytes are the high ones of the eight that end with it; bytes before the word do not count.
    tail = wide[w.start + w.length] >> (np.uint64(8) * (8 - np.minimum(w.length, 3)).astype(np.uint64))
    head = wide[w.start + 8] & np.where(w.length > 1, _LOW2, np.uint64(0xFF))
    return (mix((tail & _LOW3) ^ (head << np.uint64(24)) ^ np.uint64(0x51ED27)) >> np.uint64(52)).astype(np.int64)


@dataclass
class Model:
    """Words of their own class, and what the states emit."""

    word: np.ndarray  # hashes in ascending order
    number: np.ndarray  # their classes
    log_count: np.ndarray  # log10(c + 0.5) by class of its own
    unseen: np.ndarray  # log10 of the share of unseen words, by shape
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state
    extra: np.ndarray | None = None  # by class: words of their own class seen once, which tell how many words are not seen


def _held_out(doc_id: Column, held: Column | None) -> Column:
    return F.lit(False) if held is None else F.coalesce(held, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, shape, c): how often each word, by hash, and the end of text stand in docs. Counted in tasks first."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = 0

        def merged(parts):
            h, s, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)

        def give(h, s, c):
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(s[i : i + 200_000].astype(np.int32)), pa.array(c[i : i + 200_000])], names=["h", "shape", "c"])

        for _, text in slices(batches):
            w = Words(text, LOWER)
            ends += len(text)
            held.append(merged([(w.hash, shapes(w), np.ones(len(w.hash)))]))
            if len(held) >= 8:
                held = [merged(held)]
                if len(held[0][0]) > MOST_COUNTS:
                    yield from give(*held.pop())
        if ends:
            held.append((np.array([END]), np.array([SHAPES]), np.array([ends])))
            yield from give(*merged(held))

    return docs.select("text").mapInArrow(on, "h long, shape int, c long").groupBy("h", "shape").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = TOP) -> DataFrame:
    """The words with the highest counts, `most` at most and nearly as many. Two histograms of fixed size tell which: one of counts on a
    log scale, and for the level at which the room ends, one of hashes. Nothing is sorted, so no task sees the words of others."""
    words = counts.where(F.col("shape") < SHAPES).withColumns({"level": F.floor(F.log2("c") * 8), "cell": F.pmod("h", F.lit(1024))})
    room, least, cells = most, -1, 0
    for level, n in sorted(((r["level"], r["n"]) for r in words.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            least = level
            for cell, k in sorted((r["cell"], r["n"]) for r in words.where(F.col("level") == level).groupBy("cell").agg(F.count("*").alias("n")).collect()):
                if k > room:
                    break
                room, cells = room - k, cell + 1
            break
        room -= n
    return words.where((F.col("level") > least) | ((F.col("level") == least) & (F.col("cell") < cells))).select("h", "shape", "c")


def _encode(docs: DataFrame, model: Model, held: Column | None) -> DataFrame:
    """Each text as classes, with the hashes of its words that have no class of their own. Rows get a number of their own, as doc_id may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch, text in slices(batches):
            w = Words(text, LOWER)
            n = len(text)
            at = np.minimum(np.searchsorted(m.word, w.hash), len(m.word) - 1)
            own = m.word[at] == w.hash if len(m.word) else np.zeros(len(w.hash), bool)
            shape = shapes(w)
            klass = np.where(own, m.number[at], TOP + shape) if len(m.word) else TOP + shape
            sums = np.bincount(w.doc, weights=np.where(own, m.log_count[np.where(own, klass, 0)], 0.0), minlength=n)
            less = np.bincount(w.doc, weights=np.where(own, 0.0, m.unseen[shape]), minlength=n)
            n_own = np.bincount(w.doc[own], minlength=n)
            data = klass.astype(np.uint16).tobytes()
            rare = w.hash[~own].view(np.int64)
            rare_at = np.concatenate([[0], np.cumsum(np.bincount(w.doc[~own], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(w.count),
                pa.array([data[2 * a : 2 * b] for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(rare_at), pa.array(rare)), pa.array(sums), pa.array(less), pa.array(n_own),
            ], names=["row", "doc_id", "held_out", "n_words", "classes", "rare", "log_count", "log_unseen", "n_own"])
            row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", _held_out(F.col("doc_id"), held).alias("held_out"), "text")
    return cut(source.mapInArrow(on, f"row long, doc_id {kind}, held_out boolean, n_words long, classes binary, rare array<long>, log_count double, log_unseen double, n_own long"), "hmm-coded")


def _tokens(classes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in a row, each with its end, and the n + 1 bounds."""
    size = np.array([len(x.as_buffer()) // 2 if x.is_valid else 0 for x in classes], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(bounds[-1]), CLASSES - 1, np.int64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = np.frombuffer(b"".join(x.as_py() for x in classes if x.is_valid), np.uint16)
    return out, bounds


def _whole(tokens: np.ndarray, bounds: np.ndarray, m: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a round in which a text keeps one state: posterior of the text's state, given to all its tokens."""
    logs = np.log(m.emit).astype(np.float32)
    post = np.add.reduceat(logs[tokens], bounds[:-1], axis=0) + np.log(m.start)
    post = np.exp(post - post.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    for k in range(STATES):
        emitted[:, k] += np.bincount(tokens, weights=np.repeat(post[:, k], np.diff(bounds)), minlength=CLASSES)
    return post.sum(0), np.diag((post * (np.diff(bounds) - 1)[:, None]).sum(0))


def _free(tokens: np.ndarray, bounds: np.ndarray, m: Model, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the scaled forward and backward recursions over whole texts, in step over texts. Forward values are held for
    a stretch of STRETCH tokens; those of earlier stretches are made again from the values they start with."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first = bounds[:-1][order]
    steps = int(size.max())
    open_ = np.searchsorted(-size[order], -np.arange(steps), side="left")
    stretches = np.flatnonzero(np.diff(np.cumsum(open_) // STRETCH, prepend=-1)).tolist()
    begin, move, emit = m.start.astype(np.float32), m.move.astype(np.float32), m.emit.astype(np.float32)

    def step(t: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = open_[t]
        b = emit[tokens[first[:n] + t]]
        a = (begin if before is None else before[:n] @ move) * b
        return a / a.sum(1, keepdims=True), b

    a, entries = None, {0: None}
    for t in range(stretches[-1]):
        a, _ = step(t, a)
        if t + 1 in stretches:
            entries[t + 1] = a
    moved, starts = np.zeros((STATES, STATES)), np.zeros(STATES)
    beta = np.ones((0, STATES), np.float32)
    for low, high in reversed(list(zip(stretches, [*stretches[1:], steps], strict=True))):
        alpha, out = [entries[low]], []
        for t in range(low, high):
            a, b = step(t, alpha[-1])
            alpha.append(a)
            out.append(b)
        gammas, places = [], []
        for t in range(high - 1, low - 1, -1):
            n = open_[t]
            after = np.ones((n, STATES), np.float32)
            after[: len(beta)] = beta
            g = alpha[t - low + 1] * after
            g /= g.sum(1, keepdims=True)
            gammas.append(g)
            places.append(first[:n] + t)
            if t:
                # A step's evidence, scaled so that it sums to one for each text.
                ev = out[t - low] * after
                before = alpha[t - low][:n]
                ev /= ((before @ move) * ev).sum(1, keepdims=True)
                moved += before.T @ ev * move
                beta = ev @ move.T
            else:
                starts += g.sum(0)
        g, at = np.concatenate(gammas), tokens[np.concatenate(places)]
        for k in range(STATES):
            emitted[:, k] += np.bincount(at, weights=g[:, k], minlength=CLASSES)
    return starts, moved


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most STRETCH tokens; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) // 2 + 1
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > STRETCH:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(size):
        yield batch.slice(at)


def _round(coded: DataFrame, m: Model, free: bool) -> Model:
    """One step of Baum-Welch: each task sums its expected counts, Spark sums those of the tasks; CLASSES rows come back."""
    shared = coded.sparkSession.sparkContext.broadcast(m)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, start, move = np.zeros((CLASSES, STATES)), np.zeros(STATES), np.zeros((STATES, STATES))
        for batch in batches:
            for part in _parts(batch, 0):
                tokens, bounds = _tokens(part.column(0))
                s, v = (_free if free else _whole)(tokens, bounds, shared.value, emitted)
                start += s
                move += v
        rows = np.concatenate([emitted, start[None], move])
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(rows[at, k]) for k in range(STATES)]], names=["at", *[f"s{k}" for k in range(STATES)]])

    names = [f"s{k}" for k in range(STATES)]
    sums = coded.select("classes").mapInArrow(on, "at long, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    total = np.zeros((CLASSES + 1 + STATES, STATES))
    total[sums.column("at").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], 1) if sums.num_rows else 0
    emitted, start, move = total[:CLASSES], total[CLASSES], total[CLASSES + 1 :]
    emitted = emitted + m.extra[:, None] * (emitted.sum(0) / max(emitted.sum(), 1e-9))
    share = (emitted.sum(1) + 0.5) / (emitted.sum() + 0.5 * CLASSES)
    # A class that a state never emitted keeps a little of its overall share.
    emit = (emitted + 50 * share[:, None]) / (emitted.sum(0) + 50)
    move = (move + 0.1 + 5 * np.eye(STATES)) / (move.sum(1, keepdims=True) + 0.1 * STATES + 5)
    return Model(m.word, m.number, m.log_count, m.unseen, (start + 1) / (start.sum() + STATES), move, emit, m.extra)


def _forward(tokens: np.ndarray, bounds: np.ndarray, m: Model) -> np.ndarray:
    """log10 of the probability of each text's classes: the scaled forward recursion, in step over texts."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first = bounds[:-1][order]
    open_ = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
    total = np.zeros(len(size))
    a = np.tile(m.start, (len(size), 1))
    for t, n in enumerate(open_):
        a = (a[:n] if t == 0 else a[:n] @ m.move) * m.emit[tokens[first[:n] + t]]
        scale = a.sum(1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows of which `held` (a condition on doc_id) does not hold; a null condition counts as not held. Null texts count as
    empty, which are one token, the end. Without training rows every token is unseen. Repeated rows count each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    train = docs.where(~_held_out(F.col("doc_id"), held))
    counts = cut(word_counts(train), "hmm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    top = frequent(counts).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    word = top.column("h").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(word)
    number = np.arange(len(word))[order]
    log_count = np.log10(np.concatenate([top.column("c").to_numpy() if top.num_rows else [], [1.0]]) + 0.5)
    own = spark.createDataFrame(pa.table({"h": pa.array(word.view(np.int64))}))
    rare = counts.where(F.col("shape") < SHAPES).join(F.broadcast(own), "h", "left_anti")  # TOP rows at most
    by_shape = rare.groupBy("shape").agg(F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("int")).alias("once")).toPandas()
    sums, once = np.zeros(SHAPES), np.zeros(SHAPES)
    sums[by_shape["shape"].to_numpy(int)] = by_shape["total"].to_numpy(float)
    once[by_shape["shape"].to_numpy(int)] = by_shape["once"].to_numpy(float)
    free = np.where(sums > 0, np.minimum((once + 1) / (sums + 2), 0.95), 1.0)  # a shape without words emits unseen ones only
    rng = np.random.default_rng(7)
    m = Model(word[order], number, log_count, np.log10(free), np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1)), np.zeros((CLASSES, STATES)))
    m.extra = np.zeros(CLASSES)
    if top.num_rows:
        m.extra[TOP : TOP + SHAPES] = np.bincount(top.column("shape").to_numpy()[top.column("c").to_numpy() == 1], minlength=SHAPES)
    share = np.full(CLASSES, 0.5)
    share[: len(word)] += 10 ** log_count[:-1]
    share[TOP : TOP + SHAPES] += sums
    share[-1] += train.count()
    emit = share[:, None] * np.exp(rng.normal(0, 0.5, (CLASSES, STATES)))
    m.emit = emit / emit.sum(0)
    coded = _encode(docs, m, held)
    fit = coded.where("not held_out")
    move = m.move
    for i in range(WHOLE_ROUNDS + FREE_ROUNDS):
        m = _round(fit, m, i >= WHOLE_ROUNDS)
        if i == WHOLE_ROUNDS - 1:
            m.move = move
    shared = spark.sparkContext.broadcast(m)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(_forward(*_tokens(part.column(part.num_columns - 1)), shared.value))], names=[*part.schema.names[:-1], "log_classes"])

    keep = ["row", "doc_id", "held_out", "n_words", "log_count", "log_unseen", "n_own"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.select(*keep, "classes").mapInArrow(on, f"row long, doc_id {kind}, held_out boolean, n_words long, log_count double, log_unseen double, n_own long, log_classes double")
    # Words without a class of their own: what a known one has more than an unseen one of its shape.
    shape = spark.createDataFrame(pa.table({"shape": pa.array(np.arange(SHAPES, dtype=np.int32)), "total": pa.array(sums), "free": pa.array(free)}))
    known = rare.join(F.broadcast(shape), "shape").select("h", F.log10(F.col("c") + 0.5).alias("base"), (F.log10((1 - F.col("free")) * F.col("c") / F.col("total")) - F.log10("free")).alias("gain"))
    seen = coded.select("row", F.explode("rare").alias("h")).join(known, "h").groupBy("row").agg(F.sum("base").alias("base"), F.sum("gain").alias("gain"), F.count("*").alias("n_rare"))
    all_ = scored.join(seen, "row", "left").na.fill(0, ["base", "gain", "n_rare"])
    end_known = 1 if n else 0
    end_base = float(np.log10(train.count() + 0.5)) if n else float(np.log10(0.5))
    n_tokens, n_known = F.col("n_words") + 1, F.col("n_own") + F.col("n_rare") + end_known
    unseen = F.col("n_words") - F.col("n_own") - F.col("n_rare")
    base = F.col("log_count") + F.col("base") + unseen * float(np.log10(0.5)) + end_base - n_tokens * float(np.log10(n + 0.5 * (v + 1)))
    return all_.select("doc_id", "held_out", n_tokens.alias("n_tokens"), n_known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_classes") + F.col("log_unseen") + F.col("gain")).alias("score"))
