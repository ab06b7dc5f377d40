"""Phrases of two and three words that stick together, mined by stripes.

A stripe belongs to a prefix and counts the words that come next. The stripe of the empty prefix holds the totals of
words, those of single words hold the counts of pairs, those of pairs the counts of triples; so an entry is both the
count of an extension and the total of the next prefix, and a stripe's largest entry is what may subsume its prefix.
Tasks build stripes over their texts, stripes of one prefix are merged element by element, and only entries that are
frequent enough stay. A phrase is never more frequent than its parts, so words and pairs that are too rare never enter
a stripe: bit arrays of fixed size, which may let a rare one through but hold back no frequent one, keep them out.

Words go by a 64-bit hash of language and word. The totals are kept with the words themselves, so two words with one
hash are seen, and then all is done again with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import arrow_rows, cut, slices
from .textops import LOWER, M1, Words, hash_spans, mix, raw

#: Least count of a phrase, share of it in a longer one that subsumes it (percent), and phrases reported for a language.
LEAST, SUBSUMED, REPORT = 10, 50, 2000
#: Different entries that a task holds before it hands on its stripes, and entries in a row of a stripe.
HELD, ENTRIES = 1_200_000, 1024
#: Seeds to try until no two words share a hash.
SEEDS = 8
#: A prefix with more than this share of all words has its stripe dealt over several groups, by the next word.
WIDE = 1 / 4096
#: Bits of the arrays that keep rare words and pairs out: so many for each frequent one, within these sizes.
BITS_EACH, MOST_BITS, FEWEST_BITS = 16, 1 << 28, 1 << 16
_TABLE = LOWER.copy()
_TABLE[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x20
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


class Phrases:
    """The words of a batch of texts with their keys, and which of them go on in the same piece of the text."""

    def __init__(self, text: pa.Array, lang: pa.Array, seed: int):
        self.words = w = Words(text, _TABLE, seed=seed)
        buf, _ = raw(text)
        piece = np.cumsum(_ENDS[buf])[w.start] if len(w.start) else w.start
        coded = lang.dictionary_encode()
        name, at = raw(coded.dictionary)
        salt = hash_spans(name, at[:-1], np.diff(at), seed)
        self.lang = coded.indices.to_numpy()[w.doc]
        self.names = coded.dictionary
        self.key = pair_key(w.hash, salt[self.lang])
        self.goes_on = np.zeros(len(w.start), bool)
        if len(w.start) > 1:
            self.goes_on[:-1] = (w.doc[1:] == w.doc[:-1]) & (piece[1:] == piece[:-1])

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        n = self.words.length[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1] - self.words.start[at], n)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.words.buf[inside])))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * M1 + mix(b))


def tally(cols: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of the columns, each with the sum of its n (1 where none are given), in no order that matters."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64)
    one = cols[0]
    for c in cols[1:]:
        one = pair_key(one, c)
    order = np.argsort(one)
    new = np.concatenate([[True], one[order][1:] != one[order][:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if any((c[order] != c[order[first]][group]).any() for c in cols):  # rows that share a key: sort by the columns themselves
        order = np.lexsort(cols[::-1])
        new = np.concatenate([[True], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])])
        first = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], first) if n is not None else np.diff(np.append(first, len(order)))
    return [c[order[first]] for c in cols], sums


class Counter:
    """Counts of rows of keys; what is held twice is put together when it gets much."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.cols: list[list[np.ndarray]] = [[] for _ in range(self.width)]
        self.n: list[np.ndarray] = []
        self.held = self.least = 0

    def add(self, cols: list[np.ndarray]) -> bool:
        """Count the rows; whether HELD different ones are held now."""
        got, n = tally(cols)
        for mine, c in zip(self.cols, got, strict=True):
            mine.append(c)
        self.n.append(n)
        self.held += len(n)
        if self.held > max(HELD // 2, 2 * self.least):
            self.least = len(self.total()[1])
        return self.least > HELD

    def total(self) -> tuple[list[np.ndarray], np.ndarray]:
        if len(self.n) != 1:
            cols, n = tally([np.concatenate(c) for c in self.cols], np.concatenate(self.n)) if self.n else ([np.zeros(0, np.uint64)] * self.width, np.zeros(0, np.int64))
            self.cols, self.n, self.held = [[c] for c in cols], [n], len(n)
        return [c[0] for c in self.cols], self.n[0]


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def word_totals(docs: DataFrame, seed: int) -> DataFrame:
    """The stripe of the empty prefix: key, lang, word and how often the word comes (n)."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys and their counts
        told: list[pa.RecordBatch] = []  # key, lang and word of each

        def out() -> Iterator[pa.RecordBatch]:
            for t in told:
                at = np.searchsorted(have, t.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(n[at])], names=["key", "lang", "word", "n"])

        for batch, text in slices(batches):
            p = Phrases(text, batch.column(1), seed)
            keys, first, times = np.unique(p.key, return_index=True, return_counts=True)
            at = np.searchsorted(have, keys)
            old = np.zeros(len(keys), bool)
            old[at < len(have)] = have[at[at < len(have)]] == keys[at < len(have)]
            n[at[old]] += times[old]
            fresh = np.flatnonzero(~old)
            if len(fresh):
                told.append(pa.RecordBatch.from_arrays([_signed(keys[fresh]), p.names.take(pa.array(p.lang[first[fresh]])).cast(pa.string()), p.spelled(first[fresh]).cast(pa.string())], names=["key", "lang", "word"]))
                order = np.argsort(np.concatenate([have, keys[fresh]]), kind="stable")
                have, n = np.concatenate([have, keys[fresh]])[order], np.concatenate([n, times[fresh]])[order]
            if len(have) > HELD // 2:
                yield from out()
                have, n, told = have[:0], n[:0], []
        yield from out()

    rows = docs.select("text", "lang").mapInArrow(on, "key long, lang string, word string, n long")
    # Dealt by key only, so that words which share one meet: at most one row a task for a word, however frequent.
    return rows.repartition("key").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _spread(rows: DataFrame, keys: list[str], n: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the prefixes over WIDE of all words, fewer than 1 / WIDE, and over how many groups each is dealt."""
    found = rows.where(F.col(n) > words * WIDE).select(*keys, n).toArrow()
    cols = [found.column(k).to_numpy().view(np.uint64) for k in keys]
    key = cols[0] if len(cols) == 1 else pair_key(*cols)
    order = np.argsort(key)
    return key[order], np.ceil(found.column(n).to_numpy()[order] / (words * WIDE)).astype(np.uint64)


def stripes(docs: DataFrame, seed: int, width: int, known: np.ndarray, wide: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Stripes of prefixes of `width` words as each task finds them: p1, (p2,) part, next, n; the lists go together.

    known has the bits of the frequent words (width 1) or pairs (width 2); only phrases whose parts may be frequent count.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, wide))
    names = [f"p{i + 1}" for i in range(width)] + ["part", "next", "n"]

    def rows(counter: Counter) -> Iterator[pa.RecordBatch]:
        (*prefix, after), n = counter.total()
        if not len(n):
            return
        _, (hot, groups) = shared.value
        key = prefix[0] if width == 1 else pair_key(*prefix)
        part = np.zeros(len(n), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            mine = np.flatnonzero(hot[at] == key)
            part[mine] = (mix(after[mine]) % groups[at[mine]]).astype(np.int64)
        order = np.lexsort((part, *prefix[::-1]))
        prefix, after, n, part = [c[order] for c in prefix], after[order], n[order], part[order]
        new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in (*prefix, part)])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(n)))
        rows_of = -(-size // ENTRIES)  # long stripes go on in further rows
        first = np.repeat(first, rows_of) + (np.arange(rows_of.sum()) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)) * ENTRIES
        upto = np.append(first, len(n)).astype(np.int32)
        for i in range(0, len(first), 20_000):
            j = min(i + 20_000, len(first))
            a, b = upto[i], upto[j]
            bounds = pa.array(upto[i : j + 1] - a)
            yield pa.RecordBatch.from_arrays([*(_signed(c[first[i:j]]) for c in prefix), pa.array(part[first[i:j]].astype(np.int32)), pa.ListArray.from_arrays(bounds, _signed(after[a:b])), pa.ListArray.from_arrays(bounds, pa.array(n[a:b]))], names=names)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(width + 1)
        for batch, text in slices(batches):
            p = Phrases(text, batch.column(1), seed)
            k, bits = p.key, shared.value[0]
            if width == 1:
                may = vectors.has(bits, k)
                at = np.flatnonzero(p.goes_on[:-1] & may[:-1] & may[1:]) if len(k) else np.zeros(0, np.int64)
                full = counter.add([k[at], k[at + 1]])
            else:
                at = np.flatnonzero(p.goes_on)
                may = np.zeros(len(k) + 1, bool)
                may[at] = vectors.has(bits, pair_key(k[at], k[at + 1]))
                at = np.flatnonzero(may[:-1] & may[1:])
                full = counter.add([k[at], k[at + 1], k[at + 2]])
            if full:
                yield from rows(counter)
                counter.clear()
        yield from rows(counter)

    kinds = "".join(f"p{i + 1} long, " for i in range(width))
    return docs.select("text", "lang").mapInArrow(on, f"{kinds}part int, next array<long>, n array<long>")


def merged(found: DataFrame, width: int) -> DataFrame:
    """Stripes merged element by element: p1, (p2,) next, n of each entry that is frequent enough."""
    prefix = [f"p{i + 1}" for i in range(width)]

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # of the last stripe, which may go on: prefix, part, next, n
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(width + 1)
            size = lists.value_lengths().to_numpy()
            cols = [np.repeat(c.to_numpy(), size) for c in batch.columns[: width + 1]] + [lists.flatten().to_numpy(), batch.column(width + 2).flatten().to_numpy()]
            last = [c[-1] for c in cols[: width + 1]]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            keys, n = tally([c.astype(np.int64).view(np.uint64) for c in cols[:-1]], cols[-1])
            cols = [*(c.view(np.int64) for c in keys), n]
            on_going = np.logical_and.reduce([c == x for c, x in zip(cols, last, strict=False)])
            held = [c[on_going] for c in cols]
            yield result([c[~on_going] for c in cols])
        if held is not None:
            yield result(held)

    def result(cols: list[np.ndarray]) -> pa.RecordBatch:
        often = cols[-1] >= LEAST
        return pa.RecordBatch.from_arrays([pa.array(c[often]) for c in (*cols[:width], *cols[-2:])], names=[*prefix, "next", "n"])

    dealt = found.repartition(*prefix, "part").sortWithinPartitions(*prefix, "part")
    return dealt.mapInArrow(on, "".join(f"{p} long, " for p in prefix) + "next long, n long")


def _filter(rows: DataFrame, key: str) -> np.ndarray:
    size = min(max(1 << (BITS_EACH * rows.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    return vectors.bits(rows, key, size)


def with_pair_key(pairs: DataFrame) -> DataFrame:
    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_signed(pair_key(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)))], names=["key"])

    return pairs.select("p1", "next").mapInArrow(on, "key long")


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """All candidates that no longer one subsumes: lang, w1, w2, w3 (keys; w3 null for pairs), a, l, r, score.

    Every part of a candidate is at least as frequent as it, so the joins lose nothing. Decimals of 38 digits hold the
    products of counts up to 10^15.
    """

    def points(a: str, left: str, right: str) -> Column:
        wide = "cast({} as decimal(16,0))"
        return F.expr(f"(1000000BD * {wide.format(a)} * {wide.format(a)}) div ({wide.format(left)} * {wide.format(right)})")

    word = words.select("key", "lang", F.col("n").alias("f"))
    of_pairs = (
        pairs.select(F.col("p1").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a"))
        .join(word.select(F.col("key").alias("w1"), "lang", F.col("f").alias("l")), "w1")
        .join(word.select(F.col("key").alias("w2"), F.col("f").alias("r")), "w2")
    )
    of_pairs = cut(of_pairs.select("lang", "w1", "w2", "a", "l", "r"), "phrase-pairs")
    t = triples.select(F.col("p1").alias("w1"), F.col("p2").alias("w2"), F.col("next").alias("w3"), F.col("n").alias("a"))
    front = of_pairs.select("w1", "w2", "lang", F.col("a").alias("a12"), F.col("l").alias("f1"))
    back = of_pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("r").alias("f3"))
    of_triples = t.join(front, ["w1", "w2"]).join(back, ["w2", "w3"]).select("*", points("a", "f1", "a23").alias("s1"), points("a", "a12", "f3").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    of_triples = of_triples.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("a12")).alias("l"), F.when(first, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    # The largest entry of each pair's stripe, and of the stripes in which it comes last.
    longer = t.select("w1", "w2", "a").unionAll(t.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    kept = of_pairs.join(longer, ["w1", "w2"], "left").where(f"coalesce(100 * longest, 0) < {SUBSUMED} * a")
    kept = kept.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", points("a", "l", "r").alias("score"))
    return kept.unionByName(of_triples)


def leading(rows: DataFrame, order: list[Column], n: int, by: Column) -> DataFrame:
    """The first n rows of each lang with their rank: first within groups dealt by a hash, then among what those leave."""
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = Window.partitionBy("lang", "_group").orderBy(*order)
    some = rows.withColumn("_group", F.pmod(by, F.lit(groups))).withColumn("_at", F.row_number().over(near)).where(F.col("_at") <= n)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= n).drop("_group", "_at")


def collocations(docs: DataFrame, report: int = REPORT) -> DataFrame:
    """Each language's first `report` phrases: lang, rank, phrase, a, l, r, n, score (see the module's head).

    Texts that are null, empty or without words give nothing; a null lang is `und`; equal rows count as often as they
    come; ties go by a, then by phrase in order of its bytes; other columns are not looked at; a table without
    candidates gives an empty result. A text of any length is one row of a task.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    with arrow_rows(spark):
        for seed in range(SEEDS):
            every = cut(word_totals(docs, seed), "phrase-words")
            if not every.groupBy("key").count().where("count > 1").limit(1).count():
                break
        else:
            raise ValueError(f"words share a hash under each of {SEEDS} seeds")
        totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
        size = totals.agg(F.sum("n")).first()[0] or 0
        words = every.where(F.col("n") >= LEAST)
        found = stripes(docs, seed, 1, _filter(words, "key"), _spread(words, ["key"], "n", size))
        pairs = cut(merged(found, 1), "phrase-stripes1")
    with arrow_rows(spark, 10_000):
        bits = _filter(with_pair_key(pairs), "key")
    with arrow_rows(spark):
        found = stripes(docs, seed, 2, bits, _spread(pairs, ["p1", "next"], "n", size))
        triples = cut(merged(found, 2), "phrase-stripes2")
    every = cut(scored(words, pairs, triples), "phrases")
    best = [F.col("score").desc(), F.col("a").desc()]
    last = leading(every.select("lang", "score", "a", "w1", "w2", "w3"), [*best, F.col("w1"), F.col("w2"), F.col("w3")], report, F.hash("w1", "w2", "w3")).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = every.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    for i in (1, 2, 3):
        near = near.join(words.select(F.col("key").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left" if i == 3 else "inner")
    near = near.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "score")
    named = leading(near, [*best, F.col("phrase")], report, F.xxhash64("phrase"))
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
