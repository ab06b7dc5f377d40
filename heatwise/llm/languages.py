"""Languages of texts and of spans in mixed texts: scripts narrow the candidates, and Viterbi labels the words.

Training counts words and the four-byte and three-byte runs inside them (with the word's edges) by language, in hashed
buckets, and the letters of each script by language. A word's score for a language is the sum of the log shares of its
parts, against the mean of all languages; languages that hardly ever use the word's scripts are no candidates. The best
labelling of a text's words pays PENALTY for each change of language. A text's language is the one whose spans hold
most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices
from .textops import LOWER, M1, Words, hash_spans, mix, raw

#: What a change of language costs, in natural log units, and what a part not seen in a language counts as.
PENALTY, UNSEEN = 12.0, 0.5
#: Hash buckets of each feature: runs of three and of four bytes, and whole words. The model has one number for each of them and language.
RUNS, BITS = (3, 4), 16
BUCKETS = 1 << BITS
#: A language is a candidate for a script if at least this share of its letters is of it.
RARE = 1e-4
OTHER = "other"
#: Fixed values of Unicode: ranges of code points and their scripts. Letters outside are of the script `other`.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
]
NAMES = sorted({name for *_, name in SCRIPTS} | {OTHER})
#: Script number of each code point up to 0xFFFF; -1 where it is no letter. Those beyond are looked at one by one.
_SCRIPT = np.full(0x10000, -1, np.int8)
for _c in range(0x10000):
    if chr(_c).isalpha():
        _SCRIPT[_c] = next((NAMES.index(n) for a, b, n in SCRIPTS if a <= _c <= b), NAMES.index(OTHER))
#: ASCII other than letters parts words, here.
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


class Spelt:
    """The words of a batch: their letters by script, and the features of each different word."""

    def __init__(self, text: pa.Array):
        w = self.words = Words(text, _LETTERS)
        _, first, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.start, self.length = w.start[first], w.length[first]
        # Code points of the different words, by their leading bytes.
        n = self.length
        at = np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner = np.repeat(np.arange(len(first)), n)
        b = w.buf[at]
        lead = (b & 0xC0) != 0x80
        points = self._points(b, lead)
        owner = owner[lead]
        script = _SCRIPT[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            script[i] = NAMES.index(OTHER) if chr(int(points[i])).isalpha() else -1
        real = script >= 0
        self.letters = np.bincount(owner[real] * len(NAMES) + script[real], minlength=len(first) * len(NAMES)).reshape(-1, len(NAMES))

    @staticmethod
    def _points(b: np.ndarray, lead: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(lead)
        wide = np.concatenate([b, np.zeros(4, np.uint8)]).astype(np.int64)
        c = wide[at]
        low = [wide[at + i] & 0x3F for i in (1, 2, 3)]
        two, three, four = (c & 0x1F) << 6 | low[0], (c & 0x0F) << 12 | low[0] << 6 | low[1], (c & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]
        return np.select([c < 0x80, c < 0xE0, c < 0xF0], [c, two, three], four)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature: the different word it is of, and its bucket."""
        w = self.words
        padded = np.concatenate([[0x20], w.buf, [0x20] * 8]).astype(np.uint8)
        wide = np.ndarray((len(w.buf) + 1,), np.uint64, padded, 0, (1,))  # eight bytes from the one before each position
        for kind, run in enumerate(RUNS):
            n = np.maximum(self.length + 3 - run, 1)  # runs over the word and a blank on each side
            owner = np.repeat(np.arange(len(n)), n)
            at = np.repeat(self.start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            keep = np.minimum(np.repeat(self.start + self.length + 2, n) - at, run)
            h = mix((wide[at] & ((np.uint64(1) << (keep.astype(np.uint64) * np.uint64(8))) - np.uint64(1))) * M1)
            yield owner, (h >> np.uint64(64 - BITS)).astype(np.int64) + kind * BUCKETS
        whole = hash_spans(w.buf, self.start, self.length)
        yield np.arange(len(whole)), (mix(whole * M1) >> np.uint64(64 - BITS)).astype(np.int64) + len(RUNS) * BUCKETS


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # by bucket and language: log share, less the mean of all languages
    may: np.ndarray  # by script and language: whether the language uses the script

    def words(self, s: Spelt) -> np.ndarray:
        """Score of each different word by language. A word of scripts that no language uses has all for candidates."""
        n, k = len(s.length), len(self.langs)
        out = np.zeros((n, k))
        for owner, bucket in s.features():
            for j in range(k):
                out[:, j] += np.bincount(owner, self.score[bucket, j], n)
        out[~s.letters.any(axis=1)] = 0.0  # no letters, no evidence
        used = s.letters > 0
        barred = used.astype(np.int32) @ (~self.may).astype(np.int32) > 0
        barred[barred.all(axis=1)] = False
        out[barred] -= 4 * PENALTY
        return out


def train(docs: DataFrame, use: Column) -> Model:
    """Learn from the rows with a language for which `use` holds. Every language value found is learned; there may be few, as the model has 3 * 2^16 numbers for each."""
    known = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    size = (len(RUNS) + 1) * BUCKETS

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, text in slices(batches):
            s = Spelt(text)
            coded = batch.column(1).dictionary_encode()
            lang = coded.indices.to_numpy()[s.words.doc]
            for j, name in enumerate(coded.dictionary.to_pylist()):
                times = np.bincount(s.which[lang == j], minlength=len(s.length))
                mine = sums.setdefault(name, np.zeros(size + len(NAMES), np.int64))
                for owner, bucket in s.features():
                    mine[:size] += np.bincount(bucket, times[owner], size).astype(np.int64)
                mine[size:] += times @ s.letters
        for name, mine in sums.items():
            at = np.flatnonzero(mine)
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.astype(np.int32)), pa.array(mine[part])], names=["lang", "bucket", "n"])

    # One row for a bucket and language comes to the driver.
    rows = known.mapInArrow(on, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    counts = np.zeros((size + len(NAMES), len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    column = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)
    if len(langs):
        counts[rows.column("bucket").to_numpy(), column[coded.indices.to_numpy()]] = rows.column("n").to_numpy()
    score = np.zeros((size, len(langs)), np.float32)
    for kind in range(len(RUNS) + 1):
        c = counts[kind * BUCKETS : (kind + 1) * BUCKETS] + UNSEEN
        share = np.log(c / np.maximum(c.sum(axis=0), 1))
        score[kind * BUCKETS : (kind + 1) * BUCKETS] = share - share.sum(axis=1, keepdims=True) / max(len(langs), 1)
    letters = counts[size:]
    return Model(langs, score, letters > RARE * letters.sum(axis=0))


def label(scores: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: for each text (words bounds[i] to bounds[i + 1]), the labelling with the largest sum of scores less the penalty of its changes. Ties go to the earlier language, and to no change.

    No text changes language where no run of words gains half the penalty over the best single language: a path of m
    spans then gains less than m / 2 penalties and pays m - 1. Only the other texts are stepped through, all at once.
    """
    n = np.diff(bounds)
    k = scores.shape[1]
    out = np.zeros(len(scores), np.int64)
    if not len(scores) or k < 2:
        return out
    upto = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0)])
    best = np.argmax(np.round(upto[bounds[1:]] - upto[bounds[:-1]], 9), axis=1)
    text = np.repeat(np.arange(len(n)), n)
    out[:] = best[text]
    mixed = np.zeros(len(n), bool)
    own = scores[np.arange(len(scores)), out]
    for j in range(k):
        gain = np.concatenate([[0.0], np.cumsum(scores[:, j] - own)])
        # Least sum before each word within its text: texts are set apart by a fall larger than any sum.
        fall = (gain.max() - gain.min() + 1.0) * np.arange(len(n))
        low = np.minimum.accumulate(gain[:-1] - fall[text]) + fall[text]
        np.logical_or.at(mixed, text, gain[1:] - low >= penalty / 2)
    todo = np.flatnonzero(mixed)
    todo = todo[np.argsort(-n[todo], kind="stable")]
    if not len(todo):
        return out
    first, size = bounds[todo], n[todo]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts that have a word number t
    value = scores[first].copy()
    stays, before = [], []
    for t in range(1, int(size[0])):
        m = live[t]
        v = value[:m]
        top = np.argmax(v, axis=1)
        other = v[np.arange(m), top][:, None] - penalty
        stay = v >= other
        stays.append(stay)
        before.append(top)
        value[:m] = np.where(stay, v, other) + scores[first[:m] + t]
    at = np.argmax(value, axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        out[first[:m] + t] = at[:m]
        if t:
            keep = stays[t - 1][np.arange(m), at[:m]]
            at[:m] = np.where(keep, at[:m], before[t - 1])
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, spans (first word, end word, lang).

    score is the share of the text's letters in spans of lang_pred, times the posterior of that language on these
    spans against the others. Texts that are null or have no letters, and all where nothing was learned, are `und`
    with score 0. Rows are judged one by one, so repeated ones get the same answer; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.langs)
        for batch, text in slices(batches):
            s = Spelt(text)
            bounds, count = s.words.bounds, len(text)
            if k:
                scores = m.words(s)[s.which]
                lang = label(scores, bounds)
                letters = s.letters.sum(axis=1)[s.which]
                held = np.bincount(s.words.doc * k + lang, letters, count * k).reshape(count, k)
                total = held.sum(axis=1)
                pred = np.argmax(held, axis=1)
                mine = (lang == pred[s.words.doc])[:, None] * scores
                sums = np.stack([np.bincount(s.words.doc, mine[:, j], count) for j in range(k)], axis=1)
                gap = np.clip(sums - sums[np.arange(count), pred][:, None], -700, 700)
                sure = held[np.arange(count), pred] / np.maximum(total, 1) / np.exp(gap).sum(axis=1)
            else:
                lang, total, pred, sure = np.zeros(len(s.which), np.int64), np.zeros(count), np.zeros(count, np.int64), np.zeros(count)
            named = [m.langs[p] if t else "und" for p, t in zip(pred.tolist(), total.tolist(), strict=True)]
            spans = []
            for i, t in enumerate(total.tolist()):
                l = lang[bounds[i] : bounds[i + 1]]
                cuts = [0, *(np.flatnonzero(l[1:] != l[:-1]) + 1).tolist(), len(l)] if t else []
                spans.append([{"start": a, "end": b, "lang": m.langs[l[a]]} for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(np.where(total > 0, sure, 0.0)), pa.array(spans, pa.list_(span))], names=["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession):
        return docs.select("doc_id", "text").mapInArrow(on, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
