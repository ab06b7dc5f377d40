"""Quality rules as a short-circuit cascade: rules run in order of rejection per cost, each only on what the ones before it kept.

Selectivity, and the bytes and words from which a rule's cost is reckoned, are measured on a sample: the rows whose
text's hash is divisible, about SAMPLE_ROWS of the table. The order changes only the time, and is the same in each run: a document is
kept if no rule rejects it. The base metrics are asked for of each document, so the base rule costs nothing more and goes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .textops import SPACE, Words, hash_spans, mix

SAMPLE_ROWS = 1000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = UPPER.copy()
ALPHA[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def by_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order of documents: is it found twice or more in its document; is it equal to an earlier one."""
    k = key ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    again, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, length and document of each \n-split line that has a word."""
    if not len(w.buf):
        return (np.zeros(0, np.int64),) * 3
    ends = w.buf == 0x0A
    first = np.zeros(len(w.buf) + 1, bool)
    first[1:] = ends
    first[w.offsets] = True
    at = np.flatnonzero(first[:-1])
    stop = np.append(at[1:], len(w.buf))
    stop = stop - ((stop > at) & ends[np.maximum(stop - 1, 0)])
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, at)
    at, stop = at[has], stop[has]
    return at, stop - at, np.searchsorted(w.offsets, at, side="right") - 1


def base_metrics(text: pa.Array) -> tuple[dict[str, np.ndarray], Words]:
    w = Words(text)
    n = len(w.count)
    lead = (w.buf & 0xC0) != 0x80
    out = {"n_words": w.count, "word_chars": by_doc(lead & ~SPACE[w.buf], w.offsets), "n_symbols": by_doc(SYMBOLS[w.buf], w.offsets)}
    at, length, doc = lines(w)
    _, again = repeats(hash_spans(w.buf, at, length), doc)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)
    out["n_lines"] = np.bincount(doc, minlength=n)
    covered = np.zeros(len(w.hash) + 1, np.int32)
    h, k = w.hash, 5
    if len(h) >= k:
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        ok = np.flatnonzero(w.doc[: len(h) - k + 1] == w.doc[k - 1 :])
        twice, _ = repeats(s[ok], w.doc[ok])
        hit = ok[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    out["base_failed"] = (w.count < 10) | (100 * out["n_repeat_words"] > 20 * w.count)
    return out, w


# Each rule takes the texts still in question and their base metrics, and says which it rejects.
def too_many_symbols(text: pa.Array, m: dict) -> np.ndarray:
    return m["n_symbols"] > 0.2 * m["n_words"]


def too_many_dup_lines(text: pa.Array, m: dict) -> np.ndarray:
    return (m["n_lines"] >= 4) & (m["n_dup_lines"] > 0.5 * m["n_lines"])


def odd_word_length(text: pa.Array, m: dict) -> np.ndarray:
    mean = m["word_chars"] / np.maximum(m["n_words"], 1)
    return (mean < 2) | (mean > 16)


def shouting(text: pa.Array, m: dict) -> np.ndarray:
    w = Words(text, hashes=False)
    upper, alpha = by_doc(UPPER[w.buf], w.offsets), by_doc(ALPHA[w.buf], w.offsets)
    return (alpha >= 20) & (upper > 0.4 * alpha)


def mostly_digits(text: pa.Array, m: dict) -> np.ndarray:
    w = Words(text, hashes=False)
    return by_doc(DIGIT[w.buf], w.offsets) > 0.5 * np.maximum(m["word_chars"], 1)


def stuttering(text: pa.Array, m: dict) -> np.ndarray:
    """Words equal to the word before them."""
    w = Words(text)
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return np.bincount(w.doc[1:][same], minlength=len(w.count)) > 0.3 * w.count


def few_different_words(text: pa.Array, m: dict) -> np.ndarray:
    w = Words(text)
    _, again = repeats(w.hash, w.doc)
    distinct = w.count - np.bincount(w.doc[again], minlength=len(w.count))
    # Long texts repeat common words; the bound falls with the square root of length.
    return (w.count >= 40) & (distinct < np.minimum(0.3 * w.count, 2.0 * np.sqrt(w.count)))


Rule = Callable[[pa.Array, dict], np.ndarray]
#: Work of each rule for a byte and for a word, in passes over them; a rule that is not named has one of each.
WORK = {"too_many_symbols": (0, 0), "too_many_dup_lines": (0, 0), "odd_word_length": (0, 0), "shouting": (6, 1), "mostly_digits": (5, 1), "stuttering": (4, 6), "few_different_words": (4, 14)}
RULES: dict[str, Rule] = {f.__name__: f for f in (too_many_symbols, too_many_dup_lines, odd_word_length, shouting, mostly_digits, stuttering, few_different_words)}


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, cost a row, share rejected) on a sample of about sample_rows rows, in order of rejection per cost. Counts leave the tasks, texts do not."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in slices(batches):
            m, w = base_metrics(text)
            rows = [(name, int(f(text, m).sum()), len(text), len(w.buf), len(w.start)) for name, f in rules.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["rule", "rejected", "n", "bytes", "words"])

    every = max(1, docs.count() // sample_rows)
    found = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(on, "rule string, rejected long, n long, bytes long, words long")
    rows = found.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("rejected", "n", "bytes", "words")]).collect()
    seen = {}
    for r in rows:
        by_byte, by_word = WORK.get(r["rule"], (1, 1))
        seen[r["rule"]] = (1 + by_byte * r["bytes"] / r["n"] + by_word * r["words"] / r["n"], (r["rejected"] + 0.01) / r["n"])
    order = sorted(rules, key=lambda k: (-seen[k][1] / seen[k][0], k) if k in seen else (0, k))
    return [(k, *seen.get(k, (0.0, 0.0))) for k in order]


def cascade(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, base metrics, base_failed, kept and reason (base, the rejecting rule that came first, or null).

    docs: doc_id, text; one row per input row. Null texts count as empty ones, which fail the base
    rule; a text of any length is one piece of work; repeated rows are judged alike; other columns are not looked at; an empty table gives an empty result.
    """
    order = [k for k, _, _ in measure(docs, rules, sample_rows)]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches):
            m, _ = base_metrics(text)
            reason = np.where(m["base_failed"], "base", None).astype(object)
            for name in order:
                open_ = np.flatnonzero([r is None for r in reason])
                if not len(open_):
                    break
                no = rules[name](text.take(pa.array(open_)), {k: v[open_] for k, v in m.items()})
                reason[open_[no]] = name
            arrays = [batch.column(0), *[pa.array(m[c].astype(np.int64)) for c in columns], pa.array(m["base_failed"]), pa.array([r is None for r in reason], pa.bool_()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns, "base_failed", "kept", "reason"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(on, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in columns) + ", base_failed boolean, kept boolean, reason string")
