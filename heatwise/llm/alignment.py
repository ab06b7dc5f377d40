"""Alignment of two tokenizers over a corpus: which of A's ids end where which of B's end, and how often.

A text is cut where both tokenizers must have a boundary, so each different piece is tokenised and aligned once for a
worker. The first pass writes, for each task, how often it saw each pair of ids. The different pairs get a minimal
perfect hash with their keys beside it, so a task's counts become one dense vector, and vectors are summed as a tree.
The second pass aligns the documents again and looks the counts up, each key verified.

A pair is linked only where one token's bytes are a suffix of the other's, so the two vocabularies bound the number of
pairs (`most_pairs`) whatever the corpus: that bounds the hash, the vector and what is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import arrow_rows, cut, slices
from .textops import M1, mix
from .tokens import pieces

#: Pieces of text whose alignment a worker remembers, and bytes of text it handles at once.
MOST_PIECES = 400_000
SLICE = 1_000_000
#: A space and then letters, digits and signs of Latin script: any two such parts have a boundary between them, so A may get many as one text.
PLAIN = re.compile(r" [!-~\u00C0-\u024F]+")
#: How the byte-level tokenizer splits a text before it merges bytes. A fixed value of its public vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of sizes, in a row."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - sizes, sizes)


class Pair:
    """The two tokenizers, the bytes of each of their ids, and their ids as text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are text
        level = byte_level()
        words = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.bytes_a[i] = bytes(level[c] for c in w) if all(c in level for c in w) else w.encode()
        # The same vocabulary in a faster library, for plain parts; its ids are the order of its merges.
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={self.bytes_a[i]: i for i in vocabulary.values()}, special_tokens={})
        self.n_b = self.b.vocab_size()
        own = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(own)]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.text_a = [f"{i}{s}".encode() for s in ",|" for i in range(len(self.bytes_a))]
        self.text_b = [f"{i}{s}".encode() for s in ",;" for i in range(self.n_b)]

    def most_pairs(self) -> int:
        """Pairs of ids of which one's bytes are a suffix of the other's: no more can ever be linked."""
        a, b = Counter(self.bytes_a), Counter(self.bytes_b)
        longer_a = sum(n * b.get(t[i:], 0) for t, n in a.items() for i in range(len(t)))
        return longer_a + sum(n * a.get(t[i:], 0) for t, n in b.items() for i in range(1, len(t)))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all parts in a row and how many each has, then B's.

        A gets the plain parts as one text, whose ids are dealt out by their bytes. B puts a space before what it is
        given, so a part's own first space is left to it; before another part stands a line break, whose two ids
        (space, break) go again.
        """
        plain = np.array([PLAIN.fullmatch(p) is not None for p in parts], bool)
        together = list(compress(parts, plain))
        ids = np.array(self.fast.encode_ordinary("".join(together)), np.int64)
        ends = np.cumsum(self.size_a[ids])
        stops = np.cumsum(np.fromiter((len(p.encode()) for p in together), np.int64, len(together)))
        others = [e.ids for e in self.a.encode_batch_fast(list(compress(parts, ~plain)), add_special_tokens=False)]
        n_a = np.empty(len(parts), np.int64)
        n_a[plain] = np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)
        n_a[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        flat_a, of_plain = np.empty(int(n_a.sum()), np.int64), np.repeat(plain, n_a)
        flat_a[of_plain] = ids
        flat_a[~of_plain] = np.fromiter(chain.from_iterable(others), np.int64, len(flat_a) - len(ids))
        b = self.b.encode([p[1:] if p.startswith(" ") else "\n" + p for p in parts], num_threads=1)
        b = [x if p.startswith(" ") else x[2:] for p, x in zip(parts, b, strict=True)]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        return flat_a, n_a, np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum())), n_b


@cache
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Aligned:
    """Alignments of the pieces a worker has met: ids of each, the codes of linked pairs, and, if spell is set, groups as text."""

    def __init__(self, tokenizers: Pair, spell: bool):
        self.t, self.spell = tokenizers, spell
        self.size_a, self.size_b = tokenizers.size_a, tokenizers.size_b
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.n_a, self.n_b, self.ok = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.codes, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each piece of text; those not met before are tokenised and aligned."""
        out, fresh = np.empty(len(words), np.int64), []
        for i, w in enumerate(words):
            k = self.known.get(w)
            if k is None:
                k = self.known[w] = len(self.known)
                fresh.append(w)
            out[i] = k
        if fresh:
            self._align(fresh)
        return out

    def _align(self, fresh: list[str]) -> None:
        flat_a, n_a, flat_b, n_b = self.t.encode(fresh)
        whole_a, whole_b = self.t.bytes_a, self.t.bytes_b
        # Where all bytes of the batch agree, each piece's do, if their sizes do; else each piece is looked at.
        size = np.array([len(w.encode()) for w in fresh], np.int64)
        text = "".join(fresh).encode()
        doc_a, doc_b = np.repeat(np.arange(len(fresh)), n_a), np.repeat(np.arange(len(fresh)), n_b)
        got_a, got_b = np.bincount(doc_a, self.size_a[flat_a], len(fresh)), np.bincount(doc_b, self.size_b[flat_b], len(fresh))
        ok = (got_a == size) & (got_b == size)
        if not (ok.all() and b"".join(map(whole_a.__getitem__, flat_a.tolist())) == text == b"".join(map(whole_b.__getitem__, flat_b.tolist()))):
            a, b = (np.split(flat, np.cumsum(n)[:-1]) for flat, n in ((flat_a, n_a), (flat_b, n_b)))
            ok = np.array([b"".join(map(whole_a.__getitem__, x.tolist())) == w.encode() == b"".join(map(whole_b.__getitem__, y.tolist())) for w, x, y in zip(fresh, a, b, strict=True)])
            keep_a, keep_b = ok[doc_a], ok[doc_b]
            flat_a, flat_b, doc_a, doc_b = flat_a[keep_a], flat_b[keep_b], doc_a[keep_a], doc_b[keep_b]
            n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        shut_a, shut_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        codes = flat_a[shut_a] * self.t.n_b + flat_b[shut_b]  # tokens have bytes, so one of each ends at a common end
        groups = np.bincount(doc_a[shut_a], minlength=len(fresh))
        if self.spell:
            self._spell(flat_a, flat_b, shut_a, shut_b, n_a + n_b)
        self.n_a, self.n_b, self.ok = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b]), np.concatenate([self.ok, ok])
        self.codes, self.start = np.concatenate([self.codes, codes]), np.concatenate([self.start, self.start[-1] + np.cumsum(groups)])

    def _spell(self, flat_a: np.ndarray, flat_b: np.ndarray, shut_a: np.ndarray, shut_b: np.ndarray, n: np.ndarray) -> None:
        """Ids as text: those of A in a group, then those of B; what follows an id is , or | or ;"""
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        place = np.lexsort((np.concatenate([np.zeros(len(flat_a), bool), np.ones(len(flat_b), bool)]), np.concatenate([group_a, group_b])))
        said = list(map(self.t.text_a.__getitem__, (flat_a + shut_a * len(self.t.bytes_a)).tolist()))
        said += map(self.t.text_b.__getitem__, (flat_b + shut_b * self.t.n_b).tolist())
        said = [said[i] for i in place.tolist()]
        upto = np.concatenate([[0], np.cumsum(n)]).tolist()
        self.texts += [b"".join(said[i:j]) for i, j in zip(upto, upto[1:], strict=False)]

    def documents(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of the texts, each with a space before it, and the n + 1 places where texts begin. Empty texts, and those whose bytes either tokenizer changes, have no pieces."""
        rows = text.to_pylist()
        parts, first = pieces(pa.array([" " + t if t else "" for t in rows], pa.large_string()))
        coded = parts.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())
        which = number[coded.indices.to_numpy()] if len(parts) else np.zeros(0, np.int64)
        count = np.diff(first)
        if not self.ok[number].all():  # of these texts all pieces go, unless their bytes are right as a whole
            doc = np.repeat(np.arange(len(rows)), count)
            keep = np.ones(len(which), bool)
            for d in np.unique(doc[~self.ok[which]]).tolist():
                whole = int(self.numbers([" " + rows[d]])[0])
                keep[first[d] : first[d + 1]] = False
                if self.ok[whole]:
                    keep[first[d]], which[first[d]] = True, whole
            count = np.bincount(doc[keep], minlength=len(rows))
            which = which[keep]
        return which, np.concatenate([[0], np.cumsum(count)])


@cache
def remembered(path_a: str, path_b: str, spell: bool) -> Aligned:
    """One for each worker and pass: tasks that follow each other know the pieces of those before."""
    return Aligned(pair(path_a, path_b), spell)


def texts_of(batches: Iterator[pa.RecordBatch], known: Aligned) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, text in slices(batches, limit=SLICE):
        yield batch, *known.documents(text)


class PerfectHash:
    """Maps each of n different keys to its own number from 0 to n - 1; a key that is none of them is told by the keys kept beside it.

    Keys go to a place of a bit array of twice their number; those alone at their place stay, the others go on to the
    next, smaller array. A key's number is how many places are taken before its own.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys)
        self.taken: list[np.ndarray] = []
        left, level = keys, 0
        while len(left):
            at = self._place(left, level, 2 * len(left))
            hit = np.bincount(at, minlength=2 * len(left))
            self.taken.append(hit == 1)
            left, level = left[hit[at] != 1], level + 1
        counts = [0, *np.cumsum([int(t.sum()) for t in self.taken]).tolist()]
        self.rank = [np.cumsum(t) - 1 + c for t, c in zip(self.taken, counts, strict=False)]
        self.keys = np.full(len(keys), -1, np.int64)
        self.keys[self._number(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix((keys.astype(np.uint64) + np.uint64(level + 1)) * M1) % np.uint64(size)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (taken, rank) in enumerate(zip(self.taken, self.rank, strict=True)):
            if not len(left):
                break
            at = self._place(keys[left], level, len(taken))
            mine = taken[at]
            out[left[mine]] = rank[at[mine]]
            left = left[~mine]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 if it is none of the keys."""
        out = self._number(keys)
        if len(self.keys):
            out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out


def seen_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """First pass: (pair, n), how often each task saw each pair of ids linked; pair is A's id times B's size plus B's id."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = remembered(path_a, path_b, False), [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def settle(times: np.ndarray) -> None:
            """Pairs of the pieces met so far, each as often as its piece."""
            links = np.diff(known.start)
            codes, where = np.unique(np.concatenate([totals[0], known.codes]), return_inverse=True)
            n = np.concatenate([totals[1], np.repeat(times, links)])
            order = np.argsort(where, kind="stable")
            sums = np.add.reduceat(n[order], np.searchsorted(where[order], np.arange(len(codes)))) if len(codes) else n
            totals[:] = codes[sums > 0], sums[sums > 0]

        times = np.zeros(len(known.known), np.int64)
        for _, which, _ in texts_of(batches, known):
            times = np.concatenate([times, np.zeros(len(known.known) - len(times), np.int64)])
            times += np.bincount(which, minlength=len(times))
            if len(known.known) > MOST_PIECES:
                settle(times)
                known.clear()
                times = np.zeros(0, np.int64)
        settle(times)
        for at in range(0, len(totals[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in totals], names=["pair", "n"])

    return docs.select("text").mapInArrow(on, "pair long, n long")


def pair_counts(seen: DataFrame, most: int) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash of all different pairs, at most `most`, and the corpus-wide count of each by its number."""
    keys = seen.select("pair").distinct().toArrow().column("pair").to_numpy()
    if len(keys) > most:
        raise ValueError(f"{len(keys)} pairs, but the vocabularies allow {most}")
    numbers = PerfectHash(keys)
    shared, fan = seen.sparkSession.sparkContext.broadcast(numbers), vectors.branches(seen)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            at = shared.value(batch.column(0).to_numpy())
            if (at < 0).any():
                raise ValueError("a pair without a number")
            np.add.at(counts, at, batch.column(1).to_numpy())
        yield from vectors.chunks(counts, fan)

    return numbers, vectors.add(seen.select("pair", "n").mapInArrow(on, vectors.SCHEMA), len(keys))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of docs: doc_id (long), n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens. Equal rows are
    counted as often as they come; a null doc_id stays null; other columns are not looked at; an empty table gives an
    empty result. A text of any length is cut into pieces first; a piece without a boundary is tokenised as a whole.
    """
    with arrow_rows(docs.sparkSession):
        seen = cut(seen_pairs(docs, path_a, path_b), "token-pairs")
    own = pair(path_a, path_b)
    numbers, counts = pair_counts(seen, own.most_pairs())
    n_b, best = own.n_b, np.zeros(own.n_b, np.int64)
    np.maximum.at(best, numbers.keys % n_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, counts, best))

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (numbers, counts, best) = remembered(path_a, path_b, True), shared.value
        stats = np.zeros((7, 0), np.int64)  # of each piece met so far: COLUMNS, and links whose pair has no number

        for batch, which, first in texts_of(batches, known):
            if len(known.known) > stats.shape[1]:
                done = stats.shape[1]
                codes, start = known.codes[known.start[done] :], known.start[done:] - known.start[done]
                at = numbers(codes)
                n = np.where(at < 0, 0, counts[at]) if len(counts) else at * 0
                each = [n == best[codes % n_b], n, at < 0]
                upto = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(each, axis=1, dtype=np.int64)], axis=1)
                links = np.diff(start)
                stats = np.concatenate([stats, np.stack([known.n_a[done:], known.n_b[done:], links, links, *np.diff(upto[:, start], axis=1)])], axis=1)
            upto = np.concatenate([np.zeros((7, 1), np.int64), np.cumsum(stats[:, which], axis=1)], axis=1)
            *sums, strange = np.diff(upto[:, first], axis=1)
            if strange.any():
                raise ValueError("a pair that the first pass did not see")
            said, at = list(map(known.texts.__getitem__, which.tolist())), first.tolist()
            digest = [hashlib.sha256(b"".join(said[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.array(digest, pa.string())], names=["doc_id", *COLUMNS, "groups_sha256"])
            if len(known.known) > MOST_PIECES:
                known.clear()
                stats = np.zeros((7, 0), np.int64)

    with arrow_rows(docs.sparkSession):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(on, f"doc_id long, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string")
