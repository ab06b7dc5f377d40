"""Token ids of documents as binary files: encoded with a public tokenizer, coded by the range coder, and read back.

A file holds the documents of one range of doc_id, in ascending order, so that files in order of name hold all ids in
ascending order of doc_id: blocks of the range coder, then the list of documents (doc_id, ids of each), then a footer.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, shared_path, slices, small
from .rangecoder import BLOCK, LANES, decode, encode, read_blocks
from .textops import raw

END_ID = 2
#: Ids that are coded in step, and pieces of text of which a worker remembers the ids.
GROUP = BLOCK * LANES
MOST_PIECES = 120_000
#: New pieces that go to the tokenizer as one text.
JOINED = 2000
FOOTER = struct.Struct("<8sQQ")  # magic, documents, bytes of their list
MAGIC = b"TOKENS01"
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, bool)  # leading bytes of two-byte letters, none of which is white space
_TWO[0xC3:0xE0] = True
#: ASCII letters and digits; leading bytes of two-byte letters (U+00C0 to U+027F, but for two signs); signs that end a word of the tokenizer's split (not those of contractions and of special tokens).
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0xC3:0xCA] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b'!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = True
#: Pieces that the tokenizer's split leaves whole.
WHOLE = re.compile(" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u027F]+|[0-9]+)")
#: The characters that stand for bytes in a byte-level vocabulary.
_SHOWN = np.array([b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else 0 for b in range(256)], np.uint32)
_SHOWN[_SHOWN == 0] = 256 + np.arange(int((_SHOWN == 0).sum()))
_SHOWN[0x0A] = 0x0A  # stands between pieces


def pieces(text: pa.Array, signs: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where a token must end, whatever stands around: before a single space or line break after a word. With the n + 1 piece numbers at which texts begin.

    signs: for a byte-level tokenizer, between letters or digits and signs as well, so that there are fewer different pieces.
    """
    buf, offsets = raw(text)
    n = len(buf)
    cut_ = np.zeros(n + 1, bool)
    if n > 2:
        solid = _PLAIN[buf]
        before = solid.copy()  # the character that ends here is no white space
        before[1:] |= _TWO[buf[:-1]] & (buf[1:] >= 0x80)
        after = solid | _TWO[buf]
        lone = before[:-2] & after[2:]
        space, line = (buf[1:-1] == 0x20) & lone, (buf[1:-1] == 0x0A) & lone
        cut_[1 : n - 1] = space | line
        cut_[2:n] |= line
        if signs:
            word, sign = _WORD[buf], _SIGN[buf]
            ends = word.copy()
            ends[1:] |= _LETTER[buf[:-1]] & (buf[1:] >= 0x80) & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
            cut_[1:n] |= (ends[:-1] & sign[1:]) | (sign[:-1] & word[1:])
        inner = np.unique(np.concatenate([offsets, np.maximum(offsets - 1, 0)]))
        cut_[inner[inner < n]] = False  # a character at the edge of a text has no neighbour there
    cut_[offsets] = True
    at = np.flatnonzero(cut_)
    first = np.searchsorted(at, offsets)
    whole = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))) if len(at) > 1 else pa.array([], pa.large_string())
    return whole, first


@cache
def encoder(path: str) -> Encoder:
    """One for each worker, so that tasks that follow each other know the pieces of those before."""
    return Encoder(path)


class Encoder:
    """Ids of texts: each different piece is encoded once, and remembered until there are too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of each token: a byte is a character of its entry, and added ones stand as they are.
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(entry)
        # The same model without the split, for pieces that it leaves whole.
        self.model = Tokenizer(self.tokenizer.model)
        for i, added in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(added.content.encode())
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _of_text(self, words: list[str]) -> list[int]:
        return self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids

    def _of_words(self, words: list[str]) -> list[int]:
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        return self.model.encode_batch_fast([_SHOWN[data].tobytes().decode(f"utf-32-{sys.byteorder[0]}e").split("\n")], is_pretokenized=True, add_special_tokens=False)[0].ids

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. Words go to the model as they are; pieces from a single space to the end of a word cannot meet, so many go as one text. Both are told apart by the bytes of their tokens."""
        whole = [WHOLE.fullmatch(w) is not None for w in words]
        plain = [i for i, w in enumerate(words) if not whole[i] and w[0] == " " and "!" <= w[1:2] <= "~" and "!" <= w[-1] <= "~"]
        got: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        order: list[int] = []
        for way, numbers in ((self._of_words, list(compress(range(len(words)), whole))), (self._of_text, plain)):
            for at in range(0, len(numbers), JOINED):
                some = numbers[at : at + JOINED]
                here = [words[i] for i in some]
                ids = np.array(way(here), np.int32)
                upto = np.cumsum(self.n_bytes[ids])
                ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in here])
                stop = np.searchsorted(upto, ends) + 1
                if stop[-1] != len(ids) or (upto[stop - 1] != ends).any():
                    raise ValueError("a token runs over the end of a piece")
                sizes[some] = np.diff(stop, prepend=0)
                got.append(ids)
                order += some
        together = set(order)
        alone = [i for i in range(len(words)) if i not in together]
        for i, x in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            got.append(np.array(x.ids, np.int32))
            sizes[i] = len(got[-1])
        flat, order = np.concatenate(got), np.array(order + alone)
        # From the order of encoding to that of words.
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)], sizes

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END_ID after it, and how many each has."""
        if len(self.known) > MOST_PIECES:
            self.clear()
        parts, first = pieces(text, signs=True)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        fresh = [w for w, k in zip(words, found, strict=True) if k is None]
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            found = list(map(self.known.__getitem__, words))
        number = np.array([*found, 0], np.int64)
        if fresh:
            got, sizes = self.encode(fresh)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, got])
        which = number.take(coded.indices.to_numpy()) if len(parts) else np.zeros(0, np.int64)
        start = self.start.take(which)
        size = np.diff(self.start).take(which) if len(which) else start
        upto = np.concatenate([[0], np.cumsum(size)])
        per_doc = upto[first[1:]] - upto[first[:-1]]
        # Each piece's ids go behind the ids, and the end ids, of what is before it.
        doc = np.repeat(np.arange(len(per_doc)), np.diff(first))
        gap = np.repeat((start - upto[:-1] - doc).astype(np.int32), size)
        out = np.full(int(upto[-1]) + len(per_doc), END_ID, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(per_doc + 1) - 1] = False
        at = np.flatnonzero(inside)
        out[at] = self.flat.take(at + gap)
        return out, per_doc + 1


def footer(docs: int, listed: int) -> bytes:
    return FOOTER.pack(MAGIC, docs, listed)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write the files; one row per file: file, n_docs, n_ids. Null texts count as empty; rows of one doc_id follow each other, null doc_id first."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def blocks() -> Iterator[bytes]:
            held, waiting = [], 0
            for batch, text in slices(batches):
                got, n = encoder(tokenizer)(text)
                held.append(got)
                waiting += len(got)
                ids.append(batch.column(0))
                sizes.append(n)
                if waiting >= GROUP:
                    got = np.concatenate(held)
                    held = [got[waiting // GROUP * GROUP :].copy()]
                    for at in range(0, waiting - GROUP + 1, GROUP):
                        yield from encode(got[at : at + GROUP])
                    waiting %= GROUP
            yield from encode(np.concatenate(held)) if held else ()
            # The worker stays for other tasks, so what Arrow holds unused goes back.
            pa.default_memory_pool().release_unused()

        # A task that runs again, or twice, leaves one whole file: it gets its name when it is whole.
        fs, name = pafs.FileSystem.from_uri(folder)
        file = f"part-{TaskContext.get().partitionId():06d}.tok"
        own, f = f"{name}/{file}.{uuid.uuid4().hex}.tmp", None
        for block in blocks():
            f = f or fs.open_output_stream(own)
            f.write(block)
        if f is None:
            return
        n = np.concatenate(sizes)
        doc = pa.concat_arrays(ids).cast(pa.int64())
        listed = zlib.compress(doc.fill_null(0).to_numpy().astype("<i8").tobytes() + n.astype("<i8").tobytes() + doc.is_null().to_numpy(zero_copy_only=False).tobytes(), 1)
        f.write(listed)
        f.write(footer(len(n), len(listed)))
        f.close()
        fs.move(own, f"{name}/{file}")
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(n)]), pa.array([int(n.sum())])], names=["file", "n_docs", "n_ids"])

    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    with arrow_rows(docs.sparkSession):
        return cut(ordered.mapInArrow(on, "file string, n_docs long, n_ids long"), "token-files")


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """doc_id, whether it is null, ids of each document and their crc32, for the documents that end in each group of blocks."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        f.seek(f.size() - FOOTER.size)
        magic, docs, listed = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        end = f.size() - FOOTER.size - listed
        f.seek(end)
        head = zlib.decompress(f.read(listed))
        doc, n, null = np.frombuffer(head, "<i8", docs), np.frombuffer(head, "<i8", docs, docs * 8), np.frombuffer(head, bool, docs, docs * 16)
        stop, first, at, crc = np.cumsum(n), 0, 0, 0
        for group in read_blocks(f, end):
            data = memoryview(decode(group).astype("<u4")).cast("B")
            upto, here, crcs = at + len(data) // 4, 0, []
            last = int(np.searchsorted(stop, upto, side="right"))
            for s in ((stop[first:last] - at) * 4).tolist():
                crcs.append(zlib.crc32(data[here:s], crc))
                here, crc = s, 0
            crc = zlib.crc32(data[here:], crc)  # of a document that goes on in the next group
            yield doc[first:last], null[first:last], n[first:last], crcs
            first, at = last, upto


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                at = 0
                for doc, null, n, crc in read_file(f"{folder}/{file}"):
                    stop = at + np.cumsum(n)
                    at += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(stop - n), pa.array(n), pa.array(crc, pa.int64()), pa.array([file] * len(n), pa.string())], names=["doc_id", "at", "n_tokens", "ids_crc32", "file"])

    # One row per file, as many as tasks wrote: their running sum is no sum over documents.
    n = max(1, files.count())
    docs = files.select("file").repartition(n, "file").mapInArrow(on, "doc_id long, at long, n_tokens long, ids_crc32 long, file string")
    before = files.select("file", F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(small(before, 100_000), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents' ids under shared storage and read them back (see read_tokens).

    A text of any length may run through many blocks; a task holds GROUP ids and a batch of texts at once. Rows of one doc_id, and of none, are
    dealt over tasks by a hash of their text. Other columns are not looked at; an empty table gives an empty result.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer))
