"""Language spans, tokenizer alignment and collocations against brute force, held-out rows, and on odd rows."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatwise.llm import alignment, collocations, languages, styletree, vectors
from heatwise.llm.common import cut, forget
from heatwise.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def test_only_made_tables_are_forgotten(spark, tmp_path):
    own = f"file://{tmp_path}/source"
    spark.range(5).write.parquet(own)
    source = spark.read.parquet(own)
    made = cut(source, "made")
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    forget(source, made)
    assert source.count() == 5 and not os.path.exists(folder)


# 11


def plain_viterbi(scores, penalty):
    value, path = list(scores[0]), [[j] for j in range(len(scores[0]))]
    for s in scores[1:]:
        top = max(range(len(value)), key=lambda j: (value[j], -j))
        move = [value[j] >= value[top] - penalty for j in range(len(s))]
        path = [path[j if move[j] else top] + [j] for j in range(len(s))]
        value = [(value[j] if move[j] else value[top] - penalty) + s[j] for j in range(len(s))]
    return max(value)


def worth(scores, labels, penalty):
    return sum(scores[i][j] for i, j in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("k", [2, 3, 5])
def test_labels_are_the_best_path(k):
    rng = np.random.default_rng(k)
    sizes = [0, 1, 2, 60, 7, 0, 25] + rng.integers(0, 40, 60).tolist()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    drift = np.repeat(rng.normal(0, 1.5, (len(sizes) * 3, k)), 20, axis=0)[: bounds[-1]]
    scores = rng.normal(0, 1, (bounds[-1], k)) + drift[: bounds[-1]]
    scores = scores[: bounds[-1]]
    got = languages.label(scores, bounds, 6.0)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            assert worth(scores[a:b].tolist(), got[a:b].tolist(), 6.0) == pytest.approx(plain_viterbi(scores[a:b].tolist(), 6.0))


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_language_spans"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_mixed_texts_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.train(docs, F.lit(True))
    assert model.langs == ["de", "en", "es", "fr"]
    by = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.max_by("text", F.when(F.length("text").between(3000, 6000), F.length("text"))).alias("t")).collect()}
    half = " ".join(by["de"].split()[:150]) + " " + " ".join(by["fr"].split()[:200])
    rows = [(1, None, 0), (2, "", 0), (None, " \n12 ...", 0), (4, half, 0), (4, half, 0), (5, "и это всё", 0), (6, by["en"] * 60, 0), (7, "😀 " * 5, 0)]
    got = languages.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred int"), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and got[7]["lang_pred"] == "und" and all(r["score"] == 0 for r in got[:3])
    assert got[3]["lang_pred"] == "fr" and got[3] == got[4] and [s["lang"] for s in got[3]["spans"]] == ["de", "fr"]
    assert got[5]["lang_pred"] in model.langs and got[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    none = languages.train(spark.createDataFrame([], docs.schema), F.lit(True))
    assert [r["lang_pred"] for r in languages.identify(docs.limit(3), none).collect()] == ["und"] * 3


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("слово и дело", "ru"), ("word and deed", "en"), ("λόγος και έργο", "el")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.identify(spark.createDataFrame([(1, "новый zzz xyz qqq"), (2, "ωωω"), (3, "жжж")], "doc_id long, text string"), languages.train(docs, F.lit(True))).collect()
    assert [r["lang_pred"] for r in got] == ["en", "el", "ru"]


# 12


def aligned_plainly(pair, rows):
    per, times = [], collections.Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        ids = [pair.a.encode(whole.decode(), add_special_tokens=False).ids, pair.b.encode(text or "")]
        if not text or any(b"".join(v[i] for i in x) != whole for x, v in zip(ids, (pair.bytes_a, pair.bytes_b))):
            per.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(v[i]) for i in x]).tolist(), range(1, len(x) + 1))) for x, v in zip(ids, (pair.bytes_a, pair.bytes_b))]
        links, groups, a0, b0 = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            a, b = ends[0][e], ends[1][e]
            links.append((ids[0][a - 1], ids[1][b - 1]))
            groups.append(",".join(map(str, ids[0][a0:a])) + "|" + ",".join(map(str, ids[1][b0:b])))
            a0, b0 = a, b
        times.update(links)
        per.append((len(ids[0]), len(ids[1]), groups, links))
    best = collections.Counter()
    for (_, b), n in times.items():
        best[b] = max(best[b], n)
    for (i, _), p in zip(rows, per):
        yield (i, 0, 0, 0, 0, 0, 0, "") if p is None else (i, p[0], p[1], len(p[2]), len(p[3]), sum(times[x] == best[x[1]] for x in p[3]), sum(times[x] for x in p[3]), hashlib.sha256(";".join(p[2]).encode()).hexdigest())


def known(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("kind", ["odd", "given", "none"])
def test_alignment(spark, kind):
    import public_tokenizers as p

    rnd = random.Random(5)
    letters = [*"ab'sT 1.\n\t\r é", "  ", " \n", " ", "　", "ß", "日", "\x1c", "\u0085", "😀", "'ll", "<|endoftext|>", "<s>", "<0x0A>", "▁", " ▁", "\x00", "the", " of", "×", "́"]
    odd = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(30)))) for i in range(1500)]
    odd += [(None, None), (None, ""), (7, "x" * 5000), (7, "word " * 20000), *odd[:50]]
    rows = {"odd": odd, "none": [], "given": [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]}[kind]
    paths = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")
    got = alignment.align(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_a int, pair string"), *paths).collect()
    assert sorted((tuple(r) for r in got), key=known) == sorted(aligned_plainly(alignment.pair(*paths), rows), key=known)


def test_perfect_hash():
    keys = np.random.default_rng(2).choice(10**9, 30_000, replace=False)
    h = alignment.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    assert (h(np.arange(10**9, 10**9 + 1000)) == -1).all()
    assert len(alignment.PerfectHash(np.zeros(0, np.int64))(np.arange(3))) == 3


def test_bits(spark):
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    packed = vectors.bits(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long").repartition(5), "k", 1 << 20)
    assert vectors.has(packed, keys).all() and vectors.has(packed, ~keys).mean() < 0.05


# 13


def mined_plainly(rows, top=2000):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        longest, found = collections.Counter(), []
        for p, a in candidates.items():
            for q in (p[:2], p[1:]) if len(p) == 3 else ():
                longest[q] = max(longest[q], a)
        for p, a in candidates.items():
            if len(p) == 3 or 100 * longest[p] < 50 * a:
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, g[2].decode(), -g[1], g[3], g[4], n[lang], -g[0]) for i, g in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 40])
def test_collocations_of_odd_rows(spark, monkeypatch, top):
    monkeypatch.setattr(collocations, "ENTRIES", 3)
    rnd = random.Random(5)
    words = "a b c d the The of é 日 x,y a.b . , \t \n \x0b\x0c q\x1cz und en".split(" ")
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))), rnd.choice([None, "und", "en", "fr", "a b", "a!b", ""])) for _ in range(2000)]
    rows += [(None, "en"), ("", None), ("word " * 30000, "zz"), ("hot pair here " * 30000, "en"), *rows[:30]]
    got = collocations.collocations(spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, n int, word string"), top)
    assert sorted(tuple(r) for r in got.collect()) == mined_plainly(rows, top)


def test_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


# 4


def test_names_do_not_decide_alone(spark):
    """A long branch of a page's own under a boilerplate name stays; a line that all pages share goes, inside main too, and so do brief adverts that differ."""
    rnd, word = random.Random(9), lambda: "".join(random.Random(rnd.random()).choices("abcdefgh", k=6))
    own = [(" ".join(word() for _ in range(300)), " ".join(word() for _ in range(200)), " ".join(word() for _ in range(8))) for _ in range(40)]
    html = "<html><body><div class='ad'>{}</div><main><p class='lead'>{}</p><div class='note'>All our stories are checked by two editors.</div></main><div class='related'>{}</div></body></html>"
    rows = [(i, f"http://a.example/{i}", html.format(c, b, a)) for i, (a, b, c) in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in styletree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{b} {a}" for i, (a, b, _) in enumerate(own)}


def test_new_pieces_go_to_the_tokenizer_together():
    """Ids are those of each piece by itself, whatever pieces stand beside it."""
    import random

    import public_tokenizers
    from heatwise.llm import tokens

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    encoder = tokens.Encoder(path)
    letters = "ab'stdlQé日 \n\t!0<|>9_𝄞 ́"
    words = list({" " + "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(6000)} | {" <|endoftext|>", "<|endoftext|>", " ", "\n", " a<|endoftext|>b", " 's", " it's", "x"})
    got, sizes = encoder.encode(words)
    want = [x.ids for x in encoder.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [len(x) for x in want] == sizes.tolist() and [i for x in want for i in x] == got.tolist()
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    plain, encoder.tokenizer = encoder.tokenizer, Counted()
    encoder.encode([f" w{i}" for i in range(5000)])
    assert len(calls) == 3


def test_words_go_to_the_model_and_signs_end_pieces():
    """Pieces that the tokenizer's split leaves whole go to its model at once; the ids stay those of whole texts."""
    import random

    import public_tokenizers
    import pyarrow as pa
    from heatwise.llm import tokens

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    encoder = tokens.Encoder(path)
    letters = [*"aZé×÷ÿɏɿʰ́߿.,;!?-_@*#9²'s |<> \n", "ing", "'ll", "<|endoftext|>", " the", "日"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(20))) for _ in range(5000)]
    got, n = encoder(pa.array(texts))
    want = [[*x.ids, tokens.END_ID] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]
    calls = []

    class Split:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    plain, encoder.tokenizer = encoder.tokenizer, Split()
    encoder.clear()
    encoder(pa.array(["Every word, été or 2024; goes on its own"]))
    assert not [c for c in calls if any(x.isalnum() for x in c)]


def test_range_coder_keeps_odd_blocks_and_bounded_memory():
    import tracemalloc

    from heatwise.llm import rangecoder

    rng = np.random.default_rng(4)
    parts = [rng.permutation(50_000)[:8192], np.zeros(8192, int), np.tile([1, 2], 4000), np.repeat(rng.integers(0, 1 << 31, 40), 100), np.array([7]), rng.integers(0, 3, 77), np.tile(rng.integers(0, 9000, 700), 9)]
    blocks = rangecoder._encode([x.astype(np.uint32) for x in parts])
    back = rangecoder._decode(rangecoder.split_blocks(b"".join(blocks)))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(parts, back, strict=True))
    ids = np.minimum(rng.zipf(1.2, rangecoder.BLOCK * rangecoder.LANES // 4), 50_000).astype(np.uint32)
    tracemalloc.start()
    data = b"".join(rangecoder.encode(ids))
    rangecoder.decode(rangecoder.split_blocks(data))
    peak = tracemalloc.get_traced_memory()[1] / rangecoder.LANES * 4
    tracemalloc.stop()
    assert peak < 180_000, peak  # bytes a block


def test_range_coder_mixes_order_two():
    """Ids that only the two before them foretell cost little, in a block of their own and among others."""
    from heatwise.llm import rangecoder

    rng = np.random.default_rng(11)
    follows, ids = rng.integers(0, 20, (20, 20)), [0, 1]
    for u in rng.random(40_000):
        ids.append(int(follows[ids[-1], ids[-2]]) if u < 0.85 else int(rng.integers(0, 20)))
    ids = np.array(ids, np.uint32) * 311
    blocks = rangecoder.encode(ids)
    assert (rangecoder.decode(rangecoder.split_blocks(b"".join(blocks))) == ids).all()
    # The source has about 1.25 bits an id; orders 0 and 1 alone took 4.05.
    assert sum(map(len, blocks)) * 8 / len(ids) < 2.5
