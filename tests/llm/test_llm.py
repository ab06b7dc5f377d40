"""The training-data operators against brute force, and on nulls, empty and odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatwise.llm import decontaminate, hmm, jaccard, mixing, quality, rangecoder, secrets, styletree, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, seg string, secrets int, copies int, paths string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", 1, 1, "y") for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "one", None), (4, "one", None), (None, "one two", "b"), (7, "é 日本 " * 40000, "b")]


@pytest.fixture(scope="module")
def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


# 1


@pytest.mark.parametrize("n", [0, 1, 2, 8191, 8192, 8193, 30000])
@pytest.mark.parametrize("kind", ["even", "skewed", "cycle"])
def test_range_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"even": rng.integers(0, 50257, n), "skewed": np.minimum(rng.zipf(1.3, n), 50000), "cycle": np.tile([5, 7, 9, 2], n // 4 + 1)[:n]}[kind]
    data = b"".join(rangecoder.encode(ids))
    assert (rangecoder.decode(rangecoder.split_blocks(data)) == ids).all()


def test_range_coder_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 300, 24000)
    blocks = rangecoder.encode(ids)
    assert (rangecoder.decode(rangecoder.split_blocks(blocks[1])) == ids[8000:16000]).all()
    broken = bytearray(blocks[0])
    broken[-400] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode(rangecoder.split_blocks(bytes(broken)))


def test_pieces_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd, letters = random.Random(3), [*"ab'sT 1.\n\t\r é", "  ", " \n", " ", "　", "  ", "ß", "日", "\x1c", "\u0085", "😀", "'ll", "<|endoftext|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got, n = tokens.Encoder(path)(pa.array(texts))
    want = [x.ids + [tokens.END_ID] for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


def test_token_files_of_odd_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.token_output(docs(spark, ODD), path).orderBy("start").collect()
    assert len(got) == len(ODD) and [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 7]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert got[1]["n_tokens"] == 1 and got[1]["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())
    assert tokens.token_output(docs(spark, []), path).count() == 0


# 2


def test_leaks_equal_exact_search_and_stand_edits(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)]
    fill = lambda n: " ".join(word() for _ in range(n))
    near = items[3][1][:60] + "#" + items[3][1][61:150] + "xy" + items[3][1][150:]
    rows = [(0, fill(300), "a"), (1, fill(80) + " " + items[1][1].upper().replace(" ", ",  ") + fill(50), "a"), (2, near, "a"), (3, items[5][1] + " " + items[6][1], "a"), (4, items[7][1][:25], "a"), *[(i, t, s) for i, t, s in ODD[:3]]]
    bench = spark.createDataFrame([*items, (99, None), (98, "short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 3), (3, 5), (3, 6)}
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {0, 4, 1, 2, 3} - {1, 2, 3} | {i for i, _, _ in ODD[:3] if i not in (1, 2, 3)}
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_leaks_of_passages_that_many_items_share(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    items = [(f"i{n}", f"{passage} question {n}") for n in range(90)] + [(f"k{n}", "the very same row of a benchmark that is repeated many times over") for n in range(90)]
    edited = passage[:40] + "#x" + passage[43:]  # edits in the first windows
    rows = [(1, passage, None), (2, items[-1][1], None), (3, edited[:96], None), (4, "no passage of the benchmark is in this text at all, not one of them", None)]
    got = collections.Counter(r["doc_id"] for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect())
    assert got == {1: 90, 2: 90, 3: 90}


def test_hits_laid_out_in_parts_give_the_same(monkeypatch):
    rng = random.Random(6)
    items = [(n, " ".join(f"v{rng.randrange(60)}" for _ in range(60))) for n in range(12)]
    text = pa.array([items[3][1], "x " * 400 + items[7][1][:150] + " y" * 400, "ha " * 3000, items[0][1][:60]])
    ix = decontaminate.build([*items, (99, "ha " * 60)])
    whole = decontaminate.find(text, ix)
    monkeypatch.setattr(decontaminate, "HITS", 500)
    assert {r[:4] for r in decontaminate.find(text, ix)} == {r[:4] for r in whole} and {r[0] for r in whole} == {0, 1, 2}


def test_banded_distance():
    region = np.frombuffer(b"xxkitten sat", np.uint8)
    assert decontaminate.banded(np.frombuffer(b"sitting", np.uint8), region)[0] == 3 and decontaminate.banded(np.frombuffer(b"kitten", np.uint8), region) == (0, 8)


# 3


def test_warc_round_trip_in_small_ranges(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i} " + "é" * (i * 700)) for i in range(1, 40)] + [(90, None, None), (91, "u", ""), (None, "v", "only")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = warc.shared_path(spark, "warc-test")
    warc.write_warc(pages.repartition(3), folder)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder, range_bytes=500).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = 39 if html == "same" and i != 39 else 91 if i == 90 else None
        assert r["refers_to"] == again and r["record_type"] == ("response" if again is None else "revisit")
        if again is None:
            assert r["payload"] == data
    assert warc.through_archives(pages.limit(0)).count() == 0


# 4


def test_main_text_of_an_article():
    page = '<html><head><title>T</title></head><body class="has-sidebar"><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>Head &amp; <b>t</b>ail</h1><p>One\n two<p>three<br>four<script>var x="</p>";</script><div class="comments">bad</div></article><aside>side</aside><form>f</form><footer>foot</footer>'
    kept = "".join(t for path, t in styletree.blocks(page) if "!" not in path)
    assert " ".join(kept.split()) == "Head & tail One two three four"
    assert styletree.blocks("<p>a &lt; b &am <!-- no --> c<di")[1][1] == "a < b &am "


def test_copies_of_an_article_in_a_div_are_kept(spark):
    article = "One story that was put on the site again and again."
    page = lambda text: f"<body><div class=content><p>{text}</p></div><div class=note>We write daily.</div></body>"
    texts = [article] * 6 + [f"Another story, number {n}." for n in range(8)]
    rows = [(n, f"http://a.b/{n}", page(t)) for n, t in enumerate(texts)] + [(100 + n, "http://only.copies/", page(article)) for n in range(6)]
    got = {r["page_id"]: r["text"] for r in styletree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {n: got[n] for n in range(14)} == dict(enumerate(texts))
    assert all(article in got[100 + n] for n in range(6))


def test_style_tree_removes_what_pages_share(spark):
    body = "<body><div class='x9'>Same words everywhere</div><div class='x8'>Own words {0} and {1}</div></body>"
    rows = [(i, f"http://site/{i}", body.format(i, i * 7)) for i in range(30)] + [(99, None, None), (98, "http://lone/", body.format(1, 2)), (97, "bad", "")]
    pages = spark.createDataFrame([(*r, 2) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r["text"] for r in styletree.main_text(pages).collect()}
    assert all(got[i] == f"Own words {i} and {i * 7}" for i in range(30))
    assert got[98] == "Same words everywhere Own words 1 and 2" and got[99] == "" and got[97] == "" and len(got) == 33
    assert styletree.main_text(pages.limit(0)).count() == 0


# 5


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    both = collections.Counter((a, b) for v in held.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def test_jaccard_components_equal_brute_force(spark, sample):
    rnd = random.Random(9)
    base = " ".join(f"w{rnd.randrange(400)}" for _ in range(120)).split()
    rows = sorted(sample[:80])
    top = max(i for i, _ in rows)
    for k in range(120):  # a large group of near copies, many of which link with few others
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(50)}"
        rows.append((top + 1 + k, " ".join(w)))
    rows += [(top + 200, "A b C d"), (top + 201, "a B c D"), (top + 202, ""), (top + 203, None), (top + 204, "a b c d e"), (top + 205, " ".join(base[:90]))]
    got = [tuple(r) for r in jaccard.jaccard_components(docs(spark, [(i, t, None) for i, t in rows])).select("doc_id", "n_shingles", "component_id").orderBy("doc_id").collect()]
    assert got == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert kept == {c if n else i for i, n, c in brute_components(rows)}


def test_jaccard_links_of_versions_under_a_shorter_hub(spark):
    rng, rows = random.Random(3), []
    for family in range(150):
        n = rng.randint(14, 120)
        words = [f"w{family}x{i}" for i in range(n)]
        for _ in range(12):  # shorter versions have lower ids, so they are hubs
            size = rng.randint(n * 55 // 100, n * 78 // 100)
            at = rng.randint(0, n - size)
            rows.append(words[at : at + size])
        rows += [[*words, *(f"e{family}y{i}" for i in range(k))] for k in (0, n // 20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = jaccard.jaccard_components(docs(spark, [(i, t, None) for i, t in rows])).select("doc_id", "n_shingles", "component_id").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(rows)


def test_jaccard_links_at_the_threshold(spark):
    rows = []
    for size in range(1, 41):  # shingles of the shorter text; the longer one has the most that still link
        for seed in range(12):
            words = [f"s{size}n{seed}w{i}" for i in range(size * 100 // 80 + 4)]
            rows += [words[: size + 4], words]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def test_jaccard_on_odd_rows(spark):
    got = jaccard.jaccard_components(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {(r["doc_id"], r["n_shingles"]) for r in got} >= {(1, 0), (2, 0), (3, 0), (4, 1), (None, 1)}
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


# 6


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("x" for _ in range(rnd.randrange(1, 200))), ["b", "a", "c", None][min(3, i % 7)]) for i in range(800)]
    got = mixing.systematic_mix(docs(spark, rows)).collect()
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    whole, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (whole - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s]) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 400 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.systematic_mix(docs(spark, rows)).collect()))


def test_mix_of_odd_rows(spark):
    assert mixing.systematic_mix(docs(spark, ODD)).count() == len(ODD)
    out = mixing.emit_mix(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns and out.count() > 0
    assert mixing.systematic_mix(docs(spark, [])).count() == 0


# 7


def test_hmm_base_is_exact_and_model_is_better(spark, sample):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(i, t, None) for i, t in sample] + [(5001, None, None), (5002, "zzz qqq", None)]
    cond = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    got = {r["doc_id"]: r for r in hmm.score(docs(spark, rows), cond).collect()}
    words = {i: [*WORD.findall((t or "").translate(LOWER)), "\0"] for i, t, _ in rows}
    c = collections.Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, held(i))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score(docs(spark, []), cond).count() == 0


def test_forward_recursion_equals_sum_over_paths():
    rng = np.random.default_rng(1)
    k = hmm.STATES
    norm = lambda a: a / a.sum(-1, keepdims=True)
    m = hmm.Model(None, None, None, None, norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, hmm.CLASSES))).T)
    seqs = [[3, 9, 7], [4], [1, 2, 3, 4, 5, 6]]
    bounds = np.cumsum([0, *map(len, seqs)])
    got = hmm._forward(np.concatenate(seqs), bounds, m)
    for s, g in zip(seqs, got, strict=True):
        a = m.start * m.emit[s[0]]
        for x in s[1:]:
            a = (a @ m.move) * m.emit[x]
        assert math.isclose(g, math.log10(a.sum()), rel_tol=1e-9)


@pytest.mark.parametrize("stretch", [1, 7, 800_000])
def test_baum_welch_counts_equal_plain_forward_and_backward(monkeypatch, stretch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    k = hmm.STATES
    norm = lambda a: a / a.sum(-1, keepdims=True)
    m = hmm.Model(None, None, None, None, norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, hmm.CLASSES))).T)
    seqs = [rng.integers(0, 50, n).tolist() for n in (1, 9, 2, 300, 9, 40)]
    emitted = np.zeros((hmm.CLASSES, k))
    starts, moved = hmm._free(np.concatenate(seqs), np.cumsum([0, *map(len, seqs)]), m, emitted)
    want_emitted, want_starts, want_moved = np.zeros_like(emitted), np.zeros(k), np.zeros((k, k))
    for s in seqs:
        alpha = [m.start * m.emit[s[0]]]
        for x in s[1:]:
            alpha.append(alpha[-1] @ m.move * m.emit[x])
            alpha[-1] /= alpha[-1].sum()
        beta = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            g = norm(alpha[t] * beta)
            want_emitted[s[t]] += g
            if t:
                pair = alpha[t - 1][:, None] * m.move * (m.emit[s[t]] * beta)
                want_moved += pair / pair.sum()
                beta = norm(m.move @ (m.emit[s[t]] * beta))
            else:
                want_starts += g
    assert np.allclose(emitted, want_emitted, rtol=1e-3, atol=1e-5)
    assert np.allclose(starts, want_starts, rtol=1e-3) and np.allclose(moved, want_moved, rtol=1e-3)


def test_words_of_their_own_class(spark):
    rows = [(h * 7919, 1, 1 + h % 4 if h < 900 else 50 + h) for h in range(1000)] + [(5, hmm.SHAPES, 10**6)]
    counts = spark.createDataFrame(rows, "h long, shape int, c long")
    assert hmm.frequent(counts).count() == 1000
    for most in (0, 1, 100, 101, 400, 999):
        c = sorted((r["c"] for r in hmm.frequent(counts, most).collect()), reverse=True)
        assert most * 0.9 - 2 <= len(c) <= most
        assert not c or min(c) >= 0.9 * sorted((r[2] for r in rows[:-1]), reverse=True)[most - 1]


# 8


def test_secrets_equal_regular_expressions(spark, sample):
    tricky = ['token=token=abcdefgh password=token:abcdef1 SECRET:"x1"', "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "é token = '12345678'", "0" * 23 + "g" + "0" * 24, "api_key=日abcdef apikey : abcdef", "ghp_" + "a" * 36, "passwd=" + "a" * 9 + "secret=bbbbbb"]
    rows = [*[(i, t, None) for i, t in sample], *[(9000 + i, t, None) for i, t in enumerate(tricky)]]
    got = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in secrets.find_secrets(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        want = []
        for n, r in enumerate(secrets.RULES):
            want += [(m.start(), n, m.end(), r.kind) for m in re.finditer(r.regex, t, re.A) if len(m[r.group]) >= r.least]
        assert got[i] == sorted(want), t
    assert sum(map(len, got.values())) >= 6


def test_trigram_queries():
    q = secrets.trigram_query(secrets.RULES[0].regex)
    assert len(q) == 1 and ["ken", "oke", "tok"] in q[0] and ["cre", "ecr", "ret", "sec"] in q[0]
    assert secrets.trigram_query(r"[0-9a-f]+") == [] and secrets.trigram_query("abc[0-9]+def") == [[["abc"]], [["def"]]]


def test_secrets_of_odd_rows(spark):
    assert secrets.find_secrets(docs(spark, ODD)).count() == len(ODD)
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# 9


def test_quality_base_equals_brute_force(spark, sample):
    rows = [*[(i, t, None) for i, t in sample], (7001, "a b\nc d\n a b\na b\n\n", None), (7002, "x y z u v w x y z u v q", None), (7003, None, None)]
    got = {r["doc_id"]: r for r in quality.cascade(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        n, count, in_ = len(w), collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)), set()
        for j in range(n - 4):
            if count[tuple(w[j : j + 5])] > 1:
                in_.update(range(j, j + 5))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(in_))
        assert r["base_failed"] == (n < 10 or 100 * len(in_) > 20 * n) and not (r["base_failed"] and r["kept"])


def test_cascade_order_changes_nothing(spark, sample):
    rows = docs(spark, [(i, t, None) for i, t in sample])
    keep = lambda rules: {(r["doc_id"], r["kept"]) for r in quality.cascade(rows, rules).collect()}
    assert keep(quality.RULES) == keep(dict(reversed(quality.RULES.items())))
    assert quality.cascade(docs(spark, ODD)).count() == len(ODD) and quality.cascade(docs(spark, [])).count() == 0


# 10


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = np.round(rng.normal(-0.3, 1, rng.integers(0, 25)), 2)

        def brute(a, b):
            best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 1e-9:
                return []
            i, j = best[3:]
            return brute(a, i) + [(i, j, best[0])] + brute(j, b)

        got, want = toxicity.maximal_segments(s), brute(0, len(s))
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_on_held_out_and_odd_rows(spark):
    rnd = random.Random(8)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "ti") for b in ("ra", "ne", "lu", "so") for c in ("n", "m", "st")]
    bad = ["vileone", "viletwo", "vilethree", "grimly"]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(20, 120))]
        if toxic := i % 5 == 0:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w), None))
        labels.append((i, int(toxic)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, rows), model).collect()}
    out = [(got[i], y) for i, y in labels if i % 3 == 0]
    assert sum(a == y for a, y in out) >= 0.97 * len(out)
    odd = toxicity.score(docs(spark, [*ODD, (50, "VILEFOUR, vileone!", None)]), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd) and [r["predicted"] for r in odd if r["doc_id"] == 50] == [1]
    nothing = toxicity.train(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs(spark, ODD), nothing).count() == len(ODD)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_id_output"]
    kept = p.STAGES[0][1](spark, source, sf)
    unique = p.STAGES[1][1](spark, kept, sf)
    assert kept.columns == unique.columns == source.columns
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert {r["doc_id"] for r in unique.collect()} == {c if n else i for i, n, c in brute_components(rows)}
    clean = p.STAGES[2][1](spark, unique, sf)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in unique.collect()} - {r["doc_id"] for r in clean.collect()}
    assert gone >= {r["doc_id"] for r in unique.collect() if any(x in r["text"] for x in items)}
    mixed = p.STAGES[3][1](spark, clean, sf)
    assert mixed.columns == source.columns and p.STAGES[4][1](spark, mixed, sf).count() == mixed.count()
