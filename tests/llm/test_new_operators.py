"""Class language model, fill-in-middle and hard negatives against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemosaic.llm import class_lm, fill_middle, hard_negatives

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghé你") for _ in range(random.randint(1, 6))) for _ in range(300)]
PROSE = " ".join(random.choices(VOCABULARY, weights=[1 / (i + 1) for i in range(300)], k=3000))
PASSAGE = " ".join(random.choices(VOCABULARY, k=900))
TEXTS = [(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "One"), (6, None), (None, "no key <here>"), (7, "a" * 50_000), (8, "é" * 20_001), (9, "x<P>y"), (10, "<" + "<P" * 9 + "S>"),
         (11, "tail <S"), (12, PASSAGE + " one"), (13, "two " + PASSAGE), (14, PROSE * 40), (14, PROSE * 40), (15, "A B\x0bC\x1fD E"), (16, "b　c a a a"), (17, "ab" * 9000 + "<M>")] + [
    (100 + i, " ".join(random.choices(VOCABULARY, k=random.randint(1, 40)))) for i in range(60)]
CLASH = ["key", "body", "out", "n", "form", "output", "block", "part", "h1", "score", "label2", "id", "q", "held_out"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


# -- fill in the middle -----------------------------------------------------------------
def brute_fim(key, text):
    t, s = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(s[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return key, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle(docs):
    out = fill_middle.transform(docs)
    got = out.withColumn("back", fill_middle.restored()).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(brute_fim(*x) for x in TEXTS)
    assert collections.Counter((r.doc_id, r.back) for r in got) == collections.Counter((k, t or "") for k, t in TEXTS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_chunks_are_cut_by_content_and_remembered():
    a, b = ("one " + PASSAGE).encode(), ("another beginning " + PASSAGE + PASSAGE).encode()
    cache = fill_middle.Summaries()
    for text, ends in zip((a, b), fill_middle.chunk_ends([a, b])):
        assert ends[-1] == len(text) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= fill_middle.MOST
        fill_middle.rewritten(text, ends, (1, 2, 3, 4), 90, 20, cache)
    assert cache.hits >= 3 and cache.hits > cache.misses / 3
    assert fill_middle.chunk_ends([b""])[0].size == 0
    random_bytes = np.random.default_rng(1).integers(0, 256, 9000).astype(np.uint8)
    h = fill_middle.rolling(random_bytes)
    value = fill_middle._values()
    for i in (31, 40, 8999):
        assert int(h[i]) == sum(int(value[random_bytes[i - k]]) << k for k in range(32)) % 2 ** 32


@pytest.mark.parametrize("border", range(1, 12))
def test_a_sentinel_across_a_chunk_border_is_seen(border):
    text = b"0123<P>89ab"
    ends = np.unique(np.array([border, len(text)]))
    assert fill_middle.rewritten(text, ends, (1, 5, 0, 99), 90, 20, fill_middle.Summaries())[1] == "plain"
    assert fill_middle.rewritten(text.replace(b">", b"Q"), ends, (1, 5, 0, 99), 90, 20, fill_middle.Summaries())[1] == "psm"


# -- class language model -----------------------------------------------------------------
def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w] + [" "]


@pytest.fixture(scope="module")
def scored(docs):
    out, model = class_lm.fit_score(docs, classes=8, parts=3)
    return out.collect(), model


def test_counts_and_base_score(scored):
    rows, _ = scored
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 7 == 2
    count = collections.Counter(w for k, t in TEXTS if not held(k) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter((k, held(k), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for k, t in TEXTS)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_add_up_to_one():
    """Known words, the end and the estimated number of unseen words, after every context."""
    rng = np.random.default_rng(2)
    kind = np.concatenate([[0], rng.integers(1, 5, 40)])
    count = np.concatenate([[9], rng.integers(1, 6, 40)])
    total = np.bincount(kind, count, 6)  # class 5 is empty
    m = np.zeros((7, 6))
    for k, n in enumerate(total.astype(int)):
        for ctx in rng.integers(0, 5, n):
            m[ctx, k] += 1
    m[6] = [1, 2, 0, 1, 0, 0]
    once, twice = int((count == 1).sum()), int((count == 2).sum())
    model = class_lm.Model.of(m, np.bincount(kind, minlength=6), once, twice, len(count))
    assert model.tokens == count.sum() and model.others == max(1, once * (once - 1) / (2 * (twice + 1)))
    emission = 10 ** model.emission(count, kind)
    for ctx in range(7):
        assert math.isclose((10 ** model.step[ctx, kind] * emission).sum() + model.others * 10 ** model.unseen[ctx], 1, rel_tol=1e-9)


def test_exchange_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(3)
    words, classes = 30, 5
    pairs = rng.poisson(1.5, (words, words)).astype(float)
    pairs[3, 3] = 7
    cls = rng.integers(0, classes, words)

    def table(c):
        m = np.zeros((classes, classes))
        np.add.at(m, (c[:, None].repeat(words, 1), c[None].repeat(words, 0)), pairs)
        return m

    m = table(cls)
    for w in range(words):
        other = np.arange(words) != w
        right = np.bincount(cls[other], pairs[w, other], classes)
        left = np.bincount(cls[other], pairs[other, w], classes)
        gain = class_lm.exchange_gain(m, int(cls[w]), right[None], left[None], pairs[w, [w]])[0]
        for b in range(classes):
            moved = cls.copy()
            moved[w] = b
            assert math.isclose(gain[b], class_lm.likelihood(table(moved)) - class_lm.likelihood(m), abs_tol=1e-6)


def test_clusters_separate_alternating_words(spark):
    """Two kinds of words that follow each other in turn fall into different classes."""
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "b", "c", "d"]) + " " + rng.choice(["w", "x", "y", "z"]) for _ in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "a w b x c y"), (3, "a b c d a b")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in class_lm.fit_score(docs, held=F.col("doc_id") > 1, classes=6, parts=2)[0].collect()}
    assert rows[2].score - rows[2].base_score > 1.2 and rows[3].score < rows[2].score - 3


def test_no_training_and_no_rows(docs):
    rows = class_lm.fit_score(docs, held=F.lit(True), classes=8, parts=2)[0].collect()
    assert len(rows) == len(TEXTS) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert class_lm.fit_score(docs.limit(0), classes=8, parts=2)[0].count() == 0


def test_blocks_and_parts_do_not_matter(docs, scored, monkeypatch):
    """Counts and base scores are the same however rows are dealt out; pieces of a long text join without a cut word."""
    monkeypatch.setattr(class_lm, "PIECE", 64)
    text = ("word " * 40 + "x" * 300 + " end\n") * 3
    assert [w for part in class_lm.words_of(text.encode()) for w in part] == text.encode().split()
    out = class_lm.fit_score(docs.repartition(7), classes=8, parts=5)[0].collect()
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
    assert collections.Counter(map(key, out)) == collections.Counter(map(key, scored[0]))


# -- hard negatives -----------------------------------------------------------------
def brute_negatives(rows, every=10, k=5, m=10):
    fine = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) or abs(x) * 256 >= 2 ** 28 for x in v):
            continue
        q = [math.floor(256 * float(x)) for x in v]
        fine[i] = min(fine.get(i, (lab, q)), (lab, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, qa) in fine.items():
        if a % every:
            continue
        s = {b: dot(qa, q) for b, (_, q) in fine.items()}
        same = sorted((b for b, (lab, _) in fine.items() if lab == la and b != a), key=lambda b: (-s[b], b))[:k]
        for p in same:
            other = sorted((b for b, (lab, _) in fine.items() if lab != la and 30 * s[p] <= 100 * s[b] <= 90 * s[p]), key=lambda b: (-s[b], b))[:m]
            out += [(a, p, r + 1, b, s[p], s[b]) for r, b in enumerate(other)]
    return sorted(out)


@pytest.mark.parametrize("size, dims", [(900, 6), (300, 1), (40, 3)])
def test_hard_negatives(spark, monkeypatch, size, dims):
    monkeypatch.setattr(hard_negatives, "PAGE", 64)
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rng = np.random.default_rng(size)
    x = np.round(rng.normal(size=(size, dims)) * 2) / 8  # many ties
    x[: size // 3] = x[0]                                # a third are copies
    rows = [(int(i), [float(c) for c in v], int(i) % 4) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5010, [float("nan")] * dims, 1), (5020, [float("inf")] + [0.0] * (dims - 1), 1), (5030, [0.1] * dims, None), (None, [0.1] * dims, 1), (5040, [None] * dims, 2), (5050, [1e7] * dims, 2),
             (5060, [], 3), (5070, [0.25], 3), rows[10], rows[20], (30, [9.0] * dims, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    for c in ("id", "q", "v", "windows", "found", "s1"):
        df = df.withColumn(c, F.lit("clash"))
    assert sorted(map(tuple, hard_negatives.mine(df, anchors="id % 10 = 0").collect())) == brute_negatives(rows)
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_bounds_and_large_values():
    rng = np.random.default_rng(7)
    low = rng.integers(-9, 9, (5, 4))
    high = low + rng.integers(0, 9, (5, 4))
    q = rng.integers(-9, 9, 4)
    least, most = hard_negatives.bounds(low, high, q)
    for _ in range(200):
        s = (rng.integers(low, high + 1) * q).sum(1)
        assert (least <= s).all() and (s <= most).all()
    a = np.array([[(1 << 28) - 1, 3]])
    assert hard_negatives.product(a, a[0])[0] == ((1 << 28) - 1) ** 2 + 9


def test_boxes_outside_the_windows_stay_closed():
    """Clusters far apart: most leaves are never read."""
    rng = np.random.default_rng(9)
    q = np.concatenate([rng.integers(0, 5, (hard_negatives.LEAF, 3)) + c for c in ([900, 0, 0], [-900, 0, 0], [0, 900, 0], [400, 0, 0])])
    held = [hard_negatives.page_of(*hard_negatives.page_rows(1, np.arange(len(q)), q[np.argsort(q[:, 0], kind="stable")], [0, 1, 2]))]
    tree = hard_negatives.Tree(held)
    best = hard_negatives.Best(300_000, 500_000, 3)
    tree.search(-1, 2, np.array([1000, 0, 0]), [best], same=False)
    assert tree.opened <= 2 and len(best.score) == 3 and (best.score >= 400_000).all()


# -- malformed images -----------------------------------------------------------------
def test_malformed_tiff_is_an_error_row(spark):
    import struct

    from sitemosaic.llm import tiff
    good = tiff.write([bytes(range(256)) * 20])
    fields = tiff.directories(good)[0]
    assert tiff.image(good, fields)[4] == bytes(range(256)) * 20

    def changed(tag, value):
        b = bytearray(good)
        at, = struct.unpack_from("<I", b, 4)
        n, = struct.unpack_from("<H", b, at)
        for k in range(n):
            if struct.unpack_from("<H", b, at + 2 + 12 * k)[0] == tag:
                kind, = struct.unpack_from("<H", b, at + 4 + 12 * k)
                struct.pack_into("<H2x" if kind == 3 else "<I", b, at + 10 + 12 * k, value)
        return bytes(b)

    bad = [changed(tiff.ROWS_PER_STRIP, 0), changed(tiff.IMAGE_WIDTH, 65535), changed(tiff.IMAGE_LENGTH, 65535), changed(tiff.SAMPLES, 0), changed(tiff.COMPRESSION, 77), good[:len(good) // 2], good[:9], b"II", b"MM\x00*" + b"\xff" * 40]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([good, *bad, None, b""])], "i int, media binary")
    rows = tiff.pages(df).collect()
    assert [(r.i, r.page, r.error) for r in rows if r.i == 0] == [(0, 1, None)]
    assert sorted(r.i for r in rows if r.error) == list(range(1, 1 + len(bad))) and all(r.pixels is None for r in rows if r.error)


# -- odd pages ------------------------------------------------------------------------
def test_odd_html():
    import time

    from sitemosaic.llm import html_text
    texts = lambda p: [(kind, t) for _, kind, t in html_text.blocks_of(p)[1]]
    m, p, no = html_text.MAIN, html_text.PLAIN, html_text.LABELLED
    assert texts('<article class="post with-sidebar"><p>One</p></article>') == [(m, "One")] == texts('<main class="long-form"><p>One</p></main>')
    assert texts('<article class="comment"><p>One</p></article>') == [(no, "One")]
    assert texts('<article><p>One</p><svg class="i"/><p>Two</p><canvas><p>Three</p></article>') == [(m, "One"), (m, "Two"), (m, "Three")]
    assert texts("<article><p><a title=it's>x</a> y <button>Buy</button> z</p></article>") == [(m, "x y z")]
    assert texts('<p>a <b title="1 > 0" id=\'>\'>b</b> c < d</p><script>x<y</script><!-- no --><p>e') == [(p, "a b c < d"), (p, "e")]
    assert texts("<p>a<script>never closed <p>b") == [(p, "a")] and texts('<p title="open>a</p><p>b</p>')[-1] == (p, "b")
    for hostile in ('<a "' * 250_000, "<a b=" * 200_000, "<!-" * 350_000, "<a b='>" * 140_000, "<svg>" * 150_000, "<" * 1_000_000, '<a b="' * 170_000 + ">"):
        start = time.process_time()
        html_text.parse(hostile)
        assert time.process_time() - start < 8, hostile[:20]


def test_planted_passages_by_bytes(spark):
    """A passage that stands in two texts goes if it has 400 bytes with the blanks around it, whatever its words; shorter ones stay, also of over 50 words."""
    from sitemosaic.llm import suffix_dedup
    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    planted = [" ".join("".join(rng.choice("klmnopqr") for _ in range(rng.randint(3, 6 + i % 7))) for _ in range(51 + i % 13)) for i in range(40)]
    rows = [(2 * i + k, f"{fresh(30)}{'!?'[k]} {x} {'+-'[k]}{fresh(30)}") for i, x in enumerate(planted) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove(docs, suffix_dedup.repeated_spans(docs)).collect()}
    short = [i for i, x in enumerate(planted) if len(x) + 2 < suffix_dedup.LENGTH]
    assert 5 < len(short) < 35
    for i, x in enumerate(planted):
        for k in (0, 1):
            assert (x in kept[2 * i + k]) == (i in short)
            assert kept[2 * i + k] == (rows[2 * i + k][1] if i in short else rows[2 * i + k][1].replace(f" {x} ", ""))


# -- characters as the libraries have them ----------------------------------------------
def test_code_points_of_the_libraries():
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from sitemosaic.llm import bpe, pretokens, token_counts
    from sitemosaic.llm.huffman import Encoder
    from sitemosaic.llm.queries import vocabulary
    points = [*range(0x3100), *range(0xA640, 0xAC00), *range(0x10400, 0x11000), *range(0x16E00, 0x17000), *range(0x1E000, 0x1F000)]
    texts = [f"a{chr(c)}'s{chr(c)} {chr(c)}1" for c in points]
    model = token_counts.read_model(vocabulary("word_bpe_49k.json"))
    want = [e.ids for e in Tokenizer.from_str(model.source).encode_batch(texts, add_special_tokens=False)]
    normal = model.normal()
    lowered = [normal(t)[0] for t in texts]
    ids, ends = Encoder(model)(lowered)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    c = pretokens.chunk_of(list(range(len(texts))), lowered, False)
    encode = model.encoder()
    assert np.add.reduceat(np.array([len(encode(w)) for w in c.words])[c.codes], np.cumsum(c.sizes) - c.sizes).tolist() == list(map(len, want))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    c = pretokens.chunk_of(list(range(len(texts))), texts, True)
    words, at = [e.encode_ordinary(w.decode()) for w in c.words], 0
    for t, n in zip(texts, c.sizes.tolist()):
        assert [i for k in c.codes[at:at + n].tolist() for i in words[k]] == e.encode_ordinary(t), hex(ord(t[1]))
        at += n
