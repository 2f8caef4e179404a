"""Corpus operators against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names."""
import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemosaic.llm import bpe, decontaminate, html_text, huffman, langid, pretokens, simhash, suffix_dedup, tiff, token_counts, url_filter
from sitemosaic.llm.queries import vocabulary

CLASH = ["key", "body", "t1", "t2", "words", "h", "fp", "chunk", "part", "blob", "lang_pred", "score", "host", "spans"]
random.seed(5)
PROSE = " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(1, 7))) for _ in range(400))
LONG = " ".join("".join(random.choice("klmnopé") for _ in range(random.randint(1, 9))) for _ in range(30_000))
TEXTS = [(1, PROSE), (2, PROSE), (3, PROSE[:900] + " other words stand here now"), (4, None), (5, ""), (6, " \n\t  "), (7, "Don't they'll 'S x's 12345  \n\n ok<|endoftext|>it's"), (8, LONG), (8, LONG),
         (None, "no key"), (9, "a" * 3000), (10, "ab " * 700), (11, "ÀÉ ß İ ﬁ é Σας 你好 ²³ \u00a0\u3000x"), (12, "!!! ... ###"), (13, "One"), (13, None), (14, "x" + PROSE[100:800])]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3).withColumn("lang", F.lit("xx"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def multiset(rows):
    return collections.Counter(map(tuple, rows))


# -- tokens ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))


def test_pretokens_follow_the_patterns():
    import public_tokenizers
    import regex
    spaced, plain = regex.compile(public_tokenizers.PATTERN), regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    texts = ["".join(random.choice(" \n\t'strevmld1Aé.x\"\u3000²你") for _ in range(random.randint(0, 40))) for _ in range(1500)] + ["", "'", "'s", "a" * 200 + " b"]
    for mode, pattern in ((True, spaced), (False, plain)):
        c = pretokens.chunk_of(list(range(len(texts))), texts, mode)
        at = 0
        for t, n in zip(texts, c.sizes):
            assert [c.words[i].decode() for i in c.codes[at:at + n]] == pattern.findall(t)
            at += n


def test_byte_bpe(spark, docs, none, ranks):
    import public_tokenizers
    import tiktoken
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, ranks, parts=3), ranks)
    want = [(i, np.array(e.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS]
    assert multiset((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()) == multiset(want)
    assert {tuple(r[0]) for r in out.filter("doc_id = 13").select(bpe.ids_array("ids")).collect()} == {tuple(e.encode_ordinary("One")), ()}
    assert bpe.decode(bpe.encode(none, ranks), ranks).count() == 0


def test_a_chunk_that_changes_between_readings_fails(spark, ranks):
    from sitemosaic.llm.word_shuffle import by_distinct_word
    import os

    import pyarrow as pa

    def fresh(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.urandom(8).hex() for _ in range(b.num_rows)])], ["doc_id", "text"])
    df = spark.range(50).mapInArrow(fresh, "doc_id bigint, text string")
    with pytest.raises(Exception, match="not deterministic"):
        by_distinct_word(df, "doc_id", "text", spaced=True, encoder=lambda: len, finish=lambda *a: None, condense=lambda c: None, schema="key bigint").collect()


@pytest.fixture(scope="module")
def model():
    return token_counts.read_model(vocabulary("word_bpe_49k.json"))


def test_token_counts(docs, none, model):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_str(model.source)
    want = [(i, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    assert multiset(token_counts.count_tokens(docs, model, parts=3).collect()) == multiset(want)
    assert token_counts.count_tokens(none, model).count() == 0


def test_huffman_files(spark, docs, none, model):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_str(model.source)
    got = huffman.read_ids(spark, huffman.write_ids(docs, model, 1)).collect()
    want = [(i, np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in TEXTS]
    assert multiset((r.doc_id, bytes(r.ids)) for r in got) == multiset(want)
    at, last = 0, (False, 0)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is not None, r.doc_id or 0) >= last
        at, last = at + len(r.ids) // 4, (r.doc_id is not None, r.doc_id or 0)
    assert huffman.read_ids(spark, huffman.write_ids(none, model, 1)).count() == 0


@pytest.mark.parametrize("counts", [[1], [3, 4], [1] * 1000, [2 ** k for k in range(40)], list(range(1, 700))])
def test_huffman_code(counts):
    counts = np.array(counts, np.float64)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and (0.5 ** lengths).sum() <= 1
    if len(counts) == 40:  # free lengths would be up to 39
        assert (0.5 ** lengths).sum() == 1
    symbols = np.arange(len(counts)) * 7
    ids = np.random.default_rng(1).choice(symbols, 5000)
    code = huffman.Code(symbols, lengths)
    bits, points = code.encoder()(ids)
    assert (code.decoder()(bits, points, len(ids)) == ids).all()


# -- language ----------------------------------------------------------------------
def test_language_id(spark, none):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "123 !!", "de"), (None, "der die das und ein nicht", None), (-4, LONG, None), (-4, LONG, None)], spark_docs.schema)
    every = spark_docs.unionByName(odd)
    for c in CLASH:
        every = every.withColumn(c, F.lit("clash"))
    every = every.drop("lang_pred", "score")
    fitted = langid.fit(every, per_language=150)
    out = {r.doc_id: r for r in langid.predict(every, fitted).collect()}
    truth = {r.doc_id: r.lang for r in spark_docs.collect()}
    held = {r.doc_id for r in spark_docs.filter(langid.held_out("doc_id")).select("doc_id").collect()}
    assert held == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (-1, -2, -3)) and 0 <= out[-4].score <= 1
    assert langid.predict(none, langid.fit(none)).count() == 0
    unlabelled = langid.fit(odd.filter("doc_id = -1"))
    assert [r.lang_pred for r in langid.predict(odd, unlabelled).collect()] == ["und"] * 6


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, f"alpha beta {'x' * (i % 5)}", "good" if zlib.crc32(str(i).encode()) % 3 != 1 else "bad") for i in range(60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ["good"]


# -- near duplicates ---------------------------------------------------------------
def plain_fingerprint(t, k=4):
    import xxhash
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    s = [] if not w else [" ".join(w)] if len(w) < k else [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    a = np.array(fps, np.uint64)
    parent = list(range(len(a)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= distance, 1)).tolist():
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in TEXTS]
    comp = plain_components(fps)
    least = {c: min((TEXTS[i][0] for i in range(len(TEXTS)) if comp[i] == c and TEXTS[i][0] is not None), default=None) for c in comp}
    assert multiset(got) == multiset((TEXTS[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(len(TEXTS)))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [20_000, 20])
def test_anchors_lose_no_link(spark, most):
    """Random clusters whose members differ by up to 4 bits from another; also with every fuller anchor divided again."""
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 40))):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 4, 5))):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, most=most)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    comp = plain_components(fps)
    want = {}
    for f, c in zip(signed, comp):
        want.setdefault(c, []).append(f)
    assert {f: root.get(f, f) for f in signed} == {f: min(group) for group in want.values() for f in group}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)[:: 97]
    code = simhash.nearest(words)
    assert (np.bitwise_count(words ^ code) <= 3).all() and (simhash.nearest(code) == code).all()


# -- repeats -----------------------------------------------------------------------
def plain_removed(texts, length):
    seen = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                m[i:i + length] = b"\1" * length
        out.append(m)
    return out


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 1])
def test_suffix_dedup(spark, docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "PLACE", np.uint64((1 << 14) - 1))
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abc de") for _ in range(rng.randint(90, 700))) for _ in range(6)]
    extra = [(100 + i, "".join(rng.choice(pieces)[rng.randint(0, 60):] + rng.choice(("", "é", "q" * 30)) for _ in range(rng.randint(1, 4)))) for i in range(25)]
    rows = [r for r in TEXTS if r[0] != 8] + [(8, LONG[:60_000]), (15, "unlike " + LONG[20_000:21_000])] + extra
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("body", F.lit(1))
    got = suffix_dedup.remove(df, suffix_dedup.repeated_spans(df)).collect()
    masks = plain_removed([t for _, t in rows], 400)
    want = []
    for (i, t), m in zip(rows, masks):
        b = (t or "").encode()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(m), np.uint8), [0]]).astype(int)))
        want.append((i, len(b), tuple(map(tuple, edges.reshape(-1, 2).tolist())), bytes(x for x, y in zip(b, m) if not y)))
    assert multiset((r.doc_id, r.n_bytes, tuple((s.first, s.end) for s in r.spans), bytes(r.kept)) for r in got) == multiset(want)
    assert suffix_dedup.remove(none, suffix_dedup.repeated_spans(none)).count() == 0


# -- decontamination ---------------------------------------------------------------
def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_decontamination(spark, docs, none):
    w = PROSE.split()
    items = [(1, " ".join(w[10:40])), (2, "ONE"), (3, None), (4, "..."), (5, " ".join(w[100:113]).upper()), (6, "words stand, here"), (7, " ".join(w[50:62])), (7, " ".join(w[30:45])), (None, " ".join(w[5:20])), (8, "never seen " * 9)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("words", F.lit("clash"))
    windows = {}
    for i, t in items:
        x = plain_words(t)
        n = min(13, len(x))
        for p in range(len(x) - n + 1 if x else 0):
            windows.setdefault(tuple(x[p:p + n]), set()).add(i)
    want = []
    for i, t in TEXTS:
        x, hit, found = plain_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(x) - n + 1):
                own = windows.get(tuple(x[p:p + n]))
                if own:
                    hit.update(range(p, p + n))
                    found |= own
        want.append((i, len(x), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    got = decontaminate.decontaminate(docs, bench).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == multiset(want)
    assert all(sum(s.words for s in r.spans) == r.n_hit for r in got)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()] == [0] * len(TEXTS)


# -- pages and media ---------------------------------------------------------------
def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?y"), (2, None), (3, "no scheme"), (4, "https://a.net/fr/1#z"), (5, "https://a.net"), (6, "https://casino.org/p/"), (6, "http://www.casino.org/p.html?q"), (None, "x://casino.org/other"), (7, "http://example.com/en/"), (8, "http://notexample.com/en/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("canon", F.lit("clash"))
    listed = spark.createDataFrame([("casino.org/p",), ("casino.org/p",), (None,)], "canon string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/fr/")]
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, rules).collect()), key=str)
    want = [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/fr/1", "net/fr/", "block"), (5, "a.net", "", None, "allow"),
            (6, "casino.org", "/p/", None, "block"), (6, "www.casino.org", "/p.html", None, "block"), (0, "casino.org", "/other", None, "allow"), (7, "example.com", "/en/", "example.com/en/", "block"), (8, "notexample.com", "/en/", "com/", "allow")]
    assert got == sorted(want, key=str)
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0


def test_bloom_filter_passes_every_listed_url(spark):
    urls = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("canon"))
    table, blocks = url_filter.bloom(urls.filter("canon like '%7'"))
    passed = url_filter.possible(urls, table, blocks).filter("possible")
    assert passed.filter("canon like '%7'").count() == 500 and passed.count() < 700


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/{i}">link {i}</a></ul></nav>
<div class="cookie-notice">We use cookies {i}</div><article><h1>Title&nbsp;{i}</h1><p><b>First  &amp; {i}<br>line<p>Second {i}</p><p class="x">Same for all</p><div class=ad>Buy {i}</div><ul><li>one<li>two {i}</ul>
<section id="comments"><p>nice {i}</p></section></article><aside>side {i}</aside><form><input value="{i}">send</form><footer>&copy; {i}</footer></body></html>"""
BARE = "<body><div class=top>Our site</div><div><p>Story {i} begins here.</p><p>And goes {i} on.</p></div><div>All rights reserved</div><p><a href=x>more {i}</a></p>"


def test_html(spark):
    rows = [(i, "http://a.org/x", PAGE.format(i=i)) for i in range(30)] + [(100 + i, "http://b.org/y", BARE.format(i=i)) for i in range(8)] + [(200, "http://c.org", None), (201, None, ""), (None, "http://c.org", "<p>lone &lt;b&gt;"), (202, "http://c.org", "<div>" * 3000 + "deep"),
            (203, "http://c.org", "text only"), (204, "http://c.org", "<!-- open"), (205, "http://d.org/", PAGE.format(i=5)), (205, "http://d.org/", PAGE.format(i=5))] + [(300 + i, "http://e.org/", PAGE.format(i=7)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = collections.defaultdict(list)
    for r in html_text.extract(pages).collect():
        got[r.page_id].append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    article = "Title {i}\n\nFirst & {i} line\n\nSecond {i}\n\n{same}two {i}"
    assert all(got[i] == [article.format(i=i, same="")] for i in range(30))  # what is the same on all of 30 pages is template
    assert all(got[100 + i] == [f"Story {i} begins here.\n\nAnd goes {i} on."] for i in range(8))
    assert got[205] == [article.format(i=5, same="Same for all\n\none\n\n")] * 2 and got[303] == [article.format(i=7, same="Same for all\n\none\n\n")]  # copies are one content
    assert got[200] == got[201] == got[204] == [""] and got[None] == ["lone <b>"] and got[202] == ["deep"] and got[203] == ["text only"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_many_skeletons(spark):
    notice = "<table><tr><td>Our notice to all readers</table>"
    common = [(i, "http://f.org/", f"<div class='k{i // 3}'><p>Story {i}</div>") for i in range(90)]  # 30 skeletons of three pages
    rare = [(200 + i, "http://f.org/", f"<div class='r{i}'><p>Tale {i}</div>{notice}") for i in range(25)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(common + rare, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(90)} | {200 + i: f"Tale {i}" for i in range(25)}


def test_html_copies_under_other_menus(spark):
    around = "<nav><a href='/{i}'>menu {i}</a></nav>{body}<div class='advert a{i}'><p>buy {i}</div><footer>foot {i}</footer>"
    bare = "<div><p>Our notice</div><div><p>Story {k} begins.<p>And goes {k} on.</div>"
    marked = "<article><p>Our notice<p>Story {k} begins.<p>And goes {k} on.</article>"
    rows = [(i, "http://g.org/", around.format(i=i, body=bare.format(k=max(i, 12)))) for i in range(20)]  # 13 of 20 are copies
    rows += [(100 + i, "http://h.org/", around.format(i=i, body=marked.format(k=max(i, 300)))) for i in range(312)]  # 301 of 312 are copies
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story {max(i, 12)} begins.\n\nAnd goes {max(i, 12)} on." for i in range(20))
    assert all(got[100 + i] == f"Story {max(i, 300)} begins.\n\nAnd goes {max(i, 300)} on." for i in range(312))


def test_simple_tree_matching():
    t = html_text.Template()
    assert t.align("a(b c(d))", True) == [0, 1, 2, 3]
    assert t.align("a(b x c(d e))", True) == [0, 1, 4, 2, 3, 5]
    assert t.align("a(c(e) y)", False) == [0, 2, 5, -1]


def test_tiff(spark, docs, none):
    rng = np.random.default_rng(0)
    for n in (1, 64, 700, 5000, 70_000):
        for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), bytes(n), (b"the quick brown fox " * n)[:n]):
            data += bytes(-len(data) % 64)
            for how in [(c, p, t) for c in tiff.PACK for p in (1, 2) for t in (False, True)]:
                for order in "<>":
                    value = tiff.write([data, data[:64]], how, order=order)
                    one, two = tiff.directories(value)
                    assert tiff.image(value, one)[4] == data and tiff.image(value, two)[4] == data[:64]
    out = tiff.pages(tiff.payloads(docs.select("doc_id", "text", "body")))
    want = [(i, (t or "").encode()) for i, t in TEXTS]
    assert multiset((r.doc_id, r.n_bytes, bytes(r.pixels)) for r in out.collect()) == multiset((i, len(b), b + bytes(-len(b) % 64 or (0 if b else 64))) for i, b in want)
    assert tiff.pages(tiff.payloads(none)).count() == 0
    cut = tiff.write([PROSE.encode()])
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"not a tiff"), (4, cut[:200] ), (5, tiff.write([b"a", b"b"]))], "id int, media binary")
    got = [(r.id, r.page, r.error is None) for r in tiff.pages(odd).orderBy("id", "page").collect()]
    assert got == [(3, 0, False), (4, 0, False), (5, 1, True), (5, 2, True)]
    with pytest.raises(ValueError, match="clash"):
        tiff.pages(odd.withColumn("page", F.lit(1)))
