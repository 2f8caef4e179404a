"""The pipeline's stages on a small corpus, each against brute force, and the registered queries with SQL."""
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline as cp  # noqa: E402
from compare import compare, duck  # noqa: E402
from test_corpus_operators import plain_components, plain_fingerprint, plain_removed, plain_words  # noqa: E402

from sitemosaic.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = {"xx": ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)], "yy": ["".join(rng.choice("pqrstuvw") for _ in range(rng.randint(2, 7))) for _ in range(400)]}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(("xx", "yy")[i % 2], rng.randint(60, 200)), ("xx", "yy")[i % 2], "s", 0) for i in range(80)]
    passage, item = say("xx", 120), say("yy", 30)
    rows += [(100 + i, say("xx", 40) + " " + passage + " " + say("xx", 40), "xx", "s", 0) for i in range(4)]
    rows += [(200, rows[3][1], "yy", "copy", 0), (201, rows[3][1] + " end", "yy", "copy", 0), (202, say("yy", 20) + " " + item + " " + say("yy", 20), None, "s", 0), (203, "12 34 !!", "xx", "s", 0), (204, None, "xx", "s", 0), (205, "", None, None, None), (None, say("yy", 50), "yy", "s", 0)]
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("n_chars", F.char_length("text").cast("bigint"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), item


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, corpus, tmp_path):
    d, item = corpus
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = texts(docs)
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language_id":
            assert texts(out) == {i: t for i, t in seen.items() if i not in (203, 204, 205)}
        elif name == "near_duplicates":
            named = [i for i in seen if i is not None]
            comp = plain_components([plain_fingerprint(seen[i]) for i in named])
            least = {c: min(named[j] for j in range(len(named)) if comp[j] == c) for c in comp}
            assert texts(out) == {i: seen[i] for i in [*least.values(), None]}
            assert 3 in least.values() and 200 not in least.values()
        elif name == "repeated_passages":
            want = {i: bytes(x for x, y in zip(t.encode(), m) if not y).decode() for (i, t), m in zip(seen.items(), plain_removed(list(seen.values()), 400))}
            assert texts(out) == want and len(want[101]) < len(seen[101])
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "decontamination":
            w = plain_words(item)
            windows = {tuple(w[i:i + 13]) for i in range(len(w) - 12)}
            hit = set()
            for i, t in seen.items():
                x = plain_words(t)
                n = {q for p in range(len(x) - 12) if tuple(x[p:p + 13]) in windows for q in range(p, p + 13)}
                if n and 20 * len(n) >= len(x):
                    hit.add(i)
            assert hit == {202} and texts(out) == {i: t for i, t in seen.items() if i not in hit}
        else:
            import hashlib
            assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in seen.items()}
            break
        assert out.columns == columns
        docs, seen = out, texts(out)
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, out.collect()))


def test_no_documents(spark, corpus):
    d, _ = corpus
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, d).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_short_passages(spark):
    rng = random.Random(5)
    fresh = lambda n, most=9: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, most))) for _ in range(n))
    shared = {n: fresh(n, 6) for n in (50, 51, 55, 60)}
    one = " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(51))  # 101 bytes
    shared |= {0: one, 1: fresh(53, 5).replace(" ", " "), 2: "".join(chr(0x4e00 + rng.randrange(5000)) for _ in range(140)), 3: fresh(10, 4) + " " + "w" * 1500 + " " + fresh(45, 4)}
    assert all(len(shared[n].encode()) < 400 for n in shared if n not in (2, 3))
    apart = shared[55].replace(" ", "\n")  # other blanks between the same words
    rows = [(100 * n + i, f"{fresh(30)} {p} {fresh(30)}") for n, p in shared.items() for i in range(3)]
    rows += [(9000, f"{fresh(9)} {apart} {fresh(9)}"), (9001, f"{fresh(20)} {shared[60]} {fresh(20)} {shared[60]}"), (9002, shared[51]), (9003, None), (None, shared[51])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.char_length("text"))
    got = texts(cp.repeated_passages(spark, docs, ""))
    for n, p in shared.items():
        for i in range(3):
            before, after = dict(rows)[100 * n + i].split(p)
            if n in (2, 3):  # by bytes, where the cut may reach further by chance
                assert p not in got[100 * n + i]
            else:
                assert got[100 * n + i] == (before + after if n != 50 else before + p + after), n
    assert got[9000].split() == dict(rows)[9000].replace(apart, "").split()
    assert shared[60] not in got[9001] and len(got[9001].split()) == 40 and got[9002] == got[9003] == got[None] == ""


def test_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    item = fresh(30)
    copied, alone, clean, dirty = fresh(80), fresh(80), fresh(80), f"{fresh(10)} {item} {fresh(10)}"
    rows = [(1, copied), (5, copied), (5, alone), (6, alone + " x"), (7, clean), (7, dirty), (8, clean + " y"), (9, fresh(80)), (None, dirty), (None, dirty)]
    rows += [rows[7]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    comp = plain_components([plain_fingerprint(t) for _, t in rows])
    assert comp[2] == comp[3] and comp[4] == comp[6] and len(set(comp[:8])) == 5
    kept = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(1, copied), (5, alone), (7, clean), (7, dirty), rows[7], (None, dirty), (None, dirty)], key=str)
    left = sorted(((r.doc_id, r.text) for r in cp.decontamination(spark, docs, str(tmp_path)).collect()), key=str)
    assert left == sorted([r for r in rows if r != (7, dirty)], key=str)


def test_columns_of_any_name_pass(spark, corpus, tmp_path):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = ["lang_pred", "score", "kept", "kept_text", "spans", "n_bytes", "_text_hash", "possible", "t1", "key", "body", "row", "component_id", "_extra0", "a.b"]
    more = docs
    for c in extra:
        more = more.withColumn(c, F.lit("clash"))
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/plain{k}")
        stage(spark, more, d).write.parquet(f"{tmp_path}/more{k}")
        docs, more = spark.read.parquet(f"{tmp_path}/plain{k}"), spark.read.parquet(f"{tmp_path}/more{k}")
        assert more.columns == docs.columns + extra, name
        assert sorted(map(str, more.select(docs.columns).collect())) == sorted(map(str, docs.collect())), name
        assert more.select([F.col(f"`{c}`") for c in extra]).distinct().count() == 1
    assert cp.STAGES[-1][1](spark, more, d).count() == docs.count()


def test_encoding_and_decoding_share_a_worker(spark):
    import public_tokenizers
    from sitemosaic.llm import bpe
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["", None, "two words", "Größe 12\u00a0x" * 40, "z" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = bpe.encode(docs, ranks, parts=3, limit=50, decoded=True)
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in both.collect()} == {r.doc_id: r.ids for r in bpe.encode(docs, ranks, parts=3).collect()}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # words, ids, positions, and one for putting together and decoding


def test_repeated_passages_feeds_no_worker_from_another(spark, monkeypatch):
    from sitemosaic.llm import suffix_dedup
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    p = fresh(60)
    rows = [(i, f"{fresh(20)} {p} {fresh(20)}") for i in range(4)] + [(9, fresh(90))]
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)
    checkpoint = suffix_dedup.checkpoint
    monkeypatch.setattr(suffix_dedup, "checkpoint", noted)
    out = cp.repeated_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert not any(p in r.text for r in out.collect())
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    maps = 0
    for plan in plans:
        above = []  # (depth, name) of the nodes over this one
        for line in plan.splitlines():
            m = re.match(r"[\s:+\-*()\d]*", line)
            depth, name = m.end(), line[m.end():].split(" ")[0].split("(")[0]
            above = [a for a in above if a[0] < depth]
            if name == "MapInArrow":
                maps += 1
                last = max((k for k, (_, n) in enumerate(above) if n.endswith("Exchange")), default=-1)
                assert "MapInArrow" not in [n for _, n in above[last + 1:]], plan
            above.append((depth, name))
    assert maps >= 7
