"""Registered queries of the corpus operators on the given tables; SQL where it can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_byte_bpe")
def op1(spark, d):
    from . import bpe
    ranks = bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    out = bpe.decode(bpe.encode(table(spark, d, "documents"), ranks), ranks)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_language_id")
def op2(spark, d):
    from . import langid
    docs = table(spark, d, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op3_simhash")
def op3(spark, d):
    from . import simhash
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op4_token_counts")
def op4(spark, d):
    from . import token_counts as t
    return t.over_limit(t.count_tokens(table(spark, d, "documents"), t.read_model(vocabulary("word_bpe_49k.json"))), 2048)


@query("op5_tiff_pages")
def op5(spark, d):
    from . import tiff
    pages = tiff.pages(tiff.payloads(table(spark, d, "documents")))
    return pages.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
                        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URL_TERMS = ("adult", "bets", "casino", "spam")
OP6_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE host <> '' AND regexp_matches(host, '(^|[.-])(adult|bets|casino|spam)([.-]|$)')),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, host <> '' AND l.canon IS NOT NULL AS listed,
    CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host <> '' AND l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon"""


@query("op6_url_filter", OP6_SQL)
def op6(spark, d):
    from . import url_filter as t
    pages = table(spark, d, "pages")
    return t.judge(pages, t.listed_by_terms(pages, URL_TERMS), URL_RULES)


@query("op7_suffix_dedup")
def op7(spark, d):
    from . import suffix_dedup as t
    docs = table(spark, d, "documents")
    out = t.remove(docs, t.repeated_spans(docs))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_html_text")
def op8(spark, d):
    from . import html_text
    return html_text.extract(table(spark, d, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, n, p, g FROM dw WHERE (n, g) IN (SELECT (n, g) FROM iw)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m JOIN iw USING (n, g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op9_decontamination", OP9_SQL)
def op9(spark, d):
    from . import decontaminate as t
    out = t.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), t.contaminated().alias("contaminated"))


@query("op10_huffman_ids")
def op10(spark, d):
    from . import huffman, token_counts
    path = huffman.write_ids(table(spark, d, "documents"), token_counts.read_model(vocabulary("word_bpe_49k.json")), end_id=1)
    return huffman.read_ids(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op11_class_lm")
def op11(spark, d):
    from . import class_lm
    return class_lm.fit_score(table(spark, d, "documents"))[0]


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f"""


@query("op12_fill_middle", OP12_SQL)
def op12(spark, d):
    from . import fill_middle as t
    out = t.transform(table(spark, d, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(t.restored(), 256).alias("restored_sha256"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score, s.b AS c, s.score AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, c AS negative_id, score AS positive_score, t AS negative_score FROM n WHERE r <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, d):
    from . import hard_negatives as t
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return t.mine(table(spark, d, "embeddings").withColumn("label", moved), anchors="id % 100 = 0")
