"""A corpus pipeline of the library's operators; each stage is written as Parquet and read again as the next one's documents.

Every stage works on all documents that its predecessor kept, and its decisions take effect. Rows without doc_id stay where a decision is
made by doc_id: they cannot be told apart, so nothing is decided about them. A doc_id may repeat: decisions are made by (doc_id, text hash),
so rows of one doc_id with different texts are judged each by its own text, and of rows with the same doc_id and text one stays. Null texts
count as empty; an empty table stays empty. Columns of other names pass through all stages but the last, whatever they are called.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitemosaic.llm import bpe, decontaminate, langid, simhash, suffix_dedup
from sitemosaic.llm.common import checkpoint, new_folder, small_batches, table

LEAST_SCORE = 0.4  # a text whose best language scores less is rejected; low, as short and mixed texts of known languages are to stay
PASSAGE_WORDS = 51  # the least words of a passage that may not stand in the texts twice
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


CHUNK = 500_000  # code points whose words a worker tells apart at once in byte_bpe
HASH = "_text_hash"
BATCH = 4 << 20  # bytes of an Arrow batch: a batch of texts stands in the executor and in its worker, in every stage
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """The stage, with all other columns of the documents under names that nothing else uses while it runs: they cannot clash with what it adds."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark, BATCH)
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        name = {c: c if c in OWN else f"_extra{i}" for i, c in enumerate(docs.columns)}
        back = {v: c for c, v in name.items()}
        out = stage(spark, docs.select(*[quoted(c).alias(v) for c, v in name.items()]), sf_dir)
        return out.select(*[quoted(c).alias(back.get(c, c)) for c in out.columns])
    run.__doc__, run.__name__ = stage.__doc__, stage.__name__
    return run


def with_hash(docs: DataFrame) -> DataFrame:
    """Adds what tells rows of one doc_id apart."""
    return docs.withColumn(HASH, F.xxhash64(F.coalesce("text", F.lit(""))))


@apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no language that the documents' labels teach; all stay if there is no label."""
    model = langid.fit(docs)
    if not model.languages:
        return docs
    columns = docs.columns
    out = langid.predict(docs, model, passed=tuple(c for c in columns if c != "doc_id"))
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least doc_id, of several texts with this doc_id the one with the least hash."""
    named = with_hash(docs.filter(F.col("doc_id").isNotNull()))
    rows = named.select(F.struct("doc_id", HASH).alias("row"), "text")
    first = simhash.near_duplicates(rows, "row").filter("row = component_id").select("row.*").distinct()
    kept = named.join(first, ["doc_id", HASH], "left_semi").dropDuplicates(["doc_id", HASH]).select(docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


@apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every occurrence of a string that occurs again and has over 50 words, or 400 bytes (for scripts without blanks), is cut from the
    texts; n_chars follows the text."""
    spans = suffix_dedup.repeated_spans(docs).unionByName(suffix_dedup.repeated_word_spans(docs, words=PASSAGE_WORDS))
    spans = suffix_dedup.merged(spans.select("t1", "t2", F.inline("spans")))
    out = suffix_dedup.remove(docs, spans, passed=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    out = out.withColumn("text", F.coalesce("kept_text", F.lit("")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark item covers a twentieth of the words or more go."""
    named = with_hash(docs)
    rows = named.select(F.struct("doc_id", HASH).alias("row"), "text")
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), "row").filter(decontaminate.contaminated())
    found = checkpoint(found.select("row.*").distinct())
    return named.join(decontaminate.small(found), ["doc_id", HASH], "left_anti").select(docs.columns)


@apart
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit integers), and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    out = bpe.encode(docs, ranks, limit=CHUNK, decoded=True)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # SQL has no counterpart of the trained model, the fingerprints or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
