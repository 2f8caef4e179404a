"""Token counts without ids: every distinct pre-token is counted once and joined to the documents' pre-token frequencies.

Null text counts as empty (0 tokens, 0 bytes). Rows are kept one for one, null keys and repeats too. Only the key and the text are
read. Strings of special tokens inside a text count as one token each, as the tokenizer's default has it.
"""
from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack_ints, unpack_ints
from .word_shuffle import by_distinct_word


@lru_cache(1)
def unknown_here() -> np.ndarray:
    """Characters that Python's Unicode tables do not have; the library's, which may be newer, decide about texts with them."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def library_normalizer():
    from tokenizers import Regex, normalizers
    return normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])


def byte_alphabet() -> dict[int, str]:
    """Printable characters that stand for the 256 bytes: a byte's own character if it is printable Latin-1, else the next after 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordModel:
    """The parts of a lower-casing word BPE file (tokenizers JSON) that act before and at single words."""

    def __init__(self, source: str):
        spec = json.loads(source)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != "</w>" or spec["post_processor"]:
            raise ValueError("only word BPE files with NFC, white space and lower-case normalization are known here")
        self.source = source
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.small = max([*spec["model"]["vocab"].values(), *self.special.values()]) < 1 << 16
        self.pattern = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))

    def normal(self):
        """text -> (normalized text with a blank for each special string, the special ids in order)."""
        find, special = re.compile(self.pattern) if self.special else None, self.special

        def run(text: str):
            ids = ()
            if find and "<" in text:
                ids = tuple((m.start(), special[m.group()]) for m in find.finditer(text))
                if ids:
                    text = find.sub(" ", text)
            if not text.isascii():
                if unknown_here()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                    return library_normalizer().normalize_str(text), ids
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered by itself
            return text.lower(), ids
        return run

    def cuts(self, text: str) -> list[str]:
        """The pieces of a text around its special strings."""
        return re.split(self.pattern, text)

    def encoder(self):
        """word (UTF-8) -> ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        model, alphabet = Tokenizer.from_str(self.source).model, byte_alphabet()
        return lambda word: [t.id for t in model.tokenize(word.decode("latin-1").translate(alphabet))]


def read_model(path: str) -> WordModel:
    with open(path, encoding="utf-8") as f:
        return WordModel(f.read())


def count_tokens(docs: DataFrame, model: WordModel, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_type
    shared = docs.sparkSession.sparkContext.broadcast(model.source)
    normalize = model.normal()
    key_type = to_arrow_type(docs.schema[key].dataType)

    def encoder():
        ids = WordModel(shared.value).encoder()
        return lambda word: len(ids(word))

    def normal(t: str):
        out, special = normalize(t)
        return out, (len(special), len(t.encode()))

    def condense(c):
        """Documents' distinct words and how often each has it."""
        doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
        pair, n = np.unique(doc * len(c.words) + c.codes, return_counts=True)
        width = max(1, len(c.words))
        return pack_ints(np.bincount(pair // width, minlength=len(c.sizes))), pack_ints(pair % width), pack_ints(n)

    def finish(keys, extra, condensed, counts, first, flat):
        per_doc, word, n = map(unpack_ints, condensed)
        doc = np.repeat(np.arange(len(keys)), per_doc)
        tokens = np.bincount(doc, counts[word] * n.astype(np.int64), len(keys)).astype(np.int64) + [e[0] for e in extra]
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([e[1] for e in extra], pa.int64()), pa.array(tokens, pa.int64())], ["key", "n_bytes", "n_tokens"])

    out = by_distinct_word(docs, key, text, spaced=False, encoder=encoder, finish=finish, condense=condense, normal=normal,
                           schema=f"key {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint", parts=parts)
    return out.withColumnRenamed("key", key)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
