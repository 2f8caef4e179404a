"""Byte-level BPE encoding and decoding.

encode: distinct-word shuffle (word_shuffle.py). decode: every id is looked up in the token-byte table, whose size the vocabulary
bounds (it is broadcast: a table of under a few MB), and the bytes are put together by position.

Null text counts as empty (no ids, no bytes). Rows are kept one for one, whatever their key: null keys and repeated rows too. Other
columns are not read, so their names never clash. An id outside the table fails.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack_ints, ranges, slices, tidy, unpack_ints
from .pretokens import CHUNK, assemble
from .word_shuffle import by_distinct_word


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _binaries(flat: bytes, ends: np.ndarray) -> pa.Array:
    """One binary value up to each end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", parts: int | None = None, limit: int = CHUNK, decoded: bool = False) -> DataFrame:
    """key, ids: token ids as little-endian unsigned 32-bit integers (binary). The text is cut by the public byte-level pattern
    (contractions; letters, digits or other characters with a blank before; white space) and each piece is merged by rank.
    limit: code points of a chunk. decoded: adds the bytes that the ids decode to, in the worker that puts the ids together."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[key].dataType.simpleString()

    def encoder():
        import tiktoken
        piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})._core_bpe.encode_single_piece
        return lambda word: np.array(piece(word), np.uint32)

    def finish(keys, extra, condensed, counts, first, flat):
        codes, sizes = unpack_ints(condensed[0]), condensed[1]
        ids, ends = assemble(codes, sizes, counts, first, flat)
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), _binaries(ids.astype("<u4").tobytes(), 4 * ends)], ["key", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type
    key_type = to_arrow_type(docs.schema[key].dataType)
    out = by_distinct_word(docs, key, text, spaced=True, encoder=encoder, finish=finish, condense=lambda c: (pack_ints(c.codes), c.sizes),
                           schema=f"key {kind}, ids binary" + ", decoded binary" * decoded, parts=parts, limit=limit,
                           then=_decoder(docs.sparkSession, ranks, 1) if decoded else None)
    return out.withColumnRenamed("key", key)


def ids_array(ids: str) -> "F.Column":
    """The binary ids as array<int>."""
    flip = lambda i: F.concat(*[F.substring(F.col(ids), 4 * i + k, F.lit(1)) for k in (4, 3, 2, 1)])
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(flip(i)), 16, 10).cast("int")))


def _decoder(spark, ranks: dict[bytes, int], at: int):
    """The task that adds the bytes of the ids in the column at this place."""
    size = max(ranks.values(), default=-1) + 1
    pieces = [b""] * size
    for token, i in ranks.items():
        pieces[i] = token
    lengths = np.fromiter(map(len, pieces), np.int64, size)
    table = spark.sparkContext.broadcast((b"".join(pieces), np.cumsum(lengths) - lengths, lengths))

    @tidy
    def run(batches):
        body, first, length = table.value
        body = np.frombuffer(body, np.uint8)
        for part in slices(batches, 256):
            values = [v or b"" for v in part.column(at).to_pylist()]
            all_ids = np.frombuffer(b"".join(values), "<u4")
            per = length[all_ids]
            ends = np.concatenate([[0], np.cumsum(per)])[np.cumsum([len(v) // 4 for v in values])]
            yield pa.RecordBatch.from_arrays([*part.columns, _binaries(body[ranges(first[all_ids], per)].tobytes(), ends)], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """All columns and decoded (binary): the tokens' bytes by position."""
    run = _decoder(encoded.sparkSession, ranks, encoded.columns.index(ids))
    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")
