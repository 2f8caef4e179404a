"""Global distinct-word shuffle, used by byte-level BPE and by token counts.

1. A chunk of documents is exploded into pre-tokens with positions: distinct words, and one word number per position.
2. The words of all chunks are dealt out by word hash. Every word lands in one task whatever chunk it is from, and is encoded once
   there. A word is one entry per chunk however often the chunk repeats it, so a very common word makes no hot task.
3. The ids go back to their chunk, where the position sequence, which never was in the word shuffle, puts them in order.

The chunks are made twice (once for the words, once for the positions), which costs less than storing them. A chunk is named by
a digest of its keys and words; if a non-deterministic input deals its rows differently the second time, the names do not meet
and the job fails instead of mixing results up. Inputs should be tables, or checkpointed.
"""
from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack_bytes, pack_ints, shuffle_parts, slices, tidy, unpack_bytes, unpack_ints
from .pretokens import CHUNK, Chunk, chunk_of, grouped, rows_of

WORDS_HELD = 1_000_000  # encoded words that a task remembers; beyond it starts anew (same results)
ROW = "chunk binary, part int, blob binary"


def chunk_name(c: Chunk, extra) -> bytes:
    h = hashlib.blake2b(pickle.dumps((c.keys, c.sizes.tolist(), extra)), digest_size=16)
    h.update(c.hashes.tobytes())
    h.update(c.codes.tobytes())
    return h.digest()


def chunks(batches, spaced: bool, normal: Callable | None, limit: int = CHUNK):
    """Chunks with their names; normal: text -> (text, number), applied first."""
    for rows in grouped(rows_of(batches), limit=limit):
        texts, extra = [t for _, t in rows], []
        if normal:
            texts, extra = map(list, zip(*map(normal, texts)))
        c = chunk_of([k for k, _ in rows], texts, spaced)
        yield chunk_name(c, extra), c, extra


def _batch(names, parts, blobs):
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])


def by_distinct_word(docs: DataFrame, key: str, text: str, *, spaced: bool, encoder: Callable, finish: Callable, schema: str,
                     normal: Callable | None = None, condense: Callable | None = None, parts: int | None = None, limit: int = CHUNK, then: Callable | None = None) -> DataFrame:
    """encoder() -> function(word bytes) -> ids (uint32 array), or the word's number of ids (int).
    condense(chunk) -> what finish needs of the positions; finish(keys, extra, condensed, counts, first, flat) -> Arrow batch:
    word w has counts[w] ids, which stand in flat from first[w] on.
    limit: code points of a chunk. then: maps these batches in the same Python worker."""
    spark = docs.sparkSession
    n = parts or shuffle_parts(spark)
    two = docs.select(F.col(key), F.col(text))

    @tidy
    def to_words(batches):
        for name, c, _ in chunks(batches, spaced, normal, limit):
            part = (c.hashes % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n + 1))
            rows = [(p, pack_bytes([c.words[i] for i in order[cuts[p]:cuts[p + 1]].tolist()])) for p in range(n) if cuts[p] < cuts[p + 1]]
            yield _batch([name] * len(rows), [p for p, _ in rows], [b for _, b in rows])

    @tidy
    def to_ids(batches):
        encode, known = encoder(), {}
        for b in slices(batches, 64):
            blobs = []
            for blob in b.column(2).to_pylist():
                got = []
                for w in unpack_bytes(blob):
                    v = known.get(w)
                    if v is None:
                        if len(known) >= WORDS_HELD:
                            known.clear()
                        v = known[w] = encode(w)
                    got.append(v)
                if isinstance(got[0], int):
                    blobs.append(b"n" + pack_ints(np.array(got, np.uint32)))
                else:
                    sizes = pack_ints(np.fromiter(map(len, got), np.uint32, len(got)))
                    blobs.append(b"i" + struct.pack("<I", len(sizes)) + sizes + pack_ints(np.concatenate(got)))
            yield _batch(b.column(0), b.column(1), blobs)

    @tidy
    def to_positions(batches):
        for name, c, extra in chunks(batches, spaced, normal, limit):
            part = (c.hashes % np.uint64(n)).astype(np.uint32)
            body = pickle.dumps((c.keys, extra, pack_ints(part), condense(c)))
            yield _batch([name], [-1], [body])

    @tidy
    def together(batches):
        name, positions, ids = None, [], {}

        def emit():
            for body in positions:
                keys, extra, part, condensed = pickle.loads(body)
                part = unpack_ints(part)
                if set(np.unique(part).tolist()) - ids.keys():
                    raise RuntimeError("a chunk differs between its two readings: the input is not deterministic; checkpoint it first")
                counts = np.zeros(len(part), np.int64)
                flat, first = [], np.zeros(len(part), np.int64)
                at = 0
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(n + 1))
                for p in sorted(ids):
                    blob, where = ids[p], order[cuts[p]:cuts[p + 1]]
                    if blob[:1] == b"n":
                        counts[where] = unpack_ints(blob[1:])
                        continue
                    k, = struct.unpack_from("<I", blob, 1)
                    sizes = unpack_ints(blob[5:5 + k]).astype(np.int64)
                    counts[where] = sizes
                    first[where] = at + np.cumsum(sizes) - sizes
                    flat.append(unpack_ints(blob[5 + k:]))
                    at += len(flat[-1])
                yield finish(keys, extra, condensed, counts, first, np.concatenate(flat) if flat else np.empty(0, np.uint32))

        for b in slices(batches, 64):
            for c, p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if c != name:
                    yield from emit()
                    name, positions, ids = c, [], {}
                if p < 0:
                    positions.append(blob)
                else:
                    ids[p] = blob
        yield from emit()

    words = two.mapInArrow(to_words, ROW).repartition(n, "part").mapInArrow(to_ids, ROW)
    positions = two.mapInArrow(to_positions, ROW)
    return words.unionByName(positions).repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(together if then is None else lambda batches: then(together(batches)), schema)
