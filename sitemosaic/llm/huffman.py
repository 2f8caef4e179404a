"""Token ids in files: canonical length-limited Huffman codes from global counts, independent blocks with bit-offset checkpoints.

File format (a folder that Spark writes and reads, so any store will do):
  code/    symbol int, length int - the canonical code follows from the lengths
  blocks/  part int, block int   - ascending key order: by part, then block
           before bigint         - ids of the part before this block
           keys binary           - Arrow stream of the block's document keys, ascending, null first
           sizes binary          - ids of each document (packed)
           points binary         - bit offset of every STEP-th id (packed)
           bits binary           - the codes, most significant bit first
A block holds whole documents, about BLOCK ids or one longer document, and decodes without any other.

Null text counts as empty: only the end id. Rows are kept one for one; equal keys stand in the order of their ids. Only key and text
are read. No documents: an empty code and no blocks.
"""
from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_folder, pack_ints, shuffle_parts, slices, stored, tidy, unpack_ints
from .pretokens import END, assemble, borders, distinct, grouped, rows_of
from .token_counts import WordModel

BLOCK = 1 << 18
STEP = 128
LIMIT = 20  # longest code: the decoding table has 2^LIMIT entries
HELD = 700_000  # encoded words that a worker remembers; then it starts anew

_known: dict = {}


# -- ids ---------------------------------------------------------------------------
class Numbering(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Encoder:
    """Ids of texts: cut at ASCII white space, which no match of the pattern holds; a cut's ids are found once and remembered by its bytes."""

    def __init__(self, model: WordModel):
        self.encode, self.type = model.encoder(), np.uint16 if model.small else np.uint32
        self.forget()

    def forget(self) -> None:
        self.number, self.words = Numbering(), {}
        self.counts, self.flat = np.empty(0, np.int64), np.empty(0, self.type)

    def learn(self) -> None:
        """Ids of the cuts that are new: their pre-tokens, each distinct one encoded once."""
        new = list(islice(self.number, len(self.counts), None))
        if not new:
            return
        cp = np.frombuffer((b"\n".join(new) + b"\n").decode().encode("utf-32-le"), np.uint32).copy()
        cp[cp == 10] = END  # each cut is a document of its own
        starts, ends, cut = borders(cp, False)
        words, _, codes = distinct(cp, starts, ends)
        known, encode, got = self.words, self.encode, []
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = np.array(encode(w), self.type).tobytes()
            got.append(v)
        counts = np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(self.type).itemsize
        ids, ends = assemble(codes, np.bincount(cut, minlength=len(new)), counts, np.cumsum(counts) - counts, np.frombuffer(b"".join(got), self.type))
        self.counts, self.flat = np.concatenate([self.counts, np.diff(ends, prepend=0)]), np.concatenate([self.flat, ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text ends in them."""
        if len(self.number) > HELD:
            self.forget()
        find, codes, sizes = self.number.__getitem__, [], []
        for t in texts:
            cuts = t.encode().split()
            codes.append(np.fromiter(map(find, cuts), np.uint32, len(cuts)))
            sizes.append(len(cuts))
        self.learn()
        return assemble(np.concatenate(codes) if codes else np.empty(0, np.uint32), np.array(sizes, np.int64), self.counts, np.cumsum(self.counts) - self.counts, self.flat)


def token_ids(docs: DataFrame, model: WordModel, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (packed): the tokenizer's ids of each text and end_id. Strings of special tokens give their id, as the tokenizer's default has it.
    A task's last rows carry its counts instead: symbols and numbers (packed)."""
    from pyspark.sql.pandas.types import to_arrow_type
    shared = docs.sparkSession.sparkContext.broadcast(model.source)
    key_type = to_arrow_type(docs.schema[key].dataType)

    @tidy
    def run(batches):
        own = WordModel(shared.value)
        normal = own.normal()
        if hash(own.source) not in _known:  # lives as long as the Python worker
            _known[hash(own.source)] = Encoder(own)
        encode = _known[hash(own.source)]
        total = np.zeros(1, np.int64)
        for rows in grouped(rows_of(batches)):
            pieces, suffix, last = [], [], []
            for _, t in rows:  # a text is cut at special strings; each piece is followed by that id or the end id
                lowered, special = normal(t)
                if special:
                    cuts = own.cuts(t)
                    pieces += [normal(x)[0] for x in cuts]
                    suffix += [i for _, i in special] + [end_id]
                else:
                    pieces.append(lowered)
                    suffix.append(end_id)
                last.append(len(pieces) - 1)
            ids, ends = encode(pieces)
            ids = np.insert(ids.astype(np.uint32), ends, np.array(suffix, np.uint32))
            ends = (ends + np.arange(1, len(ends) + 1))[last]
            starts = np.concatenate([[0], ends[:-1]])
            n = np.bincount(ids)
            if len(n) > len(total):
                total, n = n.astype(np.int64), total
            total[:len(n)] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], key_type), pa.array([pack_ints(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()), pa.nulls(len(rows), pa.binary())], ["key", "ids", "counts"])
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.binary()), pa.array([np.stack([at, total[at]]).astype(np.int64).tobytes()], pa.binary())], ["key", "ids", "counts"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary, counts binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """symbol, n over all documents, from what the tasks have counted."""
    def run(batches):
        for b in batches:
            for v in b.column(0).to_pylist():
                at, n = np.frombuffer(v, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], ["symbol", "n"])
    return ids.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


# -- the code ----------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package merge)."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    is_leaf, packages = [], np.empty(0)
    for _ in range(limit):
        level = np.concatenate([leaves, packages])
        by = np.argsort(level, kind="stable")
        is_leaf.append(by < n)
        level = level[by]
        packages = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical code: by length, then symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[by].astype(np.int64), lengths[by].astype(np.int64)
        self.longest = int(self.lengths.max()) if len(by) else 1
        step = np.int64(1) << (self.longest - self.lengths)
        self.values = (np.cumsum(step) - step) >> (self.longest - self.lengths)

    def encoder(self):
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        value, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        value[self.symbols], length[self.symbols] = self.values, self.lengths

        def encode(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
            """The bits, and the bit offset of every STEP-th id."""
            if not len(ids):
                return b"", np.empty(0, np.int64)
            n = length[ids]
            end = np.cumsum(n)
            at = end - n
            word, left = at >> 6, at & 63
            v = value[ids] << (64 - n).astype(np.uint64)
            out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.bitwise_or.reduceat(v >> left.astype(np.uint64), first)
            over = np.flatnonzero(left + n > 64)
            out[word[over] + 1] |= v[over] << (64 - left[over]).astype(np.uint64)
            return out.byteswap().tobytes()[:int(end[-1] + 7) // 8], at[::STEP]
        return encode

    def decoder(self):
        size = 1 << self.longest
        fill = size >> self.lengths
        symbol = np.zeros(size, np.uint32)
        length = np.ones(size, np.int64)
        used = int(fill.sum())
        symbol[:used], length[:used] = np.repeat(self.symbols, fill), np.repeat(self.lengths, fill)
        shift = np.uint32(32 - self.longest)

        def decode(bits: bytes, points: np.ndarray, n: int) -> np.ndarray:
            """n ids; all checkpoints advance together, an id at a time."""
            if not n:
                return np.empty(0, np.uint32)
            b = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
            window = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
            at, most = points.astype(np.int64), 8 * len(bits)
            out = np.empty((len(at), STEP), np.uint32)
            for k in range(STEP):
                w = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
                out[:, k] = symbol[w]
                at = np.minimum(at + length[w], most)
            return out.reshape(-1)[:n]
        return decode


# -- files -------------------------------------------------------------------------
def _keys_out(keys: pa.Array) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([keys], ["key"]))
    return sink.getvalue()


def write_ids(docs: DataFrame, model: WordModel, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Writes the files in ascending key order and returns their folder."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "ids")
    ids = stored(token_ids(docs, model, end_id, key, text), "ids")
    counts = id_counts(ids).toPandas()  # one row per symbol: the vocabulary bounds it
    symbols = counts["symbol"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64)) if len(counts) else np.empty(0, np.int64)
    spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((symbols, lengths))

    def rows(batches) -> Iterator[tuple]:
        for b in slices(batches):
            for k, v in zip(b.column(0), b.column(1).to_pylist()):
                yield k, unpack_ints(v)

    @tidy
    def run(batches):
        encode = Code(*code.value).encoder()
        part, before = TaskContext.get().partitionId(), 0
        for k, group in enumerate(grouped(rows(batches), limit=BLOCK)):
            every = np.concatenate([v for _, v in group])
            bits, points = encode(every)
            keys = pa.array([x.as_py() for x, _ in group], group[0][0].type)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                _keys_out(keys), pack_ints(np.fromiter((len(v) for _, v in group), np.uint32, len(group))), pack_ints(points), bits))], ["part", "block", "before", "keys", "sizes", "points", "bits"])
            before += len(every)

    (ids.filter("ids IS NOT NULL").select("key", "ids").repartitionByRange(shuffle_parts(spark), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
        .mapInArrow(run, "part int, block int, before bigint, keys binary, sizes binary, points binary, bits binary").write.option("compression", "none").parquet(f"{path}/blocks"))
    return path


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """key, start (ids of all documents before), ids (little-endian unsigned 32-bit integers), decoded from the files."""
    from .bpe import _binaries
    table = spark.read.schema("symbol int, length int").parquet(f"{path}/code").toPandas()
    code = spark.sparkContext.broadcast((table["symbol"].to_numpy(np.int64), table["length"].to_numpy(np.int64)))
    blocks = spark.read.schema("part int, block int, before bigint, keys binary, sizes binary, points binary, bits binary").parquet(f"{path}/blocks")

    @tidy
    def run(batches):
        decode = Code(*code.value).decoder()
        for b in slices(batches, 16):
            for part, before, keys, sizes, points, bits in zip(*(b.column(k).to_pylist() for k in range(6))):
                keys = pa.ipc.open_stream(keys).read_all().column(0).combine_chunks()
                sizes = unpack_ints(sizes).astype(np.int64)
                ends = np.cumsum(sizes)
                ids = decode(bits, unpack_ints(points), int(ends[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), keys, pa.array(before + ends - sizes), pa.array(sizes), _binaries(ids.astype("<u4").tobytes(), 4 * ends)], ["part", "key", "inside", "n", "ids"])

    def totals(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + int(unpack_ints(s).sum()) for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.int64())], ["part", "n"])

    docs = blocks.select("part", "before", "keys", "sizes", "points", "bits").mapInArrow(run, f"part int, key {key_type}, inside bigint, n bigint, ids binary")
    # one row of two numbers per written part: at most as many as there were shuffle partitions
    parts = blocks.select("part", "before", "sizes").mapInArrow(totals, "part int, n bigint").groupBy("part").agg(F.max("n").alias("ids"))
    parts = parts.select(F.col("part").alias("of"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    return docs.join(F.broadcast(parts), docs.part == parts.of).select(F.col("key").alias(key), (F.col("offset") + F.col("inside")).alias("start"), "ids")
