"""Brown class-based bigram model by exchange clustering, trained on all training documents and applied to all documents.

    P(word | previous word) = P(class(word) | class(previous word)) * P(word | class(word))

Tokens: A-Z lower-cased; words are runs of anything but blank and bytes 9 to 13; one end token follows each text, also the context of its first word.

1. Blocks of documents become word numbers and a dictionary (`coded`). Dictionaries are dealt out by word hash; a task adds up a word's count over all
   blocks and sends it back to the blocks (`counted`). No word or count passes through the driver but the head's.
2. Head: words with at least one of HEAD training tokens, so HEAD words at most whatever the corpus. Their bigram counts, all other words being
   one pseudo-word, are kept per word (`neighbours`). Exchange: a word goes to the class that raises the likelihood of the class bigrams most, by the exact change of the
   sum of n log n over cells and margins. Groups of words do so side by side, in a group one word after the other; half of the groups' moves count in a round, and a
   round that lowers the likelihood of all is taken back and halved.
3. Each other word is exchanged once, against the head's classes: its neighbours over the whole corpus meet in one task (`tail_classes`).
4. Class bigrams are counted over all training tokens (`ready`), smoothed by Witten-Bell towards the class frequencies. A word's count in its class is discounted
   absolutely by n1/(n1+2*n2); what is freed is the class's share for words without count, dealt out evenly among the number of unseen words that the counts
   of counts suggest, n1*(n1-1)/(2*(n2+1)), at least one. Contexts of unseen words are estimated from those of words seen once.
   The probabilities of all known words, the end and that many unseen words add up to 1.

The base model's probability of a token is (c+1)/(N+V+1).

Null text counts as empty: only its end. Rows are kept one for one; repeated keys and texts count as often as they occur. A null key is in training unless the
condition says otherwise. Only key, text and the condition's columns are read, so other columns cannot clash. An empty table gives an empty result; without training tokens
every token has probability 1, that of the only symbol. A very long text is read in pieces and may be a block of its own.
"""
from __future__ import annotations

import pickle
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .common import pack_bytes, pack_ints, shuffle_parts, slices, stored, text_bytes, tidy, unpack_bytes, unpack_ints

CLASSES, HEAD, ROUNDS = 64, 8192, 12
WORDS, TEXT = 250_000, 16 << 20   # a block's distinct words and bytes of text
PIECE = 4 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b" "                         # no word holds a blank; class 0, alone
ROW = "block bigint, part int, kind string, blob binary, a bigint, b bigint, c bigint"
ROW_TYPE = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("blob", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW_TYPE)], schema=ROW_TYPE)


def pack_wide(a: np.ndarray) -> bytes:
    """Unsigned integers of up to 64 bits."""
    a = np.asarray(a, np.uint64)
    low = pack_ints((a & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return struct.pack("<I", len(low)) + low + pack_ints((a >> np.uint64(32)).astype(np.uint32))


def unpack_wide(b: bytes) -> np.ndarray:
    k, = struct.unpack_from("<I", b)
    return unpack_ints(b[4:4 + k]).astype(np.int64) | unpack_ints(b[4 + k:]).astype(np.int64) << 32


def held_out(key: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus == remainder


# -- 1: blocks, counts --------------------------------------------------------------
class Numbering(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def words_of(text: bytes):
    """The words of a text, piece by piece; a word is never cut."""
    at = 0
    while len(text) - at > PIECE:
        m = re.compile(rb"[\x20\x09-\x0D]").search(text, at + PIECE)
        if not m:
            break
        yield text[at:m.start()].translate(LOWER).split()
        at = m.start()
    yield (text[at:] if at else text).translate(LOWER).split()


def coded(docs: DataFrame, held: Column, key: str, text: str, parts: int) -> DataFrame:
    """Stored rows: a `body` of each block (a: its training tokens), and its dictionary by part (`words`)."""

    @tidy
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        state = {}

        def fresh():
            known = Numbering()
            known[END] = 0
            state.update(known=known, keys=[], held=[], sizes=[], codes=[], size=0)

        def flush():
            nonlocal seq
            codes, sizes = np.concatenate(state["codes"]), np.array(state["sizes"], np.int64)
            out = np.array(state["held"], bool)
            n = np.bincount(codes[~np.repeat(out, sizes)], minlength=len(state["known"]))
            words = list(state["known"])
            part = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            block = task << 32 | seq
            seq += 1
            body = pickle.dumps((state["keys"], state["held"], pack_wide(sizes), pack_ints(part), pack_ints(codes)))
            rows = [(block, -1, "body", body, int(n.sum()), None, None)]
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[p]:cuts[p + 1]]
                blob = pickle.dumps((pack_bytes([words[i] for i in mine.tolist()]), pack_wide(n[mine])))
                rows.append((block, p, "words", blob, None, None, None))
            fresh()
            return _rows(rows)

        fresh()
        for b in slices(batches):
            for k, t, h in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                if state["size"] and (state["size"] + len(t) > TEXT or len(state["known"]) > WORDS):
                    yield flush()
                number, size = state["known"].__getitem__, 1
                for words in words_of(t):
                    state["codes"].append(np.fromiter(map(number, words), np.uint32, len(words)))
                    size += len(words)
                state["codes"].append(np.zeros(1, np.uint32))
                state["keys"].append(k)
                state["held"].append(bool(h))
                state["sizes"].append(size)
                state["size"] += len(t) + 1
        if state["size"]:
            yield flush()

    three = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.coalesce(held, F.lit(False)).alias("out"))
    return stored(three.mapInArrow(run, ROW), "coded")


def by_part(batches):
    """(part, its rows), one part after the other."""
    at, rows = None, []
    for b in slices(batches, 64):
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[1] != at:
                if rows:
                    yield at, rows
                at, rows = r[1], []
            rows.append(r)
    if rows:
        yield at, rows


def counted(code: DataFrame, parts: int, tokens: int) -> DataFrame:
    """Stored rows: `reply` to each block and part (training count and number in the part of every word), `stats` (a, b, c: words with a training count, with count 1, with 2)
    and the `head` (a: number in the part, b: count, c: 1 for the end)."""

    @tidy
    def run(batches):
        for part, rows in by_part(batches):
            number, total = Numbering(), []
            for r in rows:
                words, n = pickle.loads(r[3])
                at = np.fromiter(map(number.__getitem__, unpack_bytes(words)), np.int64)
                total.append((at, unpack_wide(n)))
            count = np.zeros(len(number), np.int64)
            for at, n in total:
                count[at] += n  # a block has a word once
            for lo in range(0, len(rows), 16):
                yield _rows([(r[0], part, "reply", pickle.dumps((pack_wide(count[at]), pack_ints(at))), None, None, None) for r, (at, _) in zip(rows[lo:lo + 16], total[lo:lo + 16])])
            end = number.get(END, -1)
            head = np.flatnonzero((count * HEAD >= tokens) & (count > 0) if tokens else np.zeros(len(count), bool)).tolist()
            if end >= 0 and count[end] > 0 and end not in head:
                head.append(end)
            yield _rows([(-1, part, "stats", None, int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))]
                        + [(-1, part, "head", None, i, int(count[i]), int(i == end)) for i in head])

    words = code.filter("kind = 'words'").repartition(parts, "part").sortWithinPartitions("part")
    return stored(words.mapInArrow(run, ROW), "counted")


def by_block(batches):
    """(block, body, rows of its parts in ascending order)."""
    at, body, rows = None, None, []
    for b in slices(batches, 64):
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[0] != at:
                if body is not None:
                    yield at, body, rows
                at, body, rows = r[0], None, []
            if r[1] < 0:
                body = r
            else:
                rows.append(r)
    if body is not None:
        yield at, body, rows


def with_replies(bodies: DataFrame, replies: DataFrame, run) -> DataFrame:
    """The replies of all parts meet their block."""
    n = shuffle_parts(bodies.sparkSession)
    return bodies.unionByName(replies).repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(run, ROW)


def local(part: np.ndarray, parts_seen: list[int]) -> dict[int, np.ndarray]:
    """Where the words of each part stand in a block's dictionary."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.array(parts_seen + [1 << 31]))
    ends = np.searchsorted(part[order], np.array(parts_seen), side="right")
    return {p: order[a:b] for p, a, b in zip(parts_seen, cuts.tolist(), ends.tolist())}


# -- 2: head, exchange ---------------------------------------------------------------
@dataclass
class Head:
    """Dense numbers of the head words, 1 for the end, then by falling count; 0 stands for all other words. At most HEAD + 1 rows."""
    part: np.ndarray
    number: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Head:
        rows = sorted(((-r["c"], -r["b"], r["part"], r["a"]) for r in counts.filter("kind = 'head'").select("part", "a", "b", "c").collect()))
        t = np.array(rows, np.int64).reshape(-1, 4)
        return cls(t[:, 2], t[:, 3], -t[:, 1])

    def dense(self, part: int, numbers: np.ndarray) -> np.ndarray:
        mine = np.flatnonzero(self.part == part)
        out = np.zeros(len(numbers), np.uint32)
        if len(mine) and len(numbers):
            mine = mine[np.argsort(self.number[mine])]
            at = np.minimum(np.searchsorted(self.number[mine], numbers), len(mine) - 1)
            out = np.where(self.number[mine][at] == numbers, mine[at] + 1, 0).astype(np.uint32)
        return out


def headed(code: DataFrame, counts: DataFrame, head: Head) -> DataFrame:
    """Stored bodies whose dictionaries carry each word's part, training count, number in the part and dense head number."""
    shared = code.sparkSession.sparkContext.broadcast(head)

    @tidy
    def run(batches):
        for block, body, rows in by_block(batches):
            keys, held, sizes, part, codes = pickle.loads(body[3])
            parts = unpack_ints(part).astype(np.int64)
            where = local(parts, [r[1] for r in rows])
            count, number, dense = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.uint32), np.zeros(len(parts), np.uint32)
            for r in rows:
                n, at = pickle.loads(r[3])
                count[where[r[1]]], number[where[r[1]]] = unpack_wide(n), unpack_ints(at)
                dense[where[r[1]]] = shared.value.dense(r[1], number[where[r[1]]])
            yield _rows([(block, -1, "body", pickle.dumps((keys, held, sizes, part, codes, pack_wide(count), pack_ints(number), pack_ints(dense))), body[4], None, None)])

    bodies = code.filter("kind = 'body'")
    return stored(with_replies(bodies, counts.filter("kind = 'reply'"), run), "headed")


def training(held: list, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes[~np.repeat(np.array(held, bool), sizes)]


def neighbours(bodies: DataFrame, groups: int) -> DataFrame:
    """Stored, a row per group of head words: their following and their preceding words with counts."""

    def sparse(at: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
        return pickle.dumps((pack_ints(at), pack_ints(other), pack_wide(n)))

    @tidy
    def pairs(batches):
        for b in slices(batches, 1):
            block, blob = b.column(0).to_pylist()[0], b.column(3).to_pylist()[0]
            _, held, sizes, _, codes, _, _, dense = pickle.loads(blob)
            word = unpack_ints(dense).astype(np.int64)[training(held, unpack_wide(sizes), unpack_ints(codes))]
            before = np.concatenate([[1], word[:-1]])
            both, n = np.unique(before << 20 | word, return_counts=True)
            first, second = both >> 20, both & ((1 << 20) - 1)
            for side, (at, other) in enumerate(((first, second), (second, first))):
                order = np.argsort(at % groups, kind="stable")
                cuts = np.searchsorted((at % groups)[order], np.arange(groups + 1))
                rows = [(block, g, "pairs", sparse(at[o], other[o], n[o]), None, side, None) for g in range(groups) if len(o := order[cuts[g]:cuts[g + 1]])]
                if rows:
                    yield _rows(rows)

    @tidy
    def merge(batches):
        for g, rows in by_part(batches):
            sides = []
            for side in (0, 1):
                key, n = np.empty(0, np.int64), np.empty(0, np.int64)
                mine = [r for r in rows if r[5] == side]
                for lo in range(0, len(mine), 8):  # a few blocks at a time
                    some = [tuple(f(x) for f, x in zip((unpack_ints, unpack_ints, unpack_wide), pickle.loads(r[3]))) for r in mine[lo:lo + 8]]
                    key = np.concatenate([key] + [a.astype(np.int64) << 20 | o for a, o, _ in some])
                    n = np.concatenate([n] + [c for _, _, c in some])
                    key, inverse = np.unique(key, return_inverse=True)
                    n = np.bincount(inverse, n, len(key)).astype(np.int64)
                sides.append((pack_ints(key >> 20), pack_ints(key & ((1 << 20) - 1)), pack_wide(n)))
            yield _rows([(0, g, "pairs", pickle.dumps(sides), None, None, None)])

    made = bodies.select("block", "part", "kind", "blob", "a", "b", "c").mapInArrow(pairs, ROW)
    return stored(made.repartition(groups, "part").sortWithinPartitions("part", "b").mapInArrow(merge, ROW), "neighbours")


def summed(df: DataFrame, run, size: int) -> np.ndarray:
    """run(batches) gives arrays; their sum."""
    def arrays(batches):
        total = run(batches)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])
    got = df.mapInArrow(arrays, "v array<double>").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select(vector_to_array("v").alias("v")).first()
    return np.array(got["v"], float) if got and got["v"] else np.zeros(size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, up to what no class changes."""
    return float(xlogx(m).sum() - xlogx(m.sum(1)).sum() - xlogx(m.sum(0)).sum())


def exchange_gain(m: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Change of the likelihood when one word of class a goes to each class; a row per word.

    right, left: counts of the classes that follow and precede the word (words x classes), without the word itself; own: how often it follows itself."""
    c = len(m)
    g, rows, cols = xlogx(m), m.sum(1), m.sum(0)
    after, before = right.sum(1) + own, left.sum(1) + own

    def stay(x, d):
        return xlogx(x) - xlogx(np.maximum(x - d, 0.0))

    keep = stay(m[a][None], right) + stay(m[:, a][None], left)
    keep[:, a] = stay(m[a, a], right[:, a] + left[:, a] + own)
    kept = keep.sum(1) - stay(rows[a], after) - stay(cols[a], before)
    grow = xlogx(m[None] + right[:, None, :]) - g[None] + (xlogx(m.T[None] + left[:, None, :]) - g.T[None])  # word x new class x other class
    i = np.arange(c)
    grow[:, i, i] = xlogx(m[i, i][None] + right + left + own[:, None]) - g[i, i][None]
    ba, ab = np.maximum(m[:, a][None] - left, 0.0), np.maximum(m[a][None] - right, 0.0)  # what class a has left
    grow[:, :, a] = xlogx(ba + right[:, [a]]) - xlogx(ba) + xlogx(ab + left[:, [a]]) - xlogx(ab)
    out = grow.sum(2) - (xlogx(rows[None] + after[:, None]) - xlogx(rows)[None]) - (xlogx(cols[None] + before[:, None]) - xlogx(cols)[None]) - kept[:, None]
    out[:, a] = 0.0
    return out


def clusters(near: DataFrame, words: int, classes: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every dense head number, and the class bigrams. 0 (all other words) has the last class, 1 (the end) class 0."""
    spark = near.sparkSession
    cls = 1 + np.arange(-2, words - 2) % max(1, classes - 2)
    cls[:2] = (classes - 1, 0)[:len(cls[:2])]

    def matrix(now):
        def run(batches):
            total = np.zeros((classes, classes))
            for b in slices(batches, 8):
                for blob in b.column(3).to_pylist():
                    at, other, n = pickle.loads(blob)[0]
                    total += np.bincount(now[unpack_ints(at)] * classes + now[unpack_ints(other)], unpack_wide(n), classes * classes).reshape(classes, classes)
            return total
        return summed(near, run, classes * classes).reshape(classes, classes)

    def moves(now, m):
        shared = spark.sparkContext.broadcast((now, m))

        def run(batches):
            for blob in (x for b in slices(batches, 1) for x in b.column(3).to_pylist()):
                word, to = exchanged(pickle.loads(blob), shared.value[0].copy(), shared.value[1].copy())
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(to)], ["word", "to"])

        got = near.mapInArrow(run, "word bigint, to bigint").toArrow()  # at most HEAD rows
        shared.unpersist()
        return got.column("word").to_numpy(), got.column("to").to_numpy()

    m = matrix(cls)
    best, share, calm = likelihood(m), 2, 0
    for turn in range(ROUNDS):
        word, to = moves(cls, m)
        use = (word % groups) % share == turn % share
        new = cls.copy()
        new[word[use]] = to[use]
        m2 = matrix(new)
        got = likelihood(m2)
        if got < best:
            share *= 2
            continue
        calm = calm + 1 if got - best < 1e-5 * abs(best) else 0
        cls, m, best = new, m2, got
        if calm == share:  # every word had its turn
            break
    return cls, m


def exchanged(sides: list, cls: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group's words, one after the other, go to their best class; each sees the moves before it. (word, new class) of those that moved."""
    classes = len(m)
    sides = [tuple(f(x) for f, x in zip((unpack_ints, unpack_ints, unpack_wide), s)) for s in sides]
    words = np.unique(np.concatenate([s[0] for s in sides])).astype(np.int64)
    moved = []
    for w in words[words > 1].tolist():
        hist, own = [], 0.0
        for k, (at, other, n) in enumerate(sides):
            lo, hi = np.searchsorted(at, (w, w + 1))
            o, c = other[lo:hi], n[lo:hi].astype(float)
            if k == 0 and (twice := o == w).any():
                own = float(c[twice][0])
            hist.append(np.bincount(cls[o], np.where(o == w, 0.0, c), classes))
        right, left = hist
        a = int(cls[w])
        gain = exchange_gain(m, a, right[None], left[None], np.array([own]))[0]
        gain[0] = -np.inf
        b = int(gain.argmax())
        if gain[b] > 1e-9:
            for c, sign in ((a, -1), (b, 1)):
                m[c] += sign * right
                m[:, c] += sign * left
                m[c, c] += sign * own
            cls[w] = b
            moved.append(w)
    return np.array(moved, np.int64), cls[moved].astype(np.int64)


# -- 3: the other words ---------------------------------------------------------------
def tail_classes(bodies: DataFrame, cls: np.ndarray, m: np.ndarray, parts: int) -> DataFrame:
    """Stored rows: `reply` to each block and part (class of its words outside the head, in the order of its dictionary), `stats` per part (blob: types and tokens of each class)."""
    classes = len(m)
    sc = bodies.sparkSession.sparkContext
    with np.errstate(divide="ignore"):
        follow = np.log((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * classes)).T   # class after the word x class of the word
        precede = np.log((m + 0.5) / (m.sum(0, keepdims=True) + 0.5 * classes))    # class before the word x class of the word
    shared = sc.broadcast((cls, follow, precede))

    @tidy
    def occurrences(batches):
        cls = shared.value[0]
        for b in slices(batches, 1):
            block, blob = b.column(0).to_pylist()[0], b.column(3).to_pylist()[0]
            _, held, sizes, part, codes, count, number, dense = pickle.loads(blob)
            dense, part, number = unpack_ints(dense), unpack_ints(part).astype(np.int64), unpack_ints(number)
            seq = training(held, unpack_wide(sizes), unpack_ints(codes))
            kind = cls[dense].astype(np.uint8)[seq]
            at = np.flatnonzero(dense[seq] == 0)
            before = kind[at - 1]  # no text begins with a word that has nothing before it but an end, which is never in the tail
            before[at == 0] = 0
            after = kind[np.minimum(at + 1, len(kind) - 1)]
            tail = np.flatnonzero((dense == 0) & (unpack_wide(count) > 0))
            tail = tail[np.argsort(part[tail], kind="stable")]
            place = np.zeros(len(dense), np.int64)
            place[tail] = np.arange(len(tail))
            order = np.argsort(place[seq[at]], kind="stable")
            n = np.bincount(place[seq[at]], minlength=len(tail))
            before, after, ends = before[order], after[order], np.concatenate([[0], np.cumsum(n)])
            cuts = np.searchsorted(part[tail], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[p], cuts[p + 1]
                span = slice(ends[lo], ends[hi])
                rows.append((block, p, "near", pickle.dumps((pack_ints(number[tail[lo:hi]]), pack_ints(n[lo:hi]), pack_ints(before[span]), pack_ints(after[span]))), None, None, None))
            if rows:
                yield _rows(rows)

    @tidy
    def run(batches):
        _, follow, precede = shared.value
        for part, rows in by_part(batches):
            numbers = [unpack_ints(pickle.loads(r[3])[0]).astype(np.int64) for r in rows]
            most = 1 + max(int(x.max()) for x in numbers)
            choice, count = np.zeros(most, np.uint8), np.zeros(most, np.int64)
            step = 1 << 14
            for lo in range(0, most, step):  # a span of words at a time
                width = min(step, most - lo)
                hist = np.zeros((2, width * classes))
                for r, number in zip(rows, numbers):
                    use = (number >= lo) & (number < lo + width)
                    if not use.any():
                        continue
                    _, n, before, after = map(unpack_ints, pickle.loads(r[3]))
                    owner = np.repeat(number - lo, n)
                    take = np.repeat(use, n)
                    for k, c in enumerate((before, after)):
                        hist[k] += np.bincount(owner[take] * classes + c[take], minlength=width * classes)
                left, right = hist.reshape(2, width, classes)
                gain = left @ precede + right @ follow
                gain[:, 0] = -np.inf
                choice[lo:lo + width] = gain.argmax(1)
                count[lo:lo + width] = right.sum(1)
            seen = count > 0
            types, tokens = np.bincount(choice[seen], minlength=classes), np.bincount(choice, count, classes)
            for lo in range(0, len(rows), 16):
                yield _rows([(r[0], part, "reply", pack_ints(choice[x]), None, None, None) for r, x in zip(rows[lo:lo + 16], numbers[lo:lo + 16])])
            yield _rows([(-1, part, "stats", np.stack([types, tokens]).astype(np.float64).tobytes(), None, None, None)])

    near = bodies.mapInArrow(occurrences, ROW).repartition(parts, "part").sortWithinPartitions("part")
    return stored(near.mapInArrow(run, ROW), "tail")


# -- 4: class bigrams, scores -----------------------------------------------------------
def ready(bodies: DataFrame, replies: DataFrame, cls: np.ndarray, classes: int) -> DataFrame:
    """Stored rows: `body` (keys, sizes, codes; count and class of every word) and `matrix` (blob: class bigrams of the block's training tokens; the last row counts
    the contexts of words seen once)."""
    shared = bodies.sparkSession.sparkContext.broadcast(cls)

    @tidy
    def run(batches):
        for block, body, rows in by_block(batches):
            keys, held, sizes, part, codes, count, _, dense = pickle.loads(body[3])
            parts, n, dense = unpack_ints(part).astype(np.int64), unpack_wide(count), unpack_ints(dense)
            kind = shared.value[dense].astype(np.uint8)
            tail = np.flatnonzero((dense == 0) & (n > 0))
            tail = tail[np.argsort(parts[tail], kind="stable")]
            for r, at in zip(rows, local(parts[tail], [r[1] for r in rows]).values()):
                kind[tail[at]] = unpack_ints(r[3])
            seq = training(held, unpack_wide(sizes), unpack_ints(codes))
            k = kind[seq].astype(np.int64)
            m = np.zeros((classes + 1, classes))
            if len(k):
                before = np.concatenate([[0], k[:-1]])
                m[:classes] = np.bincount(before * classes + k, minlength=classes * classes).reshape(classes, classes)
                once = np.concatenate([[False], n[seq[:-1]] == 1])
                m[classes] = np.bincount(k[once], minlength=classes)
            yield _rows([(block, -1, "body", pickle.dumps((keys, held, sizes, codes, count, pack_ints(kind))), None, None, None), (block, -1, "matrix", m.tobytes(), None, None, None)])

    return stored(with_replies(bodies, replies.filter("kind = 'reply'"), run), "ready")


@dataclass
class Model:
    """What scoring needs: log10 of class transitions (the last context is an unseen word), class sizes, discount, tokens and words."""
    step: np.ndarray
    unseen: np.ndarray    # log10 probability of one unseen word after each context
    others: float         # number of unseen words
    total: np.ndarray     # training tokens of each class
    discount: float
    tokens: int
    words: int

    @classmethod
    def of(cls, m: np.ndarray, types: np.ndarray, once: int, twice: int, words: int) -> Model:
        classes = m.shape[1]
        total = m[:classes].sum(0)
        tokens = int(total.sum())
        share = (total + 0.5) / (tokens + 0.5 * classes)
        new = (m > 0).sum(1, keepdims=True)
        p = (m + new * share) / np.maximum(m.sum(1, keepdims=True) + new, 1e-300)
        p = np.where(m.sum(1, keepdims=True) > 0, p, share)
        d = once / (once + 2 * twice) if once else 0.5
        d = min(max(d, 0.05), 0.95)
        free = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        if total[0] > 0:
            free[0] = 0.0  # the end's class is closed
        others = max(1.0, once * (once - 1) / (2 * (twice + 1)))
        u = p @ free / others
        return cls(np.log10(p), np.log10(np.maximum(u, 1e-300)), others, total, d, tokens, words)

    def emission(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of known words."""
        off = np.where(kind == 0, 0.0, self.discount)
        return np.log10(np.maximum(count - off, 1e-300) / np.maximum(self.total[kind], 1))


def scores(ready_rows: DataFrame, model: Model, key: str, key_type) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    shared = ready_rows.sparkSession.sparkContext.broadcast(model)
    kind_of_key = to_arrow_type(key_type)

    @tidy
    def run(batches):
        m = shared.value
        classes = len(m.total)
        for b in slices(batches, 1):
            keys, held, sizes, codes, count, kind = pickle.loads(b.column(3).to_pylist()[0])
            n, kind, seq, sizes = unpack_wide(count), unpack_ints(kind).astype(np.int64), unpack_ints(codes), unpack_wide(sizes)
            known = n > 0
            kind[~known] = classes
            emit = np.where(known, m.emission(n, np.minimum(kind, classes - 1)), 0.0)
            table = np.concatenate([m.step, m.unseen[:, None]], axis=1).ravel()  # the last column: an unseen word
            base = np.log10((n + 1.0) / (m.tokens + m.words + 1.0))
            begins = np.cumsum(sizes) - sizes
            k = kind[seq]
            before = np.concatenate([[0], k[:-1]])
            before[begins] = 0  # the end
            v = table[before * (classes + 1) + k] + emit[seq]
            cols = [pa.array(keys, kind_of_key), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat(known[seq].astype(np.int64), begins)),
                    pa.array(np.full(len(keys), m.tokens)), pa.array(np.add.reduceat(base[seq], begins)), pa.array(np.add.reduceat(v, begins))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = ready_rows.filter("kind = 'body'").mapInArrow(run, f"key {key_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("key", key)


def fit_score(docs: DataFrame, held: Column | None = None, key: str = "doc_id", text: str = "text", classes: int = CLASSES, parts: int | None = None) -> tuple[DataFrame, Model]:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the model)."""
    if not 4 <= classes <= 255:
        raise ValueError("between 4 and 255 classes")
    parts = parts or shuffle_parts(docs.sparkSession)
    code = coded(docs, held_out(key) if held is None else held, key, text, parts)
    tokens = code.agg(F.sum("a").alias("n")).first()["n"] or 0
    counts = counted(code, parts, tokens)
    s = counts.filter("kind = 'stats'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abc"]).first()
    head = Head.of(counts)
    bodies = headed(code, counts, head)
    cls, m = clusters(neighbours(bodies, parts), 1 + len(head.part), classes, parts)
    tail = tail_classes(bodies, cls, m, parts)
    rest = summed(tail.filter("kind = 'stats'"), lambda bs: sum((np.frombuffer(x, np.float64) for b in bs for x in b.column(3).to_pylist()), np.zeros(2 * classes)), 2 * classes).reshape(2, classes)
    types = rest[0] + np.bincount(cls[1:], minlength=classes)
    rows = ready(bodies, tail, cls, classes)
    full = summed(rows.filter("kind = 'matrix'"), lambda bs: sum((np.frombuffer(x, np.float64) for b in bs for x in b.column(3).to_pylist()), np.zeros((classes + 1) * classes)), (classes + 1) * classes)
    model = Model.of(full.reshape(classes + 1, classes), types, s["b"], s["c"], s["a"])
    return scores(rows, model, key, docs.schema[key].dataType), model
