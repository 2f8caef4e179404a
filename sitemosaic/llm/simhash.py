"""SimHash near-duplicates by anchor-point covering.

Fingerprint: words of the lower-cased text, k-word shingles (repeats count), XXH64 of each; a bit is 1 if set in over half of the hashes.

Links: fingerprints at distance at most 2*BLOCKS agree within 2 bits on one of the two 32-bit halves, so some point lies within 1 bit of
both there. Anchors of a half are the words of a covering code: the perfect binary Golay code of length 23 (covering radius 3) on its
lower bits, all values on the other 9. A fingerprint is replicated to the nearest anchor of each point within 1 bit, which are the
anchors within covering radius plus threshold (3 + 1) of it: at most 15 of 2^21 a half. Both ends of every link meet at an anchor.
An anchor with more members than `most` (distinct fingerprints alike in that half) is divided again by the anchors of the other half,
for which the points within 2 bits count, as the whole threshold of 4 may lie there; no link is lost either way.

At an anchor, distinct fingerprints are compared in blocks. Not all pairs are given out: links that join nothing new are left out,
so n members give at most n-1 links and the same components. Components are found by alternating star steps on distinct fingerprints.

Null text and text without words have fingerprint zero and link like any other. Rows are kept one for one; repeated rows and equal texts
share a component. Null ids are kept: they belong to the component of their fingerprint, and component_id is null only if all its ids are.
Only id and text are read, so other columns cannot clash. An empty table gives an empty result.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, shuffle_parts, slices, text_bytes, tidy

DISTANCE = 4
GOLAY = 0b101011100011  # generator polynomial of the [23, 12] code
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = 1 << 12


# -- fingerprints ------------------------------------------------------------------
def fingerprint(text: bytes, k: int = 4) -> int:
    """Words are runs of anything but blank and bytes 9 to 13."""
    import xxhash
    words = text.translate(LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= k:
        h = [xxhash.xxh64_intdigest(body, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = [digest(body[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    every = np.array(h, np.uint64)
    for at in range(0, len(every), BITS):
        ones += np.unpackbits(every[at:at + BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """key, fp (the 64 bits as a long)."""
    from pyspark.sql.pandas.types import to_arrow_type
    key_type = to_arrow_type(docs.schema[key].dataType)

    @tidy
    def run(batches):
        for b in slices(batches, 1000):
            fp = np.array([fingerprint(t, k) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), pa.array(fp.view(np.int64))], ["key", "fp"])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, fp bigint")


# -- anchors -----------------------------------------------------------------------
@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of weight at most 3 that each syndrome stands for."""
    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v
    low = np.array([syndrome(v) for v in range(1 << 12)], np.uint32)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.uint32)
    bits = [1 << i for i in range(23)]
    error = np.zeros(1 << 11, np.uint32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = bits[a] | bits[b] | bits[c]
                error[low[e & 0xFFF] ^ high[e >> 12]] = e
    error[0] = 0
    return low, high, error


def nearest(half: np.ndarray) -> np.ndarray:
    """The anchor next to each 32-bit value."""
    low, high, error = golay()
    word = half & np.uint32(0x7FFFFF)
    return half ^ error[low[word & np.uint32(0xFFF)] ^ high[word >> np.uint32(12)]]


def anchors(half: np.ndarray, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the distinct anchors next to the points within so many bits (1 or 2) of each value."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    masks = [np.zeros(1, np.uint32), one]
    if flips == 2:
        a, b = np.triu_indices(32, 1)
        masks.append(one[a] | one[b])
    found = np.sort(nearest(half[:, None] ^ np.concatenate(masks)[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(new)
    return row, found[row, column]


# -- comparison at an anchor -------------------------------------------------------
def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints (by position): a spanning forest of those within the distance."""
    left, starts, ends = np.arange(len(fps)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                starts.append(np.full(len(found), x))
                ends.append(found)
                front += found.tolist()
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def replicate(fps: DataFrame, low_first: bool | None = None, flips: int = 1) -> DataFrame:
    """anchor, fp. By both halves, or for hot anchors (anchor, fp given): by the other half than the anchor's."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                fp = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
                halves = [(fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fp >> np.uint64(32)).astype(np.uint32)]
                for h in range(2):
                    if flips == 1:
                        row, anchor = anchors(halves[h], 1)
                        name = anchor.astype(np.int64) | np.int64(h) << 32
                        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.zeros(len(row), np.int64)), pa.array(fp[row].view(np.int64))], ["anchor", "other", "fp"])
                    else:
                        given = part.column(0).to_numpy(zero_copy_only=False)
                        own = np.flatnonzero(given >> 32 == 1 - h)
                        row, anchor = anchors(halves[h][own], 2)
                        yield pa.RecordBatch.from_arrays([pa.array(given[own][row]), pa.array(anchor.astype(np.int64)), pa.array(fp[own][row].view(np.int64))], ["anchor", "other", "fp"])
    return fps.mapInArrow(run, "anchor bigint, other bigint, fp bigint")


SMALL = 8  # groups up to this size are compared together, shifted against themselves


def compare(members: DataFrame, distance: int) -> DataFrame:
    """a, b: links of every (anchor, other) group; groups stream by, sorted, and only the last, unfinished one is held."""
    def pairs(anchor, other, fp):
        new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(other) != 0)])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        small = np.flatnonzero(size[group] <= SMALL)
        out = []
        for shift in range(1, SMALL):
            i = small[small + shift < len(fp)]
            i = i[group[i] == group[i + shift]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
            out.append((fp[i], fp[i + shift]))
        for g in np.flatnonzero(size > SMALL).tolist():
            own = fp[start[g]:start[g] + size[g]]
            i, j = forest(own, distance)
            out.append((own[i], own[j]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.uint64)]
        waiting = []
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new[2] = new[2].view(np.uint64)
            if not len(new[2]):
                continue
            change = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            last = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
            waiting.append([x[:last] for x in new])
            same = len(held[0]) == 0 or (held[0][-1] == new[0][-1] and held[1][-1] == new[1][-1] and not last)
            if not same or last:
                every = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
                if len(every[2]):
                    yield pairs(*every)
                held = [x[last:] for x in new]
            else:
                held = [np.concatenate([h, x]) for h, x in zip(held, new)]
            waiting = []
        if len(held[2]):
            yield pairs(*held)

    spark = members.sparkSession
    found = members.repartition(shuffle_parts(spark), "anchor", "other").sortWithinPartitions("anchor", "other").mapInArrow(run, "a bigint, b bigint")
    return found.distinct()


def links(fps: DataFrame, distance: int = DISTANCE, most: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp; same components as all pairs within the distance."""
    if distance > DISTANCE:
        raise ValueError("the anchors cover distances up to 4")
    fps = fps.select("fp").distinct()
    members = replicate(fps)
    crowded = members.groupBy("anchor").count().filter(F.col("count") > most).select(F.col("anchor").alias("hot"))
    crowded = checkpoint(crowded)
    if crowded.isEmpty():
        return compare(members, distance)
    hot = members.join(crowded, members.anchor == crowded.hot, "left_semi")
    calm = members.join(crowded, members.anchor == crowded.hot, "left_anti")
    return compare(calm, distance).unionByName(compare(replicate(hot.select("anchor", "fp"), flips=2), distance))


# -- components --------------------------------------------------------------------
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of edges (a, b): alternating large-star and small-star steps.
    A round only keeps links to smaller nodes, so no group is held in one place; it ends when a round changes nothing."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n"), F.col("m"))).filter("a <> b").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable over links, its own included)."""
    prints = checkpoint(fingerprints(docs, key, text, k))
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(prints, distance))
    grouped = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("of")).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
