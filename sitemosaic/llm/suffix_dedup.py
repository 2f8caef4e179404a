"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else.

1. Anchors. Every window of `length` bytes has an anchor: of the hashes of its GRAM-byte substrings the least, leftmost first. Equal windows
   have equal anchors at equal offsets, and neighbouring windows share theirs: an anchor stands for a run of windows, its fragment. Only
   anchors whose hash occurs again can have repeated windows.
2. A fragment that occurs again as a whole, with its offset, has only repeated windows: it is settled by a count, so copies in any
   number cost a row each and no comparison.
3. The different fragments of an anchor are cut from the texts and become strings of aligned 16-byte symbols. The fragments of many
   anchors make a bundle, whose suffix array is built by linear grouping: suffix groups of equal Lyndon prefix are settled in
   descending order, each pushing up the groups of its members' previous smaller suffixes; one ascending pass then emits every group's
   order. Neighbours in the suffix array that agree on 24 symbols may hold equal windows (any window covers 24 aligned symbols); those
   windows are compared by a 64-bit hash of their bytes, at equal offsets, and the equal ones give spans.
   An anchor with more than CROWD different fragments is not held by one task: its windows' hashes are counted by a shuffle instead.
4. Spans of a text are merged and its bytes removed.

Null text counts as empty; texts shorter than `length` lose nothing; equal texts that are long enough are removed wholly; overlaps in one
document count. Rows are kept one for one, null and repeated keys too. Only key and text are read, so other columns cannot clash. An
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, ranges, shuffle_parts, slices, small_batches, tidy
from .pretokens import powers
from .url_filter import bloom, possible

LENGTH = 400
GRAM = 64
SYMBOL = 16
CROWD = 3000
BUNDLE = 40_000     # symbols; a worker needs about 0.8 MB for each 1,000
SEGMENT = 1 << 20   # bytes; longer texts are read in overlapping segments
PLACE = np.uint64(SEGMENT - 1)


# -- hashes of substrings ----------------------------------------------------------
def byte_values() -> np.ndarray:
    return np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sums(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(byte_values()[b] * powers(len(b) + 1)[0][:len(b)], out=out[1:])
    return out


def substring_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of bytes start .. end; strings under 1024 bytes."""
    h = (total[end] - total[start]) * powers(len(total))[1][start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def anchors_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """[hash of the anchor, hash of the fragment with its offset, first window, anchor, last window] of a text's anchors."""
    parts = []
    span = length - gram + 1
    room = SEGMENT - length
    for base in range(0, max(1, len(text) - length + 1), room):
        b = np.frombuffer(text[base:base + room + length - 1], np.uint8)
        if len(b) < length:
            break
        total = sums(b)
        at = np.arange(len(b) - gram + 1)
        h = substring_hash(total, at, at + gram)
        low = h & ~PLACE | at.astype(np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
        where = (low & PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where)) - 1
        anchor = where[first]
        whole = substring_hash(total, first, last + length)
        whole ^= (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts.append([h[anchor], whole, base + first, base + anchor, base + last])
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3


# -- suffix array by linear grouping -----------------------------------------------
def suffix_array(s: list[int]) -> list[int]:
    """Of a sequence whose last symbol is its unique least. Linear in its length but for the sorting of the symbols."""
    n = len(s)
    names = sorted(set(s))
    number = {c: k for k, c in enumerate(names)}
    group = [number[c] for c in s]
    members = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(names) - 1))
    above = list(range(1, len(names) + 1))
    above[-1] = -1
    settled = bytearray(len(names))
    sizes = [0] * len(names)
    before = [-1] * n   # the previous smaller suffix
    g = len(names) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = None
        settled[g] = 1
        sizes[g] = len(own)
        runs: dict = {}
        held, count = -1, 0
        for i in own:
            j = i - 1
            while j >= 0 and settled[group[j]]:
                j = before[j]
            before[i] = j
            if j == held:
                count += 1
            else:
                if held >= 0:
                    runs.setdefault(group[held], {}).setdefault(count, []).append(held)
                held, count = j, 1
        if held >= 0:
            runs.setdefault(group[held], {}).setdefault(count, []).append(held)
        for h, by_count in runs.items():
            low = h
            for c in sorted(by_count):  # more repeats of this group after the prefix: greater
                new, top = len(members), above[low]
                moved = by_count[c]
                members.append(moved)
                for j in moved:
                    group[j] = new
                below.append(low)
                above.append(top)
                above[low] = new
                if top >= 0:
                    below[top] = new
                settled.append(0)
                sizes.append(0)
                low = new
        g = below[g]
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += sizes[g]
        g = above[g]
    out = [n - 1] * n
    placed = bytearray(n)
    placed[n - 1] = 1
    start[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def repeated_windows(family: np.ndarray, left: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each fragment (anchor's family, bytes before the anchor, bytes): positions in it of windows that another of its family has at the same offset."""
    need = (length - SYMBOL + 1) // SYMBOL
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.cumsum(sizes) - sizes
    skip = left % SYMBOL  # symbols are aligned with the anchor
    count = np.maximum(sizes - skip, 0) // SYMBOL
    at = ranges(base + skip, count * SYMBOL).reshape(-1, SYMBOL)
    symbols = np.unique(np.ascontiguousarray(text[at]).view("V16").reshape(-1), return_inverse=True)[1].reshape(-1)
    # fragments one after another, each closed by a mark of its own
    f = len(bodies)
    line = np.zeros(len(symbols) + f + 1, np.int64)
    close = np.cumsum(count + 1) - 1
    inside = np.ones(len(line), bool)
    inside[close] = inside[-1] = False
    line[inside] = symbols + f + 1
    line[close] = np.arange(1, f + 1)
    order = np.array(suffix_array(line.tolist()), np.int64)
    padded = np.concatenate([line, np.arange(-need, 0)])
    same = np.ones(len(order) - 1, bool)
    for k in range(need):
        same &= padded[order[:-1] + k] == padded[order[1:] + k]
    maybe = np.zeros(len(line), bool)
    maybe[order[:-1][same]] = True
    maybe[order[1:][same]] = True
    # windows whose first whole symbol may be repeated
    maybe = np.flatnonzero(maybe)
    owner = np.searchsorted(close, maybe)
    first = skip[owner] + SYMBOL * (maybe - (close[owner] - count[owner]))
    lo, hi = np.maximum(first - SYMBOL + 1, 0), np.minimum(first, sizes[owner] - length)
    lo, hi, owner = lo[hi >= lo], hi[hi >= lo], owner[hi >= lo]
    window = ranges(lo, hi - lo + 1)
    owner = np.repeat(owner, hi - lo + 1)
    total = sums(text)
    h = substring_hash(total, base[owner] + window, base[owner] + window + length)
    offset = window - left[owner]
    by = np.lexsort((h, offset, family[owner]))
    eq = (h[by][1:] == h[by][:-1]) & (offset[by][1:] == offset[by][:-1]) & (family[owner][by][1:] == family[owner][by][:-1]) & (owner[by][1:] != owner[by][:-1])
    hit = np.zeros(len(by), bool)
    hit[by[1:][eq]] = True
    hit[by[:-1][eq]] = True
    owner, window = owner[hit], window[hit]
    by = np.lexsort((window, owner))
    owner, window = owner[by], window[by]
    return np.split(window, np.searchsorted(owner, np.arange(1, f)))


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at sorted starts, as (first, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [-1]])] + length).tolist()))


# -- jobs --------------------------------------------------------------------------
def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, body (bytes), t1, t2: 96 hash bits that stand for the text."""
    out = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    return out.withColumns({"t1": F.xxhash64("body"), "t2": F.hash(F.lit(7), "body")})


ANCHOR = "ah bigint, fh bigint, t1 bigint, t2 int, lo int, at int, hi int"


def anchors(texts: DataFrame, length: int, coder: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """The anchors of all texts; with a coder, of what it makes of them, in the same worker."""
    @tidy
    def run(batches):
        for b in slices(batches, 250):
            cols = [[] for _ in range(5)]
            t1, t2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            count = np.zeros(b.num_rows, np.int64)
            for i, v in enumerate(b.column(0)):
                v = v.as_py()
                if coder:
                    v = coder(v)
                if len(v) >= length:
                    got = anchors_of(v, length)
                    count[i] = len(got[0])
                    for c, x in zip(cols, got):
                        c.append(x)
            if count.any():
                ah, fh, lo, at, hi = map(np.concatenate, cols)
                yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(fh.view(np.int64)), pa.array(np.repeat(t1, count)), pa.array(np.repeat(t2, count)),
                                                  *(pa.array(x.astype(np.int32)) for x in (lo, at, hi))], ["ah", "fh", "t1", "t2", "lo", "at", "hi"])
    return texts.select("body", "t1", "t2").mapInArrow(run, ANCHOR)


FRAGMENT = "ah bigint, n bigint, t1 bigint, t2 int, at int, lead int, part binary"


def fragments(texts: DataFrame, wanted: DataFrame, length: int, coder: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """The bytes of the wanted fragments (ah, n, t1, t2, lo, at, hi); with a coder, of what it makes of the texts."""
    per_text = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("ah", "n", "lo", "at", "hi")).alias("cuts"))
    keys = checkpoint(wanted.select("t1").distinct())
    table, blocks = bloom(keys, "t1")
    few = possible(texts.select("body", "t1", "t2"), checkpoint(table), blocks, "t1").filter("possible").select("body", "t1", "t2").dropDuplicates(["t1", "t2"])

    @tidy
    def run(batches):
        for b in slices(batches):
            rows = []
            for body, t1, t2, cuts in zip(*(b.column(k) for k in range(4))):
                body, t1, t2 = body.as_py(), t1.as_py(), t2.as_py()
                if coder:
                    body = coder(body)
                for c in cuts.as_py():
                    rows.append((c["ah"], c["n"], t1, t2, c["at"], c["at"] - c["lo"], body[c["lo"]:c["hi"] + length]))
                if len(rows) > 4000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["ah", "n", "t1", "t2", "at", "lead", "part"])
    return few.join(per_text, ["t1", "t2"]).select("body", "t1", "t2", "cuts").mapInArrow(run, FRAGMENT)


SPAN = "t1 bigint, t2 int, first int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["t1", "t2", "first", "end"])


def by_suffix_array(parts: DataFrame, length: int) -> DataFrame:
    """Spans of fragments that occur once (n = 1), from bundles of whole anchors; rows of an anchor stream by together."""
    def solve(rows):
        ah, n, t1, t2, at, lead, bodies = zip(*rows)
        lead = np.array(lead, np.int64)
        out = []
        for i, w in enumerate(repeated_windows(np.array(ah, np.int64), lead, list(bodies), length)):
            if n[i] == 1:
                shift = at[i] - int(lead[i])
                out += [(t1[i], t2[i], shift + a, shift + b) for a, b in runs_of(w, length)]
        return _spans(out)

    @tidy
    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(7))):
                if size >= BUNDLE and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) // SYMBOL + 1
                last = row[0]
        if held:
            yield solve(held)
    return parts.repartition(shuffle_parts(parts.sparkSession), "ah").sortWithinPartitions("ah").mapInArrow(run, SPAN)


def by_counts(parts: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: hashes of all windows at their offsets are counted, with map-side sums."""
    @tidy
    def run(batches):
        for b in batches:
            for ah, n, t1, t2, at, lead, part in zip(*(b.column(k).to_pylist() for k in range(7))):
                start = np.arange(len(part) - length + 1)
                h = substring_hash(sums(np.frombuffer(part, np.uint8)), start, start + length).view(np.int64)
                k = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, ah)), pa.array((start - lead).astype(np.int32)), pa.array(h), pa.array(np.full(k, n)), pa.array(np.full(k, t1)), pa.array(np.full(k, t2, np.int32)),
                                                  pa.array((start - lead + at).astype(np.int32))], ["ah", "off", "h", "n", "t1", "t2", "first"])
    windows = parts.mapInArrow(run, "ah bigint, off int, h bigint, n bigint, t1 bigint, t2 int, first int")
    again = windows.groupBy("ah", "off", "h").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    return windows.filter("n = 1").join(again, ["ah", "off", "h"], "left_semi").select("t1", "t2", "first", (F.col("first") + length).alias("end"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, coder: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """t1, t2, spans: sorted, disjoint (first, end) byte spans of every text that has some.

    coder: the strings are sought in what it makes of each text, and the spans are of that; t1 and t2 still stand for the text. A task
    that codes and looks for anchors does both in one worker."""
    if length < GRAM + SYMBOL or length > 900:
        raise ValueError("the length must be between 80 and 900")
    small_batches(docs.sparkSession)
    texts = named(docs, key, text)
    every = anchors(texts, length, coder)
    again = checkpoint(every.groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"))
    table, blocks = bloom(again, "ah")
    some = possible(every, checkpoint(table), blocks, "ah").filter("possible").drop("possible")
    some = checkpoint(some.join(again, "ah", "left_semi").select("ah", "fh", "t1", "t2", "lo", "at", "hi"))
    kinds = checkpoint(some.groupBy("ah", "fh").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "lo", "at", "hi")).alias("one")))
    whole = some.join(kinds.filter("n > 1").select("ah", "fh"), ["ah", "fh"], "left_semi").select("t1", "t2", F.col("lo").alias("first"), (F.col("hi") + length).alias("end"))
    mixed = kinds.groupBy("ah").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = checkpoint(kinds.join(mixed, "ah").select("ah", "n", "kinds", "one.*"))
    crowd = checkpoint(wanted.filter(F.col("kinds") > CROWD).select("ah").distinct())
    parts = fragments(texts, wanted, length, coder)
    if crowd.isEmpty():
        spans = by_suffix_array(parts, length)
    else:
        parts = checkpoint(parts)
        spans = by_suffix_array(parts.join(crowd, "ah", "left_anti"), length).unionByName(by_counts(parts.join(crowd, "ah", "left_semi"), length))
    return merged(whole.distinct().unionByName(spans))


def merged(spans: DataFrame) -> DataFrame:
    """t1, t2, spans: sorted, disjoint (first, end) of each text, from rows t1, t2, first, end."""
    spans = spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))

    @tidy
    def run(batches):  # sorted spans that touch or overlap become one
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                joined = []
                for s in spans:
                    if joined and s["first"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], s["end"])
                    else:
                        joined.append(dict(s))
                out.append(joined)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, b.column(2).type)], ["t1", "t2", "spans"])
    return spans.mapInArrow(run, "t1 bigint, t2 int, spans array<struct<first:int,end:int>>")


# -- passages by number of words ---------------------------------------------------
WORD = 8  # bytes of a word's code
LONG = 1000  # bytes; longer words have their code from a digest
WIDE_HINTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")  # blanks outside ASCII


def words_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words are what stands between blanks."""
    blank = np.ones(len(body) + 2, np.int8)
    blank[1:-1] = np.frombuffer(body, np.uint8) <= 32
    if not body.isascii() and any(x in body for x in WIDE_HINTS):
        for m in WIDE.finditer(body):
            blank[m.start() + 1:m.end() + 1] = 1
    edge = np.flatnonzero(np.diff(blank))
    return edge[::2], edge[1::2]


def word_codes(body: bytes) -> bytes:
    """Eight bytes for each word, so that repeated words are repeated bytes."""
    start, end = words_of(body)
    code = np.empty(len(start), np.uint64)
    far = end - start > LONG
    for i in np.flatnonzero(far).tolist():
        code[i] = int.from_bytes(hashlib.blake2b(body[start[i]:end[i]], digest_size=WORD).digest(), "little")
    near = np.flatnonzero(~far)
    b = np.frombuffer(body, np.uint8)
    for part in np.split(near, np.flatnonzero(np.diff(start[near] // SEGMENT)) + 1) if len(near) else ():
        at = start[part[0]]
        code[part] = substring_hash(sums(b[at:end[part[-1]]]), start[part] - at, end[part] - at)
    return code.tobytes()


def repeated_word_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 51) -> DataFrame:
    """The same spans for strings of `words` words that also start anywhere else, whatever their bytes and the blanks between their words.

    Texts become strings of word codes, in which repeated_spans finds repeated strings of words x 8 bytes; a span's whole words are looked
    up in the text. It reaches from the first byte of its first word to the last of its last."""
    # a text of so many words has as many bytes and blanks between them
    docs = docs.filter(F.octet_length(F.col(text).cast("binary")) >= 2 * words - 1).select(key, text)
    found = checkpoint(repeated_spans(docs, key, text, WORD * words, word_codes))
    table, blocks = bloom(found.select("t1").distinct(), "t1")
    few = possible(named(docs, key, text).select("body", "t1", "t2"), checkpoint(table), blocks, "t1").filter("possible").drop("possible")
    some = few.dropDuplicates(["t1", "t2"]).join(found, ["t1", "t2"]).select("body", "t1", "t2", "spans")

    @tidy
    def run(batches):
        for b in slices(batches):
            rows = []
            for body, t1, t2, spans in zip(*(b.column(k).to_pylist() for k in range(4))):
                start, end = words_of(body)
                for s in spans:
                    first, last = -(-s["first"] // WORD), s["end"] // WORD - 1
                    if last - first + 1 >= words:
                        rows.append((t1, t2, int(start[first]), int(end[last])))
            yield _spans(rows)
    return merged(some.mapInArrow(run, SPAN))


def remove(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", passed: tuple = ()) -> DataFrame:
    """key, passed columns, n_bytes, spans, kept (bytes outside the spans), kept_text (the same as text, without characters that a cut
    has broken; null if the text is null or empty). Texts without spans do not move."""
    base = docs.select(F.col(key).alias("key"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(passed)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    base = base.withColumns({"t1": F.xxhash64("body"), "t2": F.hash(F.lit(7), "body")})
    spans = checkpoint(spans)
    table, blocks = bloom(spans.select("t1").distinct(), "t1")
    base = possible(base, checkpoint(table), blocks, "t1")
    hit = base.filter("possible").join(spans, ["t1", "t2"], "left")
    columns = ["key", *[f"p{i}" for i in range(len(passed))], "body", "spans"]
    hit, rest = hit.select(columns), base.filter("not possible").withColumn("spans", F.lit(None).cast("array<struct<first:int,end:int>>")).select(columns)

    @tidy
    def run(batches):
        at = len(columns) - 2
        for b in slices(batches):
            kept, words = [], []
            for body, spans in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist()):
                pieces, last = [], 0
                for s in spans or ():
                    pieces.append(body[last:s["first"]])
                    last = s["end"]
                kept.append(b"".join([*pieces, body[last:]]))
                words.append("".join(x.decode(errors="ignore") for x in [*pieces, body[last:]]) if body else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.binary()), pa.array(words, pa.string())], [*columns, "kept", "kept_text"])
    hit = hit.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hit.schema) + ", kept binary, kept_text string")
    out = hit.unionByName(rest.withColumns({"kept": F.col("body"), "kept_text": F.when(F.octet_length("body") > 0, F.col("body").cast("string"))}))
    return out.select(F.col("key").alias(key), *[F.col(f"p{i}").alias(c) for i, c in enumerate(passed)], F.octet_length("body").cast("long").alias("n_bytes"), F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"), "kept", "kept_text")
