"""Fill-in-middle transformation by content-defined chunk memoization.

1. A rolling hash of the last WINDOW bytes cuts a text's UTF-8 into chunks (about AVERAGE bytes, never over MOST), so that equal passages give
   equal chunks wherever they stand.
2. A chunk's boundary summary is: its number of code points that start in it, its first and last two bytes, and whether a sentinel stands in it. A worker
   keeps the summaries of chunks that it has seen; a chunk counts as seen only if all its bytes are equal (the cache is keyed by content). The
   cache holds HELD bytes and then starts anew, which changes no result.
3. Running sums of the chunks' counts give a text's length and the chunk in which a cut falls; only that chunk is looked into. Summaries of
   neighbours also tell a sentinel that stands across a border. So a repeated passage is never scanned twice.

Cuts: h1 to h4 are the first four 32-bit groups of the SHA-256 of `<seed>:<key>` (a null key counts as no characters). Prefix and middle end after
the smaller and larger of h1 mod (n+1), h2 mod (n+1) of the text's n code points. A text stays plain if it is empty, holds a sentinel, or h3 mod 100 >= rate;
of the others those with h4 mod 100 < spm take the order suffix, prefix, middle.

Null text counts as empty. Rows are kept one for one, repeated keys and equal texts included. Only key and text are read, so other columns cannot clash.
A text longer than the others is a task's only text in memory. An empty table gives an empty result.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ranges, slices, text_bytes, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (b"<P>", b"<S>", b"<M>")
WINDOW, AVERAGE, LEAST, MOST = 32, 1024, 128, 8192
HELD = 48 << 20
BATCH = 4 << 20
CONTINUATION = bytes(range(0x80, 0xC0))


@lru_cache(1)
def _values() -> np.ndarray:
    """A number for every byte; zero has zero, so that WINDOW zero bytes empty the hash."""
    v = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)).astype(np.uint32)
    v[0] = 0
    return v


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each place: sum of value[byte] * 2^age modulo 2^32, by doubling the span."""
    h = _values()[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is built before it is added
        span *= 2
    return h


def chunk_ends(texts: list[bytes]) -> list[np.ndarray]:
    """Ends of the chunks of each text."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
    h = rolling(data)
    places = np.flatnonzero((h & np.uint32(AVERAGE - 1)) == np.uint32(AVERAGE - 1)) + 1
    out, at = [], WINDOW
    for t in texts:
        n = len(t)
        lo, hi = np.searchsorted(places, (at + 1, at + n))
        cut = np.concatenate([[0], places[lo:hi] - at])
        cut = cut[1:][np.diff(cut) >= LEAST]  # a rule of the nearest places alone, so that it forgets what is far behind
        ends = np.append(cut, n) if n else np.empty(0, np.int64)
        size = np.diff(ends, prepend=0)
        if n and size.max() > MOST:  # even parts
            parts = -(-size // MOST)
            k = ranges(np.ones(len(parts), np.int64), parts)
            ends = np.repeat(ends - size, parts) + np.repeat(size, parts) * k // np.repeat(parts, parts)
        out.append(ends)
        at += n + WINDOW
    return out


class Summaries:
    """Boundary summaries of chunks by content."""

    def __init__(self):
        self.known, self.bytes, self.hits, self.misses = {}, 0, 0, 0

    def of(self, chunk: bytes) -> tuple[int, bytes, bytes, bool]:
        s = self.known.get(chunk)
        if s is None:
            self.misses += 1
            if self.bytes > HELD:
                self.known.clear()
                self.bytes = 0
            s = self.known[chunk] = (len(chunk.translate(None, CONTINUATION)), chunk[:2], chunk[-2:], any(x in chunk for x in SENTINELS))
            self.bytes += len(chunk) + 200
        else:
            self.hits += 1
        return s


_summaries = Summaries()  # of this Python worker


def place(chunk: bytes, k: int) -> int:
    """Byte offset of the k-th code point that starts in the chunk."""
    return int(np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)[k])


def rewritten(text: bytes, ends: np.ndarray, h: tuple, rate: int, spm: int, cache: Summaries) -> tuple:
    """n, form, prefix and middle code points, output."""
    chunks, at = [], 0
    for e in ends.tolist():
        chunks.append(text[at:e])
        at = e
    found = [cache.of(c) for c in chunks]
    before = np.zeros(len(found) + 1, np.int64)
    np.cumsum([s[0] for s in found], out=before[1:])
    n = int(before[-1])
    marked = any(s[3] for s in found) or any(x in a[2] + b[1] for a, b in zip(found, found[1:]) for x in SENTINELS)
    if not text or marked or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))

    def offset(point: int) -> int:
        if point >= n:
            return len(text)
        i = int(np.searchsorted(before, point, side="right")) - 1
        return (int(ends[i - 1]) if i else 0) + place(chunks[i], point - int(before[i]))

    a, b = offset(first), offset(second)
    p, s, m = SENTINELS
    if h[3] % 100 < spm:
        return n, "spm", first, second - first, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", first, second - first, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def draws(key: str, seed: int = 1) -> list[Column]:
    """h1 to h4."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """key, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)
    schema = pa.schema([("key", key_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("body", pa.binary())])

    @tidy
    def run(batches):
        def made(rows):
            ends = chunk_ends([t for _, t, _ in rows])
            got = [rewritten(t, e, h, rate, spm, _summaries) for (_, t, h), e in zip(rows, ends)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([k for k, _, _ in rows], *zip(*got)), schema)], schema=schema)

        for b in slices(batches):
            held, size = [], 0
            for k, t, *h in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), *(b.column(i).to_pylist() for i in range(2, 6))):
                if held and size + len(t) > BATCH:
                    yield made(held)
                    held, size = [], 0
                held.append((k, t, h))
                size += len(t)
            if held:
                yield made(held)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), *draws(key, seed)).mapInArrow(
        run, f"key {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, body binary")
    return out.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("body").cast("string").alias("output"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text, from form and output alone: no text of another form than plain holds a sentinel."""
    o, f = F.col(output), F.col(form)
    at = {x: F.locate(x, o) for x in (PREFIX, SUFFIX, MIDDLE)}
    m = at[MIDDLE]
    middle = F.substr(o, m + 3)

    def between(second: str) -> tuple[Column, Column]:
        s = at[second]
        return F.substr(o, F.lit(4), s - 4), F.substr(o, s + 3, m - s - 3)

    prefix, suffix = between(SUFFIX)
    suffix2, prefix2 = between(PREFIX)
    return F.when(f == "psm", F.concat(prefix, middle, suffix)).when(f == "spm", F.concat(prefix2, middle, suffix2)).otherwise(o)
