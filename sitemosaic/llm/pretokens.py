"""Pre-tokens of whole chunks of documents, vectorised: character classes, run borders, distinct words.

A chunk is a few consecutive documents of one partition (about CHUNK code points; a longer document is a chunk of its own).
It becomes its distinct words and a sequence of word numbers, one for every pre-token position.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .common import ranges, slices

CHUNK = 1_500_000
END = 0x110000  # stands after each document
OTHER, LETTER, NUMBER, SPACE, STOP = range(5)
LONG = 64  # longer words are told apart by a cryptographic hash


class Chunk(NamedTuple):
    keys: list          # one per document, as given
    sizes: np.ndarray   # pre-tokens of each document
    words: list         # distinct words, UTF-8
    hashes: np.ndarray  # of the words
    codes: np.ndarray   # word number at every position


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point as the tokenizer library has it: the library itself says which characters match the properties that the pattern names,
    so its Unicode version counts and not that of another module."""
    import tiktoken
    out = np.zeros(END + 1, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, END)))
    single = {bytes([i]): i for i in range(256)}
    for code, prop in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=prop, mergeable_ranks=single, special_tokens={})  # what does not match gives no ids
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = code
    out[END] = STOP
    return out


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(max(n, CHUNK + 100_000), b, np.uint64)
            a[0] = 1
            pair.append(np.cumprod(a, dtype=np.uint64))
        _powers[:] = pair
    return _powers[0], _powers[1]


def join(texts: list[str]) -> np.ndarray:
    """Code points of the texts, END after each."""
    sizes = [len(t) for t in texts]
    out = np.full(sum(sizes) + len(texts), END, np.uint32)
    at = 0
    for t, n in zip(texts, sizes):
        if n:
            out[at:at + n] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        at += n + 1
    return out


def borders(cp: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens, and their document.

    spaced: a blank before a run belongs to it, a run of white space leaves its last character to what follows, digits stay together.
    Otherwise white space goes and each digit stands alone. In both, an apostrophe with s, t, re, ve, m, ll or d is a match of its own."""
    c = classes()[cp]
    begin = np.empty(len(cp) + 4, bool)
    begin[:] = True
    begin[1:len(cp)] = c[1:] != c[:-1]
    at = begin[:len(cp)]
    at |= c == STOP
    if spaced:
        last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] < SPACE))
        at[last] = True
        at[last[cp[last] == 32] + 1] = False
    else:
        at |= c == NUMBER
    quote = np.flatnonzero((cp[:-2] == 39) & at[:-2] & (c[1:-1] == LETTER)) if len(cp) > 2 else np.empty(0, np.int64)
    if len(quote):
        a, b = cp[quote + 1], cp[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, n in ((one, 2), (two & ~one, 3)):
            at[quote[which] + 1] = False
            begin[quote[which] + n] = True
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], len(cp))
    kind = c[starts]
    keep = kind != STOP if spaced else kind < SPACE
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(np.flatnonzero(c == STOP), starts)


def distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (UTF-8), their hashes, and the word number of each position."""
    import pandas as pd
    power, inverse = powers(len(cp) + 1)
    v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    v *= power[:len(cp)]
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    size = (ends - starts).astype(np.uint64)
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(31)
    h = (h + size) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    raw = cp.tobytes()
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[4 * starts[i]:4 * ends[i]], digest_size=8).digest(), "little")
    codes, uniques = pd.factorize(h)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    words = [raw[4 * s:4 * e].decode("utf-32-le").encode() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    return words, uniques.astype(np.uint64), codes.astype(np.uint32)


def chunk_of(keys: list, texts: list[str], spaced: bool) -> Chunk:
    cp = join(texts)
    starts, ends, doc = borders(cp, spaced)
    words, hashes, codes = distinct(cp, starts, ends)
    return Chunk(keys, np.bincount(doc, minlength=len(texts)), words, hashes, codes)


def grouped(rows: Iterator[tuple], size=lambda row: len(row[1]), limit: int = CHUNK) -> Iterator[list[tuple]]:
    """Consecutive rows up to the limit."""
    held, n = [], 0
    for row in rows:
        if held and n + size(row) > limit:
            yield held
            held, n = [], 0
        held.append(row)
        n += size(row)
    if held:
        yield held


def rows_of(batches) -> Iterator[tuple]:
    """(key, text) of Arrow batches with two columns; null text is empty."""
    for b in slices(batches):
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield k, t or ""


def assemble(codes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids at all positions in order, and where each document ends in them. Word w has counts[w] ids, in flat from first[w] on."""
    per = counts[codes]
    ids = flat[ranges(first[codes], per)]
    return ids, np.concatenate([[0], np.cumsum(per)])[np.cumsum(sizes)]
