"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters of the lower-cased text (any run of other characters is one blank), grams of 1 to 3 characters, hashed to 2^15 places;
weight log(1 + count) * log((1 + rows) / (1 + rows with it)) + 1, each document scaled to length one. The document frequencies count
every learning row. The weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a sample of
at most about PER_LANGUAGE learning rows of each language, drawn by a hash of the text (the documented bound of the fit); a quarter of
the sample is kept from the weights and fits the temperature of the scores.

Predictions read the text alone. Null text, or one without any letter: `und`, score 0. So is every text when nothing could be learned.
Rows are kept one for one, null and repeated keys too; a null key counts as the empty string in the choice of the learning rows. Only key,
text and label are read, so other columns cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pack_ints, slices, tidy, unpack_ints
from .pretokens import LETTER, STOP, classes, grouped, join, rows_of

PLACES = 1 << 15
PER_LANGUAGE = 1000
UNKNOWN = "und"
BUNDLE = 200_000  # code points of texts whose grams are hashed at once, about 100 bytes each


@dataclass
class Model:
    languages: list
    idf: np.ndarray      # PLACES
    weights: np.ndarray  # PLACES + 1 (the last is the bias) x languages
    temperature: float


def places(texts: list[str]) -> list[np.ndarray]:
    """Hashed grams of each text, with repeats; none for a text without letters."""
    cp = join([t.lower() for t in texts])
    kind = classes()[cp]
    letter, stop = kind == LETTER, kind == STOP
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | stop | before
    cp, letter, stop = cp[keep], letter[keep], stop[keep]
    cp[~letter] = 32
    ends = np.flatnonzero(stop)
    out, one = [], (cp + np.uint32(1)) * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
    hashed = [((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64) for h in (one, two, three)]
    at = 0
    for e in ends.tolist():
        if letter[at:e].any():
            out.append(np.concatenate([h[at:max(at, e - k)] for k, h in enumerate(hashed)]))
        else:
            out.append(np.empty(0, np.int64))
        at = e + 1
    return out


def sparse(p: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF values of one document, and the bias."""
    n = np.bincount(p, minlength=PLACES)
    at = np.flatnonzero(n)
    x = np.log1p(n[at]) * idf[at]
    return np.append(at, PLACES), np.append(x / np.sqrt(x @ x), 1.0)


def learning(key: str, text: str, label: str) -> Column:
    return ~held_out(key) & F.col(label).isNotNull() & F.col(text).isNotNull()


def held_out(key: str) -> Column:
    """A third of the rows, by a checksum of the key, is never learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Rows that have each place, and rows in all; each task adds up its own, so at most PLACES + 1 rows of each task are shuffled."""
    @tidy
    def run(batches):
        total, n = np.zeros(PLACES + 1, np.int64), 0
        for group in grouped(((None, t or "") for b in slices(batches) for t in b.column(0).to_pylist()), limit=BUNDLE):
            for p in places([t for _, t in group]):
                seen = np.zeros(PLACES, bool)
                seen[p] = True
                total[:PLACES] += seen
                n += 1
        total[PLACES] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])
    out = np.zeros(PLACES + 1, np.int64)
    for r in rows.select(text).mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place] = r.n
    return out[:PLACES], int(out[PLACES])


def train(examples: list, languages: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> np.ndarray:
    """FTRL-proximal over (places, values, language number)."""
    z = np.zeros((PLACES + 1, languages))
    n = np.zeros_like(z)

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[at] = more
    return weights(z, n)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss (golden section over its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))
    lo, hi, r = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.filter(learning(key, text, label)).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    sizes = {r.l: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(PLACES), np.zeros((PLACES + 1, 0)), 1.0)
    df, total = document_frequencies(rows, "t")
    idf = np.log((1 + total) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / sizes[x]))]), F.col("l"))
    sample = rows.filter(draw < rate).select("l", F.pmod(F.xxhash64("t", F.lit(3)), F.lit(4)).cast("int").alias("part"), "t")

    @tidy
    def run(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column(2).to_pylist()]
            out = [(i, *sparse(p, shared.value)) for i, p in enumerate(places(texts)) if len(p)]
            take = pa.array([i for i, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([pack_ints(a) for _, a, _ in out], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, _, x in out], pa.binary())], ["l", "part", "at", "x"])
    number = {x: i for i, x in enumerate(languages)}
    got = [(r.part, unpack_ints(r.at).astype(np.int64), np.frombuffer(r.x, np.float32).astype(np.float64), number[r.l])
           for r in sorted(sample.mapInArrow(run, "l string, part int, at binary, x binary").collect(), key=lambda r: (r.l, bytes(r.at), bytes(r.x)))]
    own = [g[1:] for g in got if g[0]]
    weights = train(own or [g[1:] for g in got], len(languages))
    aside = [g[1:] for g in got if not g[0]]
    scores = np.array([x @ weights[at] for at, x, _ in aside]).reshape(len(aside), len(languages))
    return Model(languages, idf, weights, temperature(scores, np.array([y for _, _, y in aside], np.int64)))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", passed: tuple = ()) -> DataFrame:
    """key, passed columns, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [key, *passed]
    names = [f"c{i}" for i in range(len(columns))]
    where = columns.index(text) if text in columns else len(columns)  # a text that is passed on is not sent twice

    @tidy
    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts = [t or "" for t in b.column(where).to_pylist()]
            lang, score = [], []
            for group in grouped(((None, t) for t in texts), limit=BUNDLE):
                for p in places([t for _, t in group]):
                    if not len(p) or not m.languages:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at, x = sparse(p, m.idf)
                    q = softmax(x @ m.weights[at] / m.temperature)
                    best = int(q.argmax())
                    lang.append(m.languages[best])
                    score.append(float(q[best]))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(columns)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
    schema = ", ".join([f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, columns)] + ["lang_pred string", "score double"])
    out = docs.select(*[F.col(c).alias(n) for n, c in zip(names, columns)], *([] if where < len(columns) else [F.col(text).alias("t")])).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "score")
