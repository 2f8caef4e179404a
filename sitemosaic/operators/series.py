"""Power series of the loss around reference coefficients, for few features.

One pass sums, for each cell and reference b, the derivatives of the row loss at b times the monomials of the features. Loss, gradient and Hessian at any
coefficients whose predictor differs from the reference's by at most `reach` follow from these sums with an error below rounding (the remainder of the series is at
most 1e-12 of a row). So all steps of all penalties and training subsets take one pass, where each would need its own evaluation of every row.
"""
from __future__ import annotations

from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..tasks import tidy
from .gram import Model, _matrix, _row_factor, buffered, by_cell

ORDER = {2: 16, 3: 12, 4: 10}   # coefficients of a model: order of the series
REFERENCES = 8                  # of one kind of model in a pass


def reach(family: str, p1: int) -> float:
    """Largest difference of predictors: derivatives of the logistic function grow like k! / 2.5^k, those of the exponential not at all."""
    k = ORDER[p1]
    return 2.5 * 1e-12 ** (1 / k) if family == "binomial" else 0.9 * (1e-12 * factorial(k)) ** (1 / k)


class Terms:
    """The monomials of p features up to an order, and the pairs (derivative k, monomial of degree <= k) of the series, by k."""

    def __init__(self, p1: int):
        p, self.order = p1 - 1, ORDER[p1]
        powers, self.parent = [(0,) * p], [(0, 0)]
        at = {powers[0]: 0}
        lo = 0
        for _ in range(self.order):
            hi = len(powers)
            for i in range(lo, hi):
                for j in range(p):
                    e = tuple(v + (q == j) for q, v in enumerate(powers[i]))
                    if e not in at:
                        at[e] = len(powers)
                        powers.append(e)
                        self.parent.append((i, j))
            lo = hi
        self.upto = [sum(sum(e) <= k for e in powers) for k in range(self.order + 1)]
        pairs = [(k, i) for k in range(self.order + 1) for i in range(self.upto[k])]
        self.k, self.mono = np.array(pairs).T
        where = {v: i for i, v in enumerate(pairs)}
        gamma = np.array(powers)[self.mono]
        self.exponent = np.concatenate([(self.k - gamma.sum(axis=1))[:, None], gamma], axis=1)   # of each coefficient, intercept first
        self.scale = 1.0 / np.array([np.prod([factorial(v) for v in e]) for e in self.exponent.tolist()], dtype=float)
        self.fact = np.array([factorial(k) for k in self.k.tolist()], dtype=float)

        def up(k, e, j):
            return where[k + 1, at[e if j == 0 else tuple(v + (q == j - 1) for q, v in enumerate(e))]]

        iu, ju = np.triu_indices(p1)
        self.first = np.array([[up(k, powers[i], j) for k, i in pairs if k < self.order] for j in range(p1)])
        self.second = self.first[ju][:, :int((self.k < self.order - 1).sum())]
        self.second = np.stack([self.first[i][self.second[n]] for n, i in enumerate(iu)])
        self.iu, self.ju = iu, ju

    def monomials(self, u: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.parent), len(u)))
        out[0] = 1.0
        for i, (q, j) in enumerate(self.parent[1:], 1):
            np.multiply(out[q], u[:, j], out=out[i])
        return out

    def weights(self, d: np.ndarray) -> np.ndarray:
        """Factor of every pair at differences d of the coefficients (one row each)."""
        out = np.repeat(self.scale[None], len(d), axis=0)
        for j in range(d.shape[1]):
            out *= (d[:, j:j + 1] ** np.arange(self.order + 1))[:, self.exponent[:, j]]
        return out

    def value(self, sums: np.ndarray, d: np.ndarray) -> np.ndarray:
        return self.weights(d) @ sums

    def derivatives(self, sums: np.ndarray, d: np.ndarray, a: np.ndarray):
        """Loss, gradient and Hessian; a maps coefficients to those of the scaled features."""
        w = self.weights(d)
        p1 = d.shape[1]
        g = w[:, :self.first.shape[1]] @ sums[self.first].T
        h = np.empty((len(d), p1, p1))
        h[:, self.iu, self.ju] = h[:, self.ju, self.iu] = w[:, :self.second.shape[1]] @ sums[self.second].T
        return w @ sums, g @ a, a.T @ h @ a


@lru_cache(maxsize=None)
def terms(p1: int) -> Terms:
    return Terms(p1)


def scaling(data: DataFrame, x: str, p: int) -> np.ndarray | None:
    """Matrix from coefficients of the features to those of features moved into [-1, 1]; None if a feature is not finite."""
    r = data.agg(*[f(F.col(x)[j]) for f in (F.min, F.max) for j in range(p)]).first()
    lo, hi = np.array(r[:p], dtype=float), np.array(r[p:], dtype=float)
    if not (np.isfinite(lo).all() and np.isfinite(hi).all()):
        return None
    a = np.zeros((p + 1, p + 1))
    a[0, 0], a[0, 1:] = 1.0, (lo + hi) / 2
    a[np.arange(1, p + 1), np.arange(1, p + 1)] = np.where(hi > lo, (hi - lo) / 2, 1.0)
    return a


def references(points: np.ndarray, far: float) -> np.ndarray:
    """Few points of which one is near each given point; those left over wait for another pass."""
    out, near = [], 0.8 * far
    left = points[np.argsort(np.abs(points - points[0]).sum(axis=1), kind="stable")]
    while len(left) and len(out) < REFERENCES:
        for part in (left, left[np.abs(left - left[0]).sum(axis=1) <= near]):
            mid = (part.min(axis=0) + part.max(axis=0)) / 2
            if (np.abs(part - mid).sum(axis=1) <= near).all():
                break
        else:
            mid = left[0]
        out.append(mid)
        left = left[np.abs(left - mid).sum(axis=1) > near]
    return np.array(out)


def _taylor(family: str, eta, y, order: int):
    """Taylor coefficients of the row loss at eta, one array per order."""
    if family == "tilt":
        w = np.exp(-eta)
        yield w
        for k in range(1, order + 1):
            w = w * (-1.0 / k)
            yield w
        return
    mu = 1.0 / (1.0 + np.exp(-eta))
    yield np.logaddexp(0.0, eta) - y * eta
    yield mu - y
    c = [mu]
    for k in range(1, order):
        s = c[-1] - sum(c[j] * c[k - 1 - j] for j in range(k // 2)) * 2.0
        if k % 2:
            s -= c[k // 2] * c[k // 2]
        c.append(s / k)
        yield c[-1] / (k + 1)


def series_sums(data: DataFrame, cells: list[tuple[int, Model, int, np.ndarray]], scale: np.ndarray, x: str) -> DataFrame:
    """(model, vec): sums of each (number, cell, its outer fold, references) and the rows that gave them; row `number * REFERENCES + r` is that of reference r."""
    spark = data.sparkSession
    p1 = len(scale)
    labels = sorted({k.site for _, k, _, _ in cells if k.site is not None})
    any_site = any(k.site is None for _, k, _, _ in cells)
    codes = {v: i for i, v in enumerate(labels)}
    table, index, slots = [], {}, []
    kinds: dict[tuple, int] = {}
    inverse = np.linalg.inv(scale)
    for number, k, fold, refs in cells:
        coef = None if k.plug is None else next((c for f, c in k.plug if f in (0, fold)), None)
        if coef is not None and id(coef) not in index:
            index[id(coef)] = len(table)
            table.append(np.asarray(coef, dtype=float))
        if k.plug is not None and coef is None:
            index.setdefault(None, len(table))
            if index[None] == len(table):
                table.append(np.zeros(p1))
        kind = kinds.setdefault((k.family, k.response, k.plug_kind, k.plug_family, k.radius, k.plug_radius, k.weight), len(kinds))
        plug = -1 if k.plug is None else index[None if coef is None else id(coef)]
        for r, ref in enumerate(refs):
            slots.append((-1 if k.site is None else codes[k.site], -1 if k.arm is None else k.arm, fold, k.cv, kind, plug, number * REFERENCES + r, inverse @ ref))
    cols = [np.array([s[i] for s in slots], dtype=np.int64) for i in range(7)]
    bc = spark.sparkContext.broadcast((codes, cols, np.stack([s[7] for s in slots]), {v: k for k, v in kinds.items()}, np.stack(table) if table else None, scale))

    @tidy
    def run(batches):
        codes, (site, arm, fold, cv, kind, plug, number, _), beta, kinds, table, scale = (lambda s: (s[0], (*s[1], None), *s[2:]))(bc.value)
        t = terms(p1)
        order, m = t.order, len(site)
        acc, rows, far, users = {}, np.zeros(m), np.zeros(m), {}
        centre, width = scale[0, 1:], np.diag(scale)[1:]

        for (x_all, a, y, rw), (cs, ca, cf, cc), idx in by_cell(buffered(batches), codes):
            if (cs, ca, cf, cc) not in users:
                use = ((site == -1) | (site == cs)) & ((arm == -1) | (arm == ca)) & (fold == cf) & ((cv == 0) | (cv == cc))
                users[cs, ca, cf, cc] = [(kd, np.flatnonzero(use & (kind == kd))) for kd in np.unique(kind[use])]
            mine = users[cs, ca, cf, cc]
            if not mine:
                continue
            step = max(64, min(4096, 200_000 // max(len(mm) for _, mm in mine)))
            for lo in range(0, len(idx), step):
                r = idx[lo:lo + step]
                x1 = np.concatenate([np.ones((len(r), 1)), x_all[r]], axis=1)
                mono = t.monomials((x_all[r] - centre) / width).T
                for kd, mm in mine:
                    family, resp, plug_kind, pfam, _, plug_radius, weighted = kinds[kd]
                    eta = x1 @ beta[mm].T
                    rows[mm] += len(r)
                    far[mm] = np.maximum(far[mm], np.abs(eta).max(axis=0))
                    factor = _row_factor(plug_kind, pfam, plug_radius, x1 @ table[plug[mm]].T) if plug_kind else None
                    if weighted:
                        factor = rw[r][:, None] if factor is None else factor * rw[r][:, None]
                    yy = (a[r] if resp == "a" else y[r]).astype(float)[:, None]
                    part = np.empty((len(mm), len(t.k)))
                    end = 0
                    for k, f in enumerate(_taylor(family, eta, yy, order)):
                        n = t.upto[k]
                        part[:, end:end + n] = (f if factor is None else f * factor).T @ mono[:, :n]
                        end += n
                    for i, j in enumerate(mm.tolist()):
                        if j in acc:
                            acc[j] += part[i]
                        else:
                            acc[j] = part[i].copy()
        # outside these bounds the loss is no longer that of the series
        bound = np.array([min(kinds[kd][4] if kinds[kd][0] == "tilt" else np.inf, C.LOGISTIC_CLIP, -np.log(C.TILT_GUARD[0])) - reach(kinds[kd][0], p1) for kd in range(len(kinds))])
        seen = sorted(acc)
        for lo in range(0, len(seen), 256):
            some = seen[lo:lo + 256]
            vec = np.stack([np.append(acc[j] if far[j] < bound[kind[j]] else np.full(len(t.k), np.nan), rows[j]) for j in some])
            ends = np.arange(0, vec.size + 1, vec.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(vec.ravel()))], names=["model", "vec"])

    rows = data if any_site or not labels else data.filter(F.col("site").isin(labels))
    return rows.select("site", "a", "y", F.col(x).alias("x"), "fold", "cv", "weight").mapInArrow(run, "model int, vec array<double>")
