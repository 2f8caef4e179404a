"""Moments of scores straight from observations: a row is scored under all its outer folds inside the task and only sums leave it.

For every (outer fold, fold) a task keeps row count, mean and co-moments of the score vector: on target rows both arms' scores and all predictions, on source rows
both arms' corrections at every inference radius. Tasks' results meet per (outer fold, fold) and are merged by means, so nothing cancels. Single arms, the
contrast and the two-arm problem are linear in that vector, so all of them come from one pass, whatever radii and arms are asked for. Draws of row masses are
made once per row and serve all its outer folds.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from .gram import _matrix
from .resample import masses

STATS = "radius double, outer_fold int, fold int, n_t bigint, n_s array<bigint>, mean array<double>, cov array<double>, corr array<double>, corr_cov array<double>"
MOMENTS = ("arm int, outer_fold int, fold int, radius double, n_t bigint, n_s array<bigint>, mu_t double, mu_pred array<double>, delta array<double>, mu_s array<double>, v_ot double, "
           "v_t array<double>, v_s array<double>, c_ot array<double>, c_cross array<array<double>>")
JOINT = ("outer_fold int, fold int, radius double, n_t bigint, n_s array<bigint>, mean array<double>, cov array<array<double>>, d1 array<double>, d0 array<double>, v1 array<double>, v0 array<double>, "
         "v10 array<double>")


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)))


class Scorer:
    """The score vectors of a batch's rows under one set of coefficients; the same formulas as the score rows."""

    def __init__(self, family: str, rule: str, target_radius: float):
        self.family, self.rule, self.target_radius = family, rule, target_radius

    def response(self, x, beta):
        eta = x @ np.asarray(beta).T
        return _logistic(eta) if self.family == "binomial" else eta

    def target(self, w, z, a, y, c) -> np.ndarray:
        """phi1, phi0, K predictions of arm 1, K of arm 0."""
        m = {arm: self.response(w, c[f"m{arm}"]) for arm in (1, 0)}
        if self.rule == "lasso":
            p1 = np.clip(_logistic(z @ np.asarray(c["t1"])), *C.PROPENSITY_CLIP)
            p = {1: np.maximum(p1, C.PROPENSITY_CLIP[0]), 0: np.maximum(1 - p1, C.PROPENSITY_CLIP[0])}
            if self.family == "binomial":
                m = {arm: np.clip(v, *C.OUTCOME_CLIP) for arm, v in m.items()}
        else:
            p = {arm: _logistic(np.clip(z @ np.asarray(c[f"t{arm}"]), -self.target_radius, self.target_radius)) for arm in (1, 0)}
        phi = [m[arm] + np.where(a == arm, (y - m[arm]) / p[arm], 0.0) for arm in (1, 0)]
        psi = [self.response(w, np.array(c[f"models{arm}"], dtype=float).reshape(-1, w.shape[1])) for arm in (1, 0)]
        return np.column_stack([*phi, *psi])

    def source(self, w, z, a, y, c, radii) -> np.ndarray:
        """Corrections of arm 1 and 0, radius by radius."""
        out = []
        gap, eta = {}, {}
        for arm in (1, 0):
            gap[arm], eta[arm] = y - self.response(w, c[f"al{arm}"]), z @ np.asarray(c[f"g{arm}"])
        for r in radii:
            for arm in (1, 0):
                ratio = np.clip(np.clip(np.exp(-np.clip(eta[arm], -r, r)), *C.TILT_GUARD), *C.RATIO_CLIP)
                out.append(np.where(a == arm, ratio * gap[arm], 0.0))
        return np.column_stack(out)


def _scored(data: DataFrame, coef: DataFrame, family: str, rule: str, target_radius: float, radii: Sequence[float]):
    """Broadcast coefficients, and a function: Arrow batch -> (site, fold, row ids, outer fold, score vectors) of every cell."""
    table: dict = {}
    for r in coef.collect():  # folds x folds x sites rows, bounded by the plan
        table.setdefault((r["site"], r["fold"]), []).append((r["outer_fold"], {k: v for k, v in r.asDict().items() if v is not None}))
    shared = data.sparkSession.sparkContext.broadcast((table, Scorer(family, rule, target_radius), tuple(radii)))

    def cells(b):
        table, scorer, radii = shared.value
        n = b.num_rows
        one = np.ones((n, 1))
        w, z = np.concatenate([one, _matrix(b.column("w"))], axis=1), np.concatenate([one, _matrix(b.column("z"))], axis=1)
        a, y, fold, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "y", "fold", "obs_id"))
        site = b.column("site").dictionary_encode()
        labels, code = site.dictionary.to_pylist(), site.indices.to_numpy(zero_copy_only=False)
        both = code.astype(np.int64) << 32 | fold
        for key in np.unique(both).tolist():
            s, f = labels[key >> 32], key & 0xFFFFFFFF
            r = np.flatnonzero(both == key)
            yield s, f, ids[r], [(o, scorer.target(w[r], z[r], a[r], y[r], c) if s == C.TARGET else scorer.source(w[r], z[r], a[r], y[r], c, radii)) for o, c in table.get((s, f), ())]

    return data.select("obs_id", "site", "a", "y", "w", "z", "fold"), cells


def _merge(one, n, mean, m2):
    """Counts, means and co-moments of two sets of rows."""
    if one is None:
        return n, mean, m2
    n0, mean0, m20 = one
    d, total = mean - mean0, n0 + n
    return total, mean0 + d * (n / total), m20 + m2 + np.outer(d, d) * (n0 * n / total)


def score_stats(data: DataFrame, coef: DataFrame, sources: Sequence[str], family: str, radii: Sequence[float], rule: str = "lasso", target_radius: float = C.RADIUS, inner: bool = True) -> DataFrame:
    """A row per (radius, outer fold, fold): counts, means and covariances of the score vectors. inner: only folds that teach the weights of the outer fold."""
    rows, cells = _scored(data, coef.filter(F.col("fold") != F.col("outer_fold")) if inner else coef, family, rule, target_radius, radii)
    radii, sources = tuple(float(r) for r in radii), list(sources)
    k = len(sources)

    def partial(batches):
        acc: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            for s, f, _, scored in cells(b):
                for o, v in scored:
                    mean = v.mean(axis=0)
                    acc[o, f, s] = _merge(acc.get((o, f, s)), len(v), mean, (v - mean).T @ (v - mean))
        for (o, f, s), (n, mean, m2) in acc.items():
            cells_ = [pa.array([o], pa.int32()), pa.array([f], pa.int32()), pa.array([s]), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cells_, ["outer_fold", "fold", "site", "n", "mean", "m2"])

    def meet(batches):
        acc: dict = {}
        for b in batches:
            for r in b.to_pylist():
                mean = np.array(r["mean"])
                at = acc.setdefault((r["outer_fold"], r["fold"]), {})
                at[r["site"]] = _merge(at.get(r["site"]), r["n"], mean, np.array(r["m2"]).reshape(len(mean), -1))
        out = []
        for (o, f), by in acc.items():
            q = 2 + 2 * k
            n, mean, m2 = by.get(C.TARGET, (0, np.full(q, np.nan), np.full((q, q), np.nan)))
            none = (0, np.full(2 * len(radii), np.nan), np.full((2 * len(radii),) * 2, np.nan))
            src = [by.get(s, none) for s in sources]
            for i, r in enumerate(radii):
                j = slice(2 * i, 2 * i + 2)
                cov = [m[j, j] / max(c, 1) for c, _, m in src]
                out.append({"radius": r, "outer_fold": o, "fold": f, "n_t": n, "n_s": [c for c, _, _ in src], "mean": mean.tolist(), "cov": (m2 / max(n, 1)).ravel().tolist(),
                            "corr": [x for _, m, _ in src for x in m[j].tolist()], "corr_cov": [x for c in cov for x in (c[0, 0], c[1, 1], c[0, 1])]})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("radius", pa.float64()), ("outer_fold", pa.int32()), ("fold", pa.int32()), ("n_t", pa.int64()), ("n_s", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in ("mean", "cov", "corr", "corr_cov")]]))

    met = rows.mapInArrow(partial, "outer_fold int, fold int, site string, n bigint, mean array<double>, m2 array<double>").repartition("outer_fold", "fold")
    return met.mapInArrow(meet, STATS)


def _kind(schema: str) -> pa.Schema:
    one = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    return pa.schema([(n, one[t]) for n, t in (x.split() for x in schema.split(", "))])


def arm_moments(stats: DataFrame, k: int, arms: Sequence[int]) -> DataFrame:
    """Unfloored fold moments of single arms (1, 0) or the contrast (2)."""
    schema = _kind(MOMENTS)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                mean, cov = np.array(r["mean"]), np.array(r["cov"]).reshape(2 + 2 * k, -1)
                d, dc = np.array(r["corr"]).reshape(k, 2), np.array(r["corr_cov"]).reshape(k, 3)
                eye = np.eye(2 + 2 * k)
                pick = {a: np.concatenate([eye[[1 - a]], eye[2 + (1 - a) * k:2 + (2 - a) * k]]) for a in (1, 0)}
                pick[2] = pick[1] - pick[0]
                for a in arms:
                    m, c = pick[a] @ mean, pick[a] @ cov @ pick[a].T
                    delta = d[:, 0] - d[:, 1] if a == 2 else d[:, 1 - a]
                    v_s = dc[:, 0] + dc[:, 1] - 2 * dc[:, 2] if a == 2 else dc[:, 1 - a]
                    cross = c[1:, 1:].copy()
                    np.fill_diagonal(cross, 0.0)
                    out.append({"arm": a, **{x: r[x] for x in ("outer_fold", "fold", "radius", "n_t", "n_s")}, "mu_t": m[0], "mu_pred": m[1:].tolist(), "delta": delta.tolist(), "mu_s": (m[1:] + delta).tolist(), "v_ot": c[0, 0],
                                "v_t": np.diag(c)[1:].tolist(), "v_s": np.maximum(v_s, 0.0).tolist(), "c_ot": c[0, 1:].tolist(), "c_cross": cross.tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stats.mapInArrow(run, MOMENTS)


def two_arm_moments(stats: DataFrame, k: int) -> DataFrame:
    """Covariance of the (1 + 2K) columns of the two-arm problem, variances of the corrections."""
    schema = _kind(JOINT)
    q = 2 + 2 * k
    t = np.zeros((1 + 2 * k, q))
    t[0, :2] = 1, -1
    for i in range(k):
        t[1 + i, [2 + i, 0]] = 1, -1           # treated predictions minus treated score
        t[1 + k + i, [1, 2 + k + i]] = 1, -1   # control score minus control predictions

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                d, dc = np.array(r["corr"]).reshape(k, 2), np.array(r["corr_cov"]).reshape(k, 3)
                out.append({**{x: r[x] for x in ("outer_fold", "fold", "radius", "n_t", "n_s")}, "mean": (t @ np.array(r["mean"])).tolist(), "cov": (t @ np.array(r["cov"]).reshape(q, q) @ t.T).tolist(),
                            "d1": d[:, 0].tolist(), "d0": d[:, 1].tolist(), "v1": dc[:, 0].tolist(), "v0": dc[:, 1].tolist(), "v10": dc[:, 2].tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stats.mapInArrow(run, JOINT)


def contrast_draw_sums(data: DataFrame, coef: DataFrame, sources: Sequence[str], family: str, radius: float, b: int, seed: int, rule: str = "lasso", target_radius: float = C.RADIUS) -> DataFrame:
    """(outer_fold, fold, site, n, vec) of the folds that teach the weights: sums over rows of mass[draw] * (1, values, products), draw-major.

    Target values are the contrast's score and K predictions with all their products, source values the correction and its square."""
    rows, cells = _scored(data, coef.filter(F.col("fold") != F.col("outer_fold")), family, rule, target_radius, (radius,))
    k = len(sources)
    iu, ju = np.triu_indices(1 + k)

    def run(batches):
        acc: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for s, f, ids, scored in cells(batch):
                step = max(1, 4_000_000 // b)
                for lo in range(0, len(ids), step):
                    m = masses(ids[lo:lo + step], b, seed)
                    for o, v in scored:
                        v = v[lo:lo + step]
                        x = np.column_stack([v[:, 0] - v[:, 1], v[:, 2:2 + k] - v[:, 2 + k:]]) if s == C.TARGET else (v[:, 0] - v[:, 1])[:, None]
                        both = x[:, iu] * x[:, ju] if s == C.TARGET else x * x
                        u = np.concatenate([np.ones((len(x), 1)), x, both], axis=1)
                        n, total = acc.get((o, f, s), (0, 0.0))
                        acc[o, f, s] = n + len(x), total + m.T @ u
        for (o, f, s), (n, total) in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([f], pa.int32()), pa.array([s]), pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["outer_fold", "fold", "site", "n", "vec"])

    part = rows.mapInArrow(run, "outer_fold int, fold int, site string, n bigint, vec array<double>")
    g = part.groupBy("outer_fold", "fold", "site").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("vec")).alias("v"))
    return g.select("outer_fold", "fold", "site", "n", vector_to_array("v").alias("vec"))
