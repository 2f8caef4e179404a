"""Aggregation weights: small K-dimensional problems, one per moments row, solved where the rows are."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions import clip
from .newton import kkt_residual, quadratic_l1

RULES = ("soft_penalty", "hard_threshold", "quadratic_bias")


# -- expressions on a moments row ------------------------------------------------------
def wald_discrepancy(moments: DataFrame, lam=C.WALD_LAMBDA) -> DataFrame:
    """Adds wald[j] = |target - source_j| / se and penalty[j] = max(lam * wald - 1, 0)."""
    n = F.col("n_t")
    i = F.sequence(F.lit(0), F.size("mu_s") - 1)
    var = lambda j: (F.col("v_ot") + F.get("v_t", j) - 2 * F.get("c_ot", j)) / n + F.get("v_s", j) / F.greatest(F.get("n_s", j), F.lit(1))
    t = F.transform(i, lambda j: F.abs(F.col("mu_t") - F.get("mu_s", j)) / F.sqrt(F.greatest(var(j), F.lit(C.VARIANCE_FLOOR))))
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return moments.withColumn("wald", t).withColumn("penalty", F.transform("wald", lambda v: F.greatest(lam * v - 1, F.lit(0.0))))


def _sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def aggregate_variance(moments: DataFrame, eta: str = "eta", out: str = "variance", floor: float = C.VARIANCE_FLOOR) -> DataFrame:
    """Variance of the weighted estimate and the estimate itself on each moments row."""
    e, n = F.col(eta), F.col("n_t")
    i = F.sequence(F.lit(0), F.size(e) - 1)
    rest = 1 - _sum(e)
    own = _sum(F.transform(i, lambda j: F.get(e, j) * F.get(e, j) * (F.get("v_t", j) / n + F.get("v_s", j) / F.greatest(F.get("n_s", j), F.lit(1)))
                           + 2 * F.get(e, j) * rest * F.get("c_ot", j) / n))
    # the cross matrix has a zero diagonal: the full double sum counts each pair twice
    cross = _sum(F.transform(i, lambda j: F.get(e, j) * _sum(F.zip_with(e, F.get("c_cross", j), lambda x, c: x * c)) / n))
    var = rest * rest * F.col("v_ot") / n + own + cross
    est = rest * F.col("mu_t") + _sum(F.zip_with(e, "mu_s", lambda x, m: x * m))
    return moments.withColumns({out: F.greatest(var, F.lit(floor)), "estimate": est})


# -- solvers ---------------------------------------------------------------------------
def _stack(pdf: pd.DataFrame, name: str) -> np.ndarray:
    v = pdf[name].to_list()
    return np.array([[list(r) for r in m] for m in v] if name == "c_cross" or name == "q" else [list(m) for m in v], dtype=float)


def quadratic_form(pdf: pd.DataFrame):
    """Q, l and N of n * variance = const + 2 l'eta + eta'Q eta for every row."""
    vt, vs, ns, co, cr = (_stack(pdf, c) for c in ("v_t", "v_s", "n_s", "c_ot", "c_cross"))
    vo, nt = pdf["v_ot"].to_numpy(float), pdf["n_t"].to_numpy(float)
    ns = np.maximum(ns, 1.0)
    q = (vo[:, None, None] - co[:, :, None] - co[:, None, :] + (cr + cr.transpose(0, 2, 1)) / 2) / nt[:, None, None]
    k = vt.shape[1]
    q[:, range(k), range(k)] = (vo[:, None] - 2 * co + vt) / nt[:, None] + vs / ns
    return q, (co - vo[:, None]) / nt[:, None], nt + ns.sum(axis=1)


def solve_quadratic(q, l, pen, include=None):
    """argmin eta'Q eta + 2 l'eta + pen|eta| per problem, with a relative ridge when Q is not positive definite."""
    h, g = 2 * q, 2 * l
    k = l.shape[1]
    ev = np.linalg.eigvalsh((h + h.transpose(0, 2, 1)) / 2)
    margin = 1e-10 * np.abs(ev).max(axis=1)
    ridge = np.where(ev[:, 0] < margin, margin - ev[:, 0], 0.0)
    h = h + ridge[:, None, None] * np.eye(k)
    eta = np.zeros_like(l)
    for i in range(len(l)):
        act = np.flatnonzero(include[i]) if include is not None else np.arange(k)
        if not len(act):
            continue
        hh, gg, pp = h[i][np.ix_(act, act)], g[i, act], pen[i, act]
        if not pp.any():
            eta[i, act] = np.linalg.solve(hh, -gg)
        else:
            # unit diagonal makes the sweep tolerance scale-free
            d = np.sqrt(np.diag(hh))
            b = quadratic_l1(np.zeros((1, len(act))), (gg / d)[None], (hh / np.outer(d, d))[None], (pp / d)[None], sweeps=C.SOLVER_MAX_ITER, tol=1e-14)[0]
            eta[i, act] = b / d
    grad = np.einsum("mjk,mk->mj", h, eta) + g
    if include is not None:
        grad = np.where(include, grad, 0.0)
    return eta, ridge, kkt_residual(eta, grad, pen)


def _solve_frame(pdf: pd.DataFrame, rule: str, clip_weights: bool) -> pd.DataFrame:
    q, l, n = quadratic_form(pdf)
    lam = pdf["lam"].to_numpy(float)
    wald = _stack(pdf, "wald")
    disc = _stack(pdf, "mu_s") - pdf["mu_t"].to_numpy(float)[:, None]
    include = np.ones_like(l, dtype=bool)
    pen = np.zeros_like(l)
    if rule == "soft_penalty":
        pen = np.maximum(lam[:, None] * wald - 1, 0.0) / n[:, None]
    elif rule == "hard_threshold":
        if (lam <= 0).any():
            raise ValueError("hard thresholding needs a positive lambda")
        include = wald <= 1 / lam[:, None]
    else:
        nt = pdf["n_t"].to_numpy(float)
        k = l.shape[1]
        q = q.copy()
        q[:, range(k), range(k)] += nt[:, None] ** (C.QUADRATIC_BIAS_POWER - 1) * disc ** 2
    eta, ridge, kkt = solve_quadratic(q, l, pen, include)
    if clip_weights:
        eta = np.clip(eta, 0.0, 1.0)
    return pdf.assign(eta=list(eta), included=[list(map(bool, r)) for r in include], psd_ridge=ridge, kkt=kkt)


def solve_weights(moments: DataFrame, lam=C.WALD_LAMBDA, rule: str = "soft_penalty", clip: bool = False) -> DataFrame:
    """Adds lam, wald, penalty, eta, included, psd_ridge, kkt to every moments row.

    lam is a number or a column of the row, so folds, draws and cutoffs are solved together.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    m = moments.withColumn("lam", F.col(lam).cast("double") if isinstance(lam, str) else F.lit(float(lam)))
    m = wald_discrepancy(m, F.col("lam"))
    ad = T.ArrayType(T.DoubleType())
    schema = T.StructType(m.schema.fields + [T.StructField("eta", ad), T.StructField("included", T.ArrayType(T.BooleanType())),
                                             T.StructField("psd_ridge", T.DoubleType()), T.StructField("kkt", T.DoubleType())])
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield _solve_frame(pdf, rule, clip)[names]

    return m.mapInPandas(run, schema)


def solve_joint_weights(joint: DataFrame, lam=C.WALD_LAMBDA, rule: str = "soft_penalty") -> DataFrame:
    """2K weights of both arms from one quadratic per row (treated first)."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    m = joint.withColumn("lam", F.col(lam).cast("double") if isinstance(lam, str) else F.lit(float(lam)))
    ad = T.ArrayType(T.DoubleType())
    schema = T.StructType(m.schema.fields + [T.StructField("wald", ad), T.StructField("penalty", ad), T.StructField("eta", ad),
                                             T.StructField("included", T.ArrayType(T.BooleanType())), T.StructField("kkt", T.DoubleType())])

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            q, l, disc = _stack(pdf, "q"), _stack(pdf, "l"), _stack(pdf, "discrepancy")
            la, n = pdf["lam"].to_numpy(float)[:, None], pdf["n_all"].to_numpy(float)[:, None]
            wald = np.abs(disc) / np.sqrt(np.maximum(np.einsum("mjj->mj", q), C.VARIANCE_FLOOR))
            pen = np.maximum(la * wald - 1, 0.0)
            inc = np.ones_like(wald, dtype=bool)
            if rule == "hard_threshold":
                inc, pen = wald <= 1 / la, np.zeros_like(wald)
            elif rule == "quadratic_bias":
                k = l.shape[1]
                q[:, range(k), range(k)] += pdf["n_t"].to_numpy(float)[:, None] ** (C.QUADRATIC_BIAS_POWER - 1) * disc ** 2
                pen = np.zeros_like(wald)
            eta, ridge, kkt = solve_quadratic(q, l, pen / n, inc)
            if (ridge > 0).any():
                raise ValueError("the two-arm quadratic is not positive definite")
            yield pdf.assign(wald=list(wald), penalty=list(pen), eta=list(eta), included=[list(map(bool, r)) for r in inc], kkt=kkt)

    return m.mapInPandas(run, schema)


def select_weight_lambda(inner: DataFrame, grid: Sequence[float], rule: str = "min", screening: str = "soft_penalty", keys=("arm", "outer_fold"), k: int = 1) -> DataFrame:
    """Penalty by inner-fold validation: learn on the other inner folds, score N * variance on the held-out one.

    Fold x penalty problems are rows of one table.
    """
    from .fits import select_lambda_table
    from .moments import pool_moments
    keys = list(keys)
    held = inner.select(*keys, F.col("fold").alias("held")).distinct()
    train = inner.join(held, keys).filter(F.col("fold") != F.col("held"))
    pooled = pool_moments(train, k, [*keys, "held"])
    pooled = pooled.withColumn("lam_try", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    eta = solve_weights(pooled, "lam_try", screening).select(*keys, "held", "lam_try", "eta")
    val = inner.withColumnRenamed("fold", "held").join(eta, [*keys, "held"])
    total = F.col("n_t") + F.aggregate("n_s", F.lit(0).cast("long"), lambda s, v: s + v)
    scored = aggregate_variance(val).withColumn("score", F.col("variance") * total)
    n = inner.select("fold").distinct().count() - (1 if "outer_fold" in keys else 0)
    return select_lambda_table(scored.select(*keys, F.col("lam_try").alias("lambda"), F.col("held").alias("fold"), "score"), keys, n, rule)


def aggregation_lambda_max(moments: DataFrame) -> DataFrame:
    """Diagnostic: penalty scale at which every weight is zero, from the gradient at zero."""
    i = F.sequence(F.lit(0), F.size("mu_s") - 1)
    v = lambda x: clip(x, -1e6, 1e6)
    # fixed value: estimates and covariances are bounded at 1e6 here
    r = F.transform(i, lambda j: F.abs(2 * (v(F.get("c_ot", j)) - F.greatest(F.col("v_ot"), F.lit(C.VARIANCE_FLOOR))) / F.col("n_t"))
                    / F.pow(v(F.col("mu_t")) - v(F.get("mu_s", j)), F.lit(2.0)))
    return moments.withColumn("lambda_max", F.array_max(F.filter(r, lambda x: (x < float("inf")) & ~F.isnan(x))))
