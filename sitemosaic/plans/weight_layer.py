"""Diagnostic variance of the learned aggregation weights.

The weights of an outer fold solve a small problem whose inputs are pooled moments M of the inner rows. By the chain rule the
result moves with a row's mass by the sum over moments of dJ/dM * (f_M(row) - M) / n, where f_M(row) is the row's own term in M:
a square or product of centred scores, or a score. So the derivatives dJ/dM are a few numbers per outer fold, and a row's gradient is
a quadratic polynomial in its scores, evaluated as one column expression.
The reported standard error does not use it.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..operators.joins import settled, sized
from ..operators.moments import fold_moments, pool_moments
from ..operators.scores import long_arms
from ..operators.weights import quadratic_form, solve_weights
from .crossfit import Saved, inner_moments, pseudo_values, split_scores

ACTIVE = 1e-10
POLYNOMIAL = "outer_fold int, fold int, site string, centre double, square double, slope double, shift double, psi_centre array<double>, mixed array<double>, pairs array<array<double>>, psi_slope array<double>, n double"


def moment_derivatives(r, gain: np.ndarray, lam: float, rule: str) -> tuple[dict, int]:
    """dJ/dM for one row of pooled moments and solved weights; gain is dJ/d(weights). Also the number of penalties at their kink."""
    k = len(gain)
    unit = {"n_t": r.n_t, "n_s": r.n_s, "v_ot": 0.0, "v_t": np.zeros(k), "v_s": np.zeros(k), "c_ot": np.zeros(k), "c_cross": np.zeros((k, k))}
    here = pd.DataFrame([{c: getattr(r, c) for c in unit}])
    q, _, n_all = (x[0] for x in quadratic_form(here))
    spread, gap = np.diag(q).copy(), np.array(r.mu_s) - r.mu_t
    rate = float(r.n_t) ** (C.QUADRATIC_BIAS_POWER - 1) if rule == "quadratic_bias" else 0.0
    on = np.ones(k, bool) if rule == "quadratic_bias" else np.abs(np.array(r.eta)) > ACTIVE
    eta = np.where(on, np.array(r.eta), 0.0)
    # an active weight answers a change of its stationarity equation through the inverse of the active block
    back = np.zeros(k)
    back[on] = np.linalg.solve((q + np.diag(rate * gap ** 2))[np.ix_(on, on)], gain[on]) if on.any() else 0.0
    wald, root = np.array(r.wald), np.sqrt(np.maximum(spread, C.VARIANCE_FLOOR))
    pull = back * np.sign(eta) * (lam * (lam * wald > 1) / (2 * n_all) if rule == "soft_penalty" else 0.0)
    on_gap = pull * np.sign(gap) / root + 2 * rate * back * gap * eta
    on_spread = np.where(spread >= C.VARIANCE_FLOOR, -pull * np.abs(gap) / (2 * root ** 3), 0.0)
    # the quadratic and linear terms are linear in the moments: their derivatives are their values at unit moments
    names, rows = [], []
    for name, at in [("v_ot", None), *((c, i) for c in ("v_t", "v_s", "c_ot") for i in range(k)), *(("c_cross", (i, j)) for i in range(k) for j in range(i + 1, k))]:
        row = {c: np.copy(v) if isinstance(v, np.ndarray) else v for c, v in unit.items()}
        if at is None:
            row[name] = 1.0
        elif name == "c_cross":
            row[name][at] = row[name][at[::-1]] = 1.0
        else:
            row[name][at] = 1.0
        names.append((name, at))
        rows.append(row)
    uq, ul, _ = quadratic_form(pd.DataFrame(rows))
    value = -(np.einsum("j,mjl,l->m", back, uq, eta) + ul @ back + np.einsum("mjj,j->m", uq, on_spread))
    out = {"v_ot": 0.0, "v_t": np.zeros(k), "v_s": np.zeros(k), "c_ot": np.zeros(k), "c_cross": np.zeros((k, k)), "gap": -on_gap}
    for (name, at), v in zip(names, value):
        if at is None:
            out[name] = v
        elif name == "c_cross":
            out[name][at] = out[name][at[::-1]] = v / 2
        else:
            out[name][at] = v
    return out, int((np.abs(lam * wald - 1) < 1e-6).sum()) if rule != "quadratic_bias" else 0


def polynomials(saved: Saved, arm: int, lam: float, rule: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(weights, coefficients of the row gradient by outer fold, fold and site, their number, kinks): folds^2 x sites small rows."""
    if lam == "cv":
        raise ValueError("the weight layer needs a fixed cutoff")
    k = len(saved.sources)
    inner = settled(inner_moments(saved, (arm,)))
    w = settled(solve_weights(pool_moments(inner, k), lam, rule))
    outer = fold_moments(long_arms(split_scores(saved.scores)[0], (arm,)), saved.sources, ("arm", "outer_fold"), floor=False).toPandas().set_index("outer_fold")
    sizes = np.array([saved.sizes[s] for s in saved.sources], dtype=float)
    centres, rows, kinks = inner.toPandas(), [], 0
    for r in w.toPandas().itertuples():
        if r.psd_ridge > 0:
            raise ValueError("the weight derivative is not available when the ridge is active")
        o = outer.loc[r.outer_fold]
        gain = o.n_t * (np.array(o.mu_pred) - o.mu_t) / saved.sizes[C.TARGET] + np.array(o.n_s) * np.array(o.delta) / sizes
        d, at_kink = moment_derivatives(r, gain, lam, rule)
        kinks += at_kink
        cross = np.array([list(x) for x in r.c_cross])
        pairs, gap = d["c_cross"] + np.diag(d["v_t"]), d["gap"]
        mean = d["v_ot"] * r.v_ot + d["c_ot"] @ np.array(r.c_ot) + d["v_t"] @ np.array(r.v_t) + (d["c_cross"] * cross).sum() + gap @ np.array(r.mu_pred) - gap.sum() * r.mu_t
        for c in centres[centres.outer_fold == r.outer_fold].itertuples():
            rows.append((int(r.outer_fold), int(c.fold), C.TARGET, float(c.mu_t), float(d["v_ot"]), float(-gap.sum()), float(-mean), [float(x) for x in c.mu_pred], d["c_ot"].tolist(), pairs.tolist(), gap.tolist(), float(r.n_t)))
            for j, s in enumerate(saved.sources):
                rows.append((int(r.outer_fold), int(c.fold), s, float(c.delta[j]), float(d["v_s"][j]), float(gap[j]), float(-d["v_s"][j] * r.v_s[j] - gap[j] * r.delta[j]), None, None, None, None, float(r.n_s[j])))
    return w, saved.scores.sparkSession.createDataFrame(rows, POLYNOMIAL), len(rows), kinks


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def weight_gradients(saved: Saved, arm: int = 2, lam: float = C.WALD_LAMBDA, rule: str = "soft_penalty") -> tuple[DataFrame, DataFrame, int]:
    """(obs_id, site, gradient), the weights, and the number of kinks; gradients sum to zero within a site."""
    w, table, n, kinks = polynomials(saved, arm, lam, rule)
    k = len(saved.sources)
    _, inner = split_scores(saved.scores)
    rows = long_arms(inner, (arm,)).select("obs_id", "site", "fold", "outer_fold", "phi", "psi", "corr").join(sized(table, n, 8 * (k + 3) ** 2 + 64), ["outer_fold", "fold", "site"])
    target = F.col("site") == C.TARGET
    own = F.when(target, F.col("phi")).otherwise(F.col("corr"))
    c = own - F.col("centre")
    psi = F.zip_with("psi", "psi_centre", lambda x, m: x - m)
    products = _dot(psi, F.zip_with("mixed", "pairs", lambda m, p: m * c + _dot(p, psi))) + _dot(F.col("psi_slope"), F.col("psi"))
    value = F.col("square") * c * c + F.col("slope") * own + F.col("shift") + F.when(target, products).otherwise(0.0)
    g = rows.select("obs_id", "site", (value / F.col("n")).alias("gradient")).groupBy("obs_id", "site").agg(F.sum("gradient").alias("gradient"))
    return g, w, kinks


def weight_layer(saved: Saved, arm: int = 2, lam: float = C.WALD_LAMBDA, rule: str = "soft_penalty") -> DataFrame:
    """One row: leading variance, diagnostic variance with the weight layer, its parts, and the largest site sum (zero up to rounding)."""
    g, w, kinks = weight_gradients(saved, arm, lam, rule)
    outer, _ = split_scores(saved.scores)
    pseudo = pseudo_values(long_arms(outer, (arm,)), w, saved.sources, saved.sizes, n_eta=saved.options.k).select("obs_id", "site", "value")
    m = pseudo.groupBy("site").agg(F.avg("value").alias("_m"))
    j = pseudo.join(F.broadcast(settled(m)), "site").join(g, ["obs_id", "site"], "left")
    d, i = (F.col("value") - F.col("_m")) / float(saved.n_all), F.coalesce("gradient", F.lit(0.0))
    s = j.groupBy("site").agg(F.sum(d * d).alias("fixed"), F.sum(i * i).alias("indirect"), F.sum(d * i).alias("cross"), F.abs(F.sum(i)).alias("site_sum"))
    return s.agg(F.sum("fixed").alias("variance_fixed"), (F.sum("fixed") + F.sum("indirect") + 2 * F.sum("cross")).alias("variance_adjusted"), F.sum("indirect").alias("indirect_variance"),
                 (2 * F.sum("cross")).alias("cross_term"), F.max("site_sum").alias("max_site_sum"), F.lit(kinks).alias("kink_cells"))
