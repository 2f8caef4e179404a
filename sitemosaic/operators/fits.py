"""Nuisance fits: which rows, loss, row factor and penalty each model uses.

All models of a stage (site x arm x excluded folds x selection fold x penalty)
advance together, so a stage costs a handful of passes however many models it has.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..functions import linear_predictor, mean_response
from .gram import Model, accumulate, unpack
from .newton import Fitted, fit_models

COEF_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()), T.StructField("site", T.StringType()), T.StructField("arm", T.IntegerType()),
    T.StructField("drop", T.ArrayType(T.IntegerType())), T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("lambda", T.DoubleType()), T.StructField("rule", T.StringType()), T.StructField("converged", T.BooleanType()),
    T.StructField("iterations", T.IntegerType()), T.StructField("kkt", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("n_arm", T.LongType()), T.StructField("lambda_scaled", T.DoubleType())])

# key of a fit: (stage, site, arm, excluded folds)
Key = tuple[str, str, int, tuple[int, ...]]


def keys(stage: str, sites: Iterable[str], arms: Iterable[int], drops: Iterable[Sequence[int]]) -> list[Key]:
    return [(stage, s, a, tuple(sorted(d))) for s in sites for a in arms for d in sorted({tuple(sorted(x)) for x in drops})]


def coef_frame(spark: SparkSession, fits: Iterable[Fitted]) -> DataFrame:
    rows = [(*f.model.key[:2], int(f.model.key[2]), [int(x) for x in f.model.key[3]], [float(b) for b in f.beta], f.lam, f.rule, f.converged,
             f.iterations, f.kkt, int(f.n), int(f.n_arm), f.lam * f.n_arm / f.n) for f in fits]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def sites_of(data: DataFrame) -> list[str]:
    return sorted(r[0] for r in data.select("site").distinct().collect())


def _by_key(fits: list[Fitted]) -> dict[tuple, Fitted]:
    return {f.model.key[1:]: f for f in fits}


# -- moments of folds ------------------------------------------------------------------
class CellSums:
    """Row counts and feature sums per (site, arm, fold): every leave-fold-out mean is a difference of these."""

    def __init__(self, data: DataFrame, x: str = "z"):
        p = len(data.select(x).first()[0])
        rows = data.groupBy("site", "a", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(x)[j]).alias(f"s{j}") for j in range(p)]).collect()
        self.cells = {(r["site"], r["a"], r["fold"]): np.array([r["n"], *[r[f"s{j}"] for j in range(p)]], dtype=float) for r in rows}

    def mean(self, site: str, drop: Sequence[int] = (), arm: int | None = None, over_all: bool = False) -> np.ndarray:
        """(1, mean features) of the kept rows; with over_all, sums of one arm divided by the rows of both."""
        kept = [(k, v) for k, v in self.cells.items() if k[0] == site and k[2] not in drop]
        s = sum(v for k, v in kept if arm is None or k[1] == arm)
        n = sum(v[0] for k, v in kept) if over_all else s[0]
        return s / n


# -- generalised linear models ------------------------------------------------------------
def fit_glm(data: DataFrame, ks: list[Key], family: str, response: str = "y", x: str = "w", weight: bool = False) -> list[Fitted]:
    """Unpenalised maximum likelihood; an aliased design fails. Propensities use response a and all rows."""
    ms = [Model(k, None if k[1] == "*" else k[1], None if response == "a" else k[2], k[3], family=family, response=response, weight=weight) for k in ks]
    return fit_models(data, ms, x, lam=0.0, tol=1e-10)


def fit_lasso_glm(data: DataFrame, ks: list[Key], family: str, response: str = "y", x: str = "w", lam: float | None = None,
                  nlambda: int = C.LAMBDA_GRID_SIZE, rule: str = "min", cv_folds: int = C.CV_FOLDS, degenerate: str = "constant") -> list[Fitted]:
    """L1 fit on features scaled by the population sd of each model's own rows; penalty by cross-validation."""
    ms = [Model(k, None if k[1] == "*" else k[1], None if response == "a" else k[2], k[3], family=family, response=response) for k in ks]
    return fit_models(data, ms, x, lam=lam, standardize=True, nlambda=nlambda, rule=rule, cv_folds=cv_folds, min_class=C.MIN_CLASS_FOR_FIT,
                      degenerate=degenerate)


def fit_outcome(data: DataFrame, ks: list[Key], family: str, **kw) -> list[Fitted]:
    """Outcome regression on the rows of the arm; `lambda_scaled` of the table is the penalty times the arm fraction."""
    return fit_lasso_glm(data, ks, family, "y", **kw)


def fit_propensity(data: DataFrame, ks: list[Key], **kw) -> list[Fitted]:
    """P(a = 1) on all rows; too small a class fails."""
    return fit_lasso_glm(data, ks, "binomial", "a", degenerate="error", **kw)


def constant_fallback(obs: DataFrame, by: Sequence[str] = ("site", "a"), min_class: int = C.MIN_CLASS_FOR_FIT) -> DataFrame:
    """Outcome models that fall back to the constant mean because a class is too small."""
    ones = F.count_if(F.col("y") == 1)
    g = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"), F.avg("y").alias("mean"))
    return g.withColumn("degenerate", F.least(F.col("ones"), F.col("n") - F.col("ones")) < min_class)


# -- density ratios ------------------------------------------------------------------------
def fit_density_ratio(data: DataFrame, ks: list[Key], moments: dict[Key, np.ndarray], lam: float | None = None, radius: float = C.RADIUS,
                      x: str = "z", all_rows: bool = False, nlambda: int = C.LAMBDA_GRID_SIZE, rule: str = "min", cv_folds: int = C.CV_FOLDS,
                      floors: dict | None = None) -> list[Fitted]:
    """Exponential tilt exp(-z'g) of the arm's rows to the target moment; sums are divided by all source rows."""
    ms = [Model(k, k[1], None if all_rows else k[2], k[3], family="tilt", radius=radius) for k in ks]
    return fit_models(data, ms, x, lam=lam, moments=moments, norm="all", nlambda=nlambda, rule=rule, cv_folds=cv_folds, lambda_floor=floors,
                      tol=1e-10 if lam == 0.0 else C.SOLVER_TOL)


def target_moments(data: DataFrame, ks: list[Key], x: str = "z", target: str = C.TARGET) -> dict[Key, np.ndarray]:
    cells = CellSums(data.filter(F.col("site") == target), x)
    return {k: cells.mean(target, k[3]) for k in ks}


def fit_calibrated_propensity(data: DataFrame, ks: list[Key], lam: float | None = None, radius: float = C.RADIUS, **kw) -> list[Fitted]:
    """Tilt whose target is the opposite arm of the same rows: p_arm = logistic(z'g)."""
    cells = CellSums(data)
    return fit_density_ratio(data, ks, {k: cells.mean(k[1], k[3], arm=1 - k[2], over_all=True) for k in ks}, lam, radius, **kw)


def slope_moments(data: DataFrame, specs: list[tuple], family: str, radius: float, x: str = "z") -> list[tuple[np.ndarray, float]]:
    """For (site, arm or None, fold, coefficients, all folds): sum of slope(w'c) * (1, z) over that fold's rows, and the row count."""
    ms = [Model((i,), site, arm, tuple(f for f in folds if f != fold), family="gaussian", plug=((0, coef),), plug_kind="slope", plug_family=family,
                plug_radius=radius) for i, (site, arm, fold, coef, folds) in enumerate(specs)]
    p1 = len(specs[0][3])
    n_all, n_used, _, _, _, h = unpack(accumulate(data, ms, np.zeros((len(ms), p1)), x), p1)
    return [(h[i, 0], n_all[i]) for i in range(len(ms))]


def fit_calibrated_density_ratio(data: DataFrame, ks: list[Key], moments: dict, plugs: dict, family: str, lam: float | None = None,
                                 radius: float = C.RADIUS, truncate_plug: bool = True, calibrated: bool = True, x: str = "z", **kw) -> list[Fitted]:
    """Tilt with row factor slope(initial outcome predictor). plugs[key] = ((fold, coefficients), ...). calibrated=False: infinite radius."""
    r = radius if calibrated else float("inf")
    pr = radius if calibrated and truncate_plug else float("inf")
    ms = [Model(k, k[1], k[2], k[3], family="tilt", radius=r, plug=plugs[k], plug_kind="slope", plug_family=family, plug_radius=pr) for k in ks]
    return fit_models(data, ms, x, lam=lam, moments=moments, norm="all", **kw)


def fit_weighted_outcome(data: DataFrame, ks: list[Key], plugs: dict, family: str, lam: float | None = None, radius: float = C.RADIUS,
                         derivative: bool = False, calibrated: bool = True, x: str = "w", **kw) -> list[Fitted]:
    """Outcome regression weighted by the initial tilt (or its derivative, zero outside the radius)."""
    pr = radius if calibrated else float("inf")
    kind = "tilt_derivative" if derivative else "tilt"
    ms = [Model(k, k[1], k[2], k[3], family=family, plug=plugs[k], plug_kind=kind, plug_radius=pr) for k in ks]
    return fit_models(data, ms, x, lam=lam, norm="all", **kw)


# -- calibration programs -------------------------------------------------------------------
def _folds(data: DataFrame) -> list[int]:
    return sorted(r[0] for r in data.select("fold").distinct().collect())


def calibrate_source(data: DataFrame, sources: list[str], arms: Sequence[int], drops: list[tuple[int, ...]], family: str, mode: str = "one_round",
                     recipe: str = "legacy", radius: float = C.RADIUS, lam: float | None = None, folds: list[int] | None = None, **kw) -> dict[str, list[Fitted]]:
    """Fold-summed calibration for every (source, arm, excluded folds).

    For each calibration fold the initial outcome and tilt are trained on the other
    allowed folds and used as plug-ins on that fold's rows; one calibrated tilt and
    one weighted outcome are then fitted over all allowed folds. The target moment
    is the plain mean of the per-fold moments.
    """
    if mode not in ("one_round", "two_round") or recipe not in ("legacy", "score_derivative"):
        raise ValueError("unknown mode or recipe")
    folds = folds or _folds(data)
    drops = sorted({tuple(sorted(d)) for d in drops})
    allowed = {d: [f for f in folds if f not in d] for d in drops}
    init = sorted({tuple(sorted((*d, c))) for d in drops for c in allowed[d]})
    homes = [C.TARGET] if mode == "one_round" else sources
    or_init = fit_outcome(data, keys("or_init", homes, arms, init), family, lam=lam, **kw)
    dr_keys = keys("dr_init", sources, arms, init)
    dr_init = fit_density_ratio(data, dr_keys, target_moments(data, dr_keys), lam, radius, **kw)
    oi, di = _by_key(or_init), _by_key(dr_init)
    home = lambda s: C.TARGET if mode == "one_round" else s
    trunc = recipe == "legacy"
    specs, at = [], {}
    for h in homes:
        for a in arms:
            for d in drops:
                for c in allowed[d]:
                    at[(h, a, d, c)] = len(specs)
                    specs.append((C.TARGET, None, c, oi[(h, a, tuple(sorted((*d, c))))].beta, folds))
    sums = slope_moments(data, specs, family, radius if trunc else float("inf"))
    ck = keys("dr_cal", sources, arms, drops)
    moments, plugs = {}, {}
    for k in ck:
        _, s, a, d = k
        parts = [sums[at[(home(s), a, d, c)]] for c in allowed[d]]
        moments[k] = np.mean([m / n for m, n in parts], axis=0)
        plugs[k] = tuple((c, oi[(home(s), a, tuple(sorted((*d, c))))].beta) for c in allowed[d])
    dr_cal = fit_calibrated_density_ratio(data, ck, moments, plugs, family, lam, radius, truncate_plug=trunc, **kw)
    ok = keys("or_cal", sources, arms, drops)
    wplugs = {k: tuple((c, di[(k[1], k[2], tuple(sorted((*k[3], c))))].beta) for c in allowed[k[3]]) for k in ok}
    or_cal = fit_weighted_outcome(data, ok, wplugs, family, lam, radius, derivative=not trunc, **kw)
    return {"or_init": or_init, "dr_init": dr_init, "dr": dr_cal, "or": or_cal}


def calibrate_target(data: DataFrame, arms: Sequence[int], drops: list[tuple[int, ...]], family: str, init: str = "logistic", recipe: str = "legacy",
                     radius: float = C.RADIUS, lam: float | None = None, folds: list[int] | None = None, **kw) -> dict[str, list[Fitted]]:
    """Target-side calibration: initial propensity and outcome per fold, opposite-arm moment weighted by fold size."""
    folds = folds or _folds(data)
    t = data.filter(F.col("site") == C.TARGET)
    drops = sorted({tuple(sorted(d)) for d in drops})
    allowed = {d: [f for f in folds if f not in d] for d in drops}
    first = sorted({tuple(sorted((*d, c))) for d in drops for c in allowed[d]})
    or_init = fit_outcome(t, keys("or_init", [C.TARGET], arms, first), family, lam=lam, **kw)
    if init == "calibrated":
        ps_init = fit_calibrated_propensity(t, keys("ps_init", [C.TARGET], arms, first), lam, radius, **kw)
        ps = {k: f.beta for k, f in _by_key(ps_init).items()}
    else:
        ps_init = fit_propensity(t, keys("ps_init", [C.TARGET], (1,), first), lam=lam, **kw)
        # the arm-0 predictor is the mirrored one
        ps = {(s, a, d): f.beta * (1 if a == 1 else -1) for (s, _, d), f in _by_key(ps_init).items() for a in arms}
    oi, trunc = _by_key(or_init), recipe == "legacy"
    specs, at = [], {}
    for a in arms:
        for d in drops:
            for c in allowed[d]:
                at[(a, d, c)] = len(specs)
                specs.append((C.TARGET, 1 - a, c, oi[(C.TARGET, a, tuple(sorted((*d, c))))].beta, folds))
    sums = slope_moments(t, specs, family, radius if trunc else float("inf"))
    ck = keys("ps_cal", [C.TARGET], arms, drops)
    moments = {k: sum(sums[at[(k[2], k[3], c)]][0] for c in allowed[k[3]]) / sum(sums[at[(k[2], k[3], c)]][1] for c in allowed[k[3]]) for k in ck}
    plugs = {k: tuple((c, oi[(C.TARGET, k[2], tuple(sorted((*k[3], c))))].beta) for c in allowed[k[3]]) for k in ck}
    ps_cal = fit_calibrated_density_ratio(t, ck, moments, plugs, family, lam, radius, truncate_plug=trunc, **kw)
    ok = keys("or_cal", [C.TARGET], arms, drops)
    wplugs = {k: tuple((c, ps[(C.TARGET, k[2], tuple(sorted((*k[3], c))))]) for c in allowed[k[3]]) for k in ok}
    or_cal = fit_weighted_outcome(t, ok, wplugs, family, lam, radius, derivative=not trunc, **kw)
    return {"or_init": or_init, "ps_init": ps_init, "ps": ps_cal, "or": or_cal}


def fit_standard_source(data: DataFrame, sources: list[str], arms: Sequence[int], drops: list[tuple[int, ...]], family: str, radius: float = C.RADIUS,
                        lam: float | None = None, **kw) -> dict[str, list[Fitted]]:
    """Ordinary source program: balancing tilt and unweighted outcome on the allowed folds, no calibration."""
    dk = keys("dr_std", sources, arms, drops)
    dr = fit_density_ratio(data, dk, target_moments(data, dk), lam, radius, **kw)
    ok = keys("or_std", sources, arms, drops)
    zero = np.zeros(len(dr[0].beta))
    return {"dr": dr, "or": fit_weighted_outcome(data, ok, {k: ((0, zero),) for k in ok}, family, lam, calibrated=False, **kw)}


# -- table forms of the selection steps --------------------------------------------------------
def tilt_lambda_max(source: DataFrame, moment: DataFrame, arm: int, p: int, z: str = "z") -> DataFrame:
    """Smallest penalty at which a density-ratio fit is intercept-only, per site (one aggregate of the null gradient)."""
    on = lambda c: F.sum(F.when(F.col("a") == arm, c).otherwise(0.0)) / F.count(F.lit(1))
    s = source.groupBy("site").agg(F.array(on(F.lit(1.0)), *[on(F.col(z)[j]) for j in range(p)]).alias("s")).crossJoin(moment.select("moment"))
    e = F.col("moment")[0] / F.col("s")[0]
    g = [F.abs(F.col("moment")[j + 1] - e * F.col("s")[j + 1]) for j in range(p)]
    return s.select("site", F.greatest(F.lit(C.LAMBDA_FLOOR), *g).alias("lambda_max"))


def lambda_grid_table(lmax: DataFrame, n: int, ratio: float) -> DataFrame:
    i = F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i", "_v")
    return lmax.select("*", i).drop("_v").withColumn("lambda", F.exp(F.ln("lambda_max") + F.col("i") / F.lit(n - 1) * F.ln(F.lit(ratio))))


def select_lambda_table(scores: DataFrame, by: Sequence[str], folds: int, rule: str = "min") -> DataFrame:
    """(by..., lambda, fold, score) to the selected penalty per key, by combinable aggregates only."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    g = scores.withColumn("score", F.when(ok, F.col("score"))).groupBy(*by, "lambda").agg(
        F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.lit(folds))).alias("se"), F.count("score").alias("n")).filter(F.col("n") == folds)
    best = g.groupBy(*by).agg(F.min_by(F.struct("lambda", "mean", "se"), F.struct("mean", "lambda")).alias("b"))
    if rule == "min":
        return best.select(*by, F.col("b.lambda").alias("lambda"), F.col("b.mean").alias("mean"))
    j = g.join(best, list(by)).filter(F.col("mean") <= F.col("b.mean") + F.col("b.se"))
    return j.groupBy(*by).agg(F.max_by(F.struct("lambda", "mean"), F.col("lambda")).alias("s")).select(*by, "s.lambda", "s.mean")


def heldout_loss(obs: DataFrame, coef: DataFrame, on: Sequence[str], p: int, loss: str, x: str = "w") -> DataFrame:
    """Mean held-out loss per key: deviance of a GLM, or the density-ratio loss with the key's target moment."""
    j = obs.join(coef, list(on))
    eta = linear_predictor(x, "beta", p)
    if loss == "gaussian":
        v = F.avg((F.col("y") - eta) * (F.col("y") - eta))
    elif loss == "binomial":
        mu = mean_response(eta, "binomial")
        v = F.avg(-2 * (F.col("y") * F.ln(mu) + (1 - F.col("y")) * F.ln(1 - mu)))
    else:
        v = F.avg(F.when(F.col("a") == F.col("arm"), F.exp(-eta)).otherwise(0.0)) + F.first(sum(
            [F.col("moment")[i] * F.col("beta")[i] for i in range(1, p + 1)], F.col("moment")[0] * F.col("beta")[0]))
    return j.groupBy(*on).agg(v.alias("loss"))
