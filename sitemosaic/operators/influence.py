"""Influence values of weighted estimators, adjusted for the fitted nuisances.

Sensitivities and information matrices are sums over rows (one grouped pass and
one Gram pass); the p x p solve uses only those sums; corrections come back to
the rows as column expressions.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from ..functions import clip, clip_outcome, clip_propensity, linear_predictor, mean_response, mean_slope
from .fits import coef_frame, fit_density_ratio, keys, target_moments  # noqa: F401
from .gram import Model, accumulate, unpack
from .joins import sized
from .newton import Fitted

ACTIVE = 1e-12


class CurvatureError(ValueError):
    pass


def solve_ridge(m: np.ndarray, rhs: np.ndarray, ridge: float = C.RIDGE) -> np.ndarray:
    """Solve with a fixed ridge; a singular system fails instead of falling back to another solver."""
    r = m + ridge * np.eye(len(m))
    if not np.isfinite(r).all() or np.linalg.cond(r) > 1e15:
        raise CurvatureError("ridge-regularised system is singular; inspect the design for collinearity")
    return np.linalg.solve(r, rhs)


# Directions below the first are redundant columns; a kept one below the second makes the correction unstable; a derivative
# may lie in the redundant space up to the third.
REDUNDANT, STABLE, COMPATIBLE = 100 * np.finfo(float).eps, 1e-7, 1e-8


def design_factors(data: DataFrame, groups: list[tuple], p: int, x: str = "w", spread: int = 64) -> list[np.ndarray]:
    """Triangular factors of the designs [1, x] of (site or None, arm or None) groups, by a tree of orthogonal factorisations.

    Tasks reduce their rows to one (p+1) x (p+1) factor per group; factors are stacked and factored again over `spread` slices, then once
    per group. Unlike a Gram matrix, a factor shows singular values down to rounding, and no rows are moved.
    """
    width = p + 1

    def stack(held, rows):
        rows = rows if held is None else np.concatenate([held, rows])
        return np.linalg.qr(rows, mode="r") if len(rows) > width else rows

    def emit(held):
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([TaskContext.get().partitionId() % spread] * len(keys), pa.int32()), pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], ["g", "slice", "factor"])

    def local(batches):
        held = {}
        for b in batches:
            if b.num_rows:
                m = np.concatenate([np.ones((b.num_rows, 1)), b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)], axis=1)
                site, arm = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy(zero_copy_only=False)
                for k, (s, a) in enumerate(groups):
                    mine = (np.ones(len(m), bool) if s is None else site == s) & (True if a is None else arm == a)
                    if mine.any():
                        held[k] = stack(held.get(k), m[mine])
        yield from emit(held)

    def merge(batches):
        held = {}
        for b in batches:
            for k, f in zip(b.column(0).to_pylist(), b.column(2)):
                held[k] = stack(held.get(k), np.array(f.values).reshape(-1, width))
        yield from emit(held)

    schema = "g int, slice int, factor array<double>"
    out = [np.zeros((0, width))] * len(groups)
    tree = data.select("site", "a", F.col(x).alias("x")).mapInArrow(local, schema).repartition(spread, "g", "slice").mapInArrow(merge, schema)
    for r in tree.repartition("g").mapInArrow(merge, schema).collect():
        out[r["g"]] = np.array(r["factor"]).reshape(-1, width)
    return out


def solve_curvature(gram: np.ndarray, factor: np.ndarray, rhs: np.ndarray, checks: tuple = ()) -> tuple[np.ndarray, dict]:
    """Direction gram^-1 rhs within the space that the design identifies.

    `factor` is the triangular factor of the design, intercept first; `gram` the mean weighted Gram of the same columns. An orthogonal
    factorisation has taken the intercept out of the other columns already, so their centred, scaled singular values are those of
    the lower block with columns of unit length.
    """
    p = len(rhs)
    lower = np.linalg.qr(factor, mode="r")[1:, 1:]
    length = np.sqrt((lower ** 2).sum(0))
    whole = np.sqrt((factor[:, 1:] ** 2).sum(0))
    scale = np.where(length > 1e-12 * whole, length, np.where(whole > 0, whole, 1.0))  # of a constant column only rounding is left
    mean = factor.T @ factor[:, :1]
    mean = mean[1:, 0] / mean[0, 0]
    change = np.eye(p)                      # columns: intercept; centred and scaled features
    change[0, 1:] = -mean / scale
    change[range(1, p), range(1, p)] = 1 / scale
    _, size, axes = np.linalg.svd(np.concatenate([lower / scale, np.zeros((max(0, p - 1 - len(lower)), p - 1))]))
    size = np.concatenate([[1.0], size])    # the intercept is orthogonal to the centred columns
    space = np.zeros((p, p))
    space[0, 0] = 1.0
    space[1:, 1:] = axes.T
    size = size / size.max()
    kept = size > REDUNDANT * p
    if (size[kept] < STABLE).any():
        raise CurvatureError("columns are nearly, but not exactly, redundant: the correction would be unstable")
    for v in (rhs, *checks):
        u = space.T @ (change.T @ v)
        if np.linalg.norm(u[~kept]) > COMPATIBLE * np.linalg.norm(u):
            raise CurvatureError("a derivative is not identified: it leaves the space that the design spans")
    basis = change @ space[:, kept]
    h = basis.T @ gram @ basis
    ev = np.linalg.eigvalsh((h + h.T) / 2)
    if not np.isfinite(ev).all() or ev[0] <= 0 or np.sqrt(ev[0] / ev[-1]) < STABLE:
        raise CurvatureError("the curvature is unstable in the identified space")
    return basis @ np.linalg.solve(h, basis.T @ rhs), {"solver": "full" if kept.all() else "identifiable_subspace", "active_columns": p, "rank": int(kept.sum()), "curvature_ratio": float(np.sqrt(ev[0] / ev[-1]))}


def _vectors(spark, table: dict, names: list[str]) -> DataFrame:
    """(g, name...) with double or array<double> columns from a small driver dict."""
    first = next(iter(table.values()))
    fields = [T.StructField("g", T.StringType())] + [T.StructField(n, T.ArrayType(T.DoubleType()) if isinstance(first[n], (list, np.ndarray)) else T.DoubleType()) for n in names]
    conv = lambda v: [float(u) for u in v] if isinstance(v, (list, np.ndarray)) else float(v)
    return spark.createDataFrame([(g, *[conv(v[n]) for n in names]) for g, v in table.items()], T.StructType(fields))


def _x(p: int, x: str = "w") -> list[Column]:
    return [F.lit(1.0)] + [F.col(x)[j] for j in range(p)]


def _dotx(dir_: str, p: int, x: str = "w") -> Column:
    return linear_predictor(x, dir_, p)


# -- density weights --------------------------------------------------------------------
def site_weights(data: DataFrame, tilts: dict[str, np.ndarray], p: int) -> DataFrame:
    """Adds tilt_eta and raw_weight: exp(-tilt_eta) shifted by the site's maximum, floored, with mean one per site.

    Maxima and means are a number per site and come back to the rows in the table of the tilts: the rows stay one scan without a shuffle,
    which every reader can repeat, instead of a join of the rows with themselves that has to be held.
    """
    rows, table, eta = data.drop("weight"), {s: {"tilt": b} for s, b in tilts.items()}, linear_predictor("z", "tilt", p)
    weight = F.exp(F.greatest(-eta - F.col("_top"), F.lit(C.LOG_SMALLEST_NORMAL)))

    def joined(*names):
        tab = _vectors(data.sparkSession, table, ["tilt", *names]).withColumnRenamed("g", "site")
        return rows.join(sized(tab, len(table), 8 * (p + 6)), "site")

    top = {r["site"]: r["v"] for r in joined().groupBy("site").agg(F.max(-eta).alias("v")).collect()}
    table = {s: table[s] | {"_top": v} for s, v in top.items()}
    mean = {r["site"]: r["v"] for r in joined("_top").groupBy("site").agg(F.avg(weight).alias("v")).collect()}
    table = {s: table[s] | {"_mean": v} for s, v in mean.items()}
    return joined("_top", "_mean").withColumn("tilt_eta", eta).withColumn("raw_weight", weight / F.col("_mean")).drop("tilt", "_top", "_mean")


def density_ratio_weights(data: DataFrame, sources: list[str], lam: float | None = None, **kw) -> tuple[DataFrame, list[Fitted]]:
    """All-row tilt of each source to the target: adds tilt_eta, raw_weight (mean one) and weight (clipped); target rows weigh 1."""
    ks = keys("dr", sources, (1,), [()])
    fits = fit_density_ratio(data, ks, target_moments(data, ks), lam, float("inf"), all_rows=True, **kw)
    p = len(fits[0].beta) - 1
    rows = site_weights(data, {f.model.site: f.beta for f in fits} | {C.TARGET: np.zeros(p + 1)}, p)
    t = F.col("site") == C.TARGET
    return rows.withColumn("weight", F.when(t, 1.0).otherwise(clip("raw_weight", *C.DR_WEIGHT_CLIP))), fits


# -- weighted AIPW ------------------------------------------------------------------------
def aipw_rows(rows: DataFrame, ps: dict[str, Fitted], orr: dict[str, Fitted], p: int, family: str, arm: int) -> DataFrame:
    """Adds raw_ps, raw_or, m, prob, phi for the models of each row's group g."""
    tab = _vectors(rows.sparkSession, {g: {"ps_b": ps[g].beta, "or_b": orr[g].beta} for g in ps}, ["ps_b", "or_b"])
    j = rows.join(sized(tab, len(ps), 16 * (p + 4)), "g")
    j = j.withColumns({"raw_ps": mean_response(linear_predictor("w", "ps_b", p), "binomial"), "raw_or": mean_response(linear_predictor("w", "or_b", p), family)})
    pi = clip_propensity("raw_ps")
    j = j.withColumns({"m": clip_outcome("raw_or", family), "prob": pi if arm == 1 else 1 - pi, "sel": (F.col("a") == arm).cast("double")})
    return j.withColumn("phi", F.col("m") + F.col("sel") * (F.col("y") - F.col("m")) / F.col("prob")).drop("ps_b", "or_b")


def weighted_aipw(data: DataFrame, rows: DataFrame, ps: dict[str, Fitted], orr: dict[str, Fitted], p: int, family: str, arm: int,
                  pooled: bool = False, keep: bool = True) -> tuple[DataFrame, dict[str, dict]]:
    """Rows with `influence` and `phi`, and per group: estimate, variance, n, normalizer.

    data: the cached rows the models were fitted on. rows: the same rows with a
    `weight`; groups are sites, or all rows together when pooled. keep=False: the
    rows are not cached, as reading `rows` again costs no more than a scan.
    """
    rows = rows.withColumn("g", F.lit("*") if pooled else F.col("site"))
    r = aipw_rows(rows, ps, orr, p, family, arm)
    w, sel, prob = F.col("weight"), F.col("sel"), F.col("prob")
    inside_o = ((F.col("raw_or") > C.OUTCOME_CLIP[0]) & (F.col("raw_or") < C.OUTCOME_CLIP[1])).cast("double") if family == "binomial" else F.lit(1.0)
    slope_o = F.col("raw_or") * (1 - F.col("raw_or")) if family == "binomial" else F.lit(1.0)
    so = w * (1 - sel / prob) * inside_o
    inside_p = ((F.col("raw_ps") > C.PROPENSITY_CLIP[0]) & (F.col("raw_ps") < C.PROPENSITY_CLIP[1])).cast("double")
    sp = w * (-1.0 if arm == 1 else 1.0) * sel * (F.col("y") - F.col("m")) / (prob * prob) * F.col("raw_ps") * (1 - F.col("raw_ps")) * inside_p
    xs = _x(p)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(sel).alias("n_sel"), F.avg(w).alias("d"), F.avg(w * F.col("phi")).alias("wphi"), F.avg(so).alias("so_plain"),
            F.avg(F.when(sel == 1, F.col("y"))).alias("ybar")]
    for i, x in enumerate(xs):
        aggs += [F.avg(so * slope_o * x).alias(f"so{i}"), F.avg(sp * x).alias(f"sp{i}"), F.avg(x).alias(f"ma{i}"), F.var_pop(x).alias(f"va{i}"),
                 F.avg(F.when(sel == 1, x)).alias(f"ms{i}"), F.var_pop(F.when(sel == 1, x)).alias(f"vs{i}")]
    stats = {s["g"]: s for s in r.groupBy("g").agg(*aggs).collect()}
    gs = sorted(stats)
    sp_models = [Model(("ps", g), None if pooled else g, None, family="binomial", response="a") for g in gs]
    or_models = [Model(("or", g), None if pooled else g, arm, family=family) for g in gs]
    beta = np.stack([ps[g].beta for g in gs] + [orr[g].beta for g in gs])
    both = sp_models + or_models
    _, nu, _, _, grad, hess = unpack(accumulate(data, both, beta, "w"), p + 1)
    design = design_factors(data, [(m.site, m.arm) for m in both], p, "w")
    out, table = {}, {}
    for i, g in enumerate(gs):
        s, vec = stats[g], {}
        for kind, k, f, sens, mean, var in (("ps", i, ps[g], [s[f"sp{j}"] for j in range(p + 1)], "ma", "va"),
                                            ("or", i + len(gs), orr[g], [s[f"so{j}"] for j in range(p + 1)], "ms", "vs")):
            n = nu[k]
            dirn, pen = np.zeros(p + 1), np.zeros(p + 1)
            if f.rule == "degenerate_constant":
                dirn[0] = s["so_plain"] / s["d"]
                vec |= {f"{kind}_c": 1.0, f"{kind}_off": dirn[0] * s["ybar"]}
            else:
                act = np.flatnonzero((np.abs(f.beta) > ACTIVE) | (np.arange(p + 1) == 0) | (f.lam == 0))
                ix = np.ix_(act, act)
                dirn[act], diag = solve_curvature(hess[k][ix] / n, design[k][:, act], np.array(sens)[act] / s["d"])
                vec |= {f"{kind}_c": 0.0, f"{kind}_off": float(-(grad[k] / n) @ dirn)}
                out[(g, kind)] = diag
                sd = np.sqrt(np.maximum([s[f"{var}{j}"] for j in range(p + 1)], 0.0))
                ok = (f.lam > 0) & (np.abs(f.beta) > ACTIVE) & (np.arange(p + 1) > 0) & (sd > 0)
                pen[ok] = f.lam * np.sign(f.beta[ok]) * dirn[ok] / (2 * sd[ok])
            vec |= {f"{kind}_dir": dirn, f"{kind}_pen": pen, f"{kind}_mean": [s[f"{mean}{j}"] for j in range(p + 1)], f"{kind}_var": [s[f"{var}{j}"] for j in range(p + 1)]}
        est = s["wphi"] / s["d"]
        table[g] = {"estimate": est, "n": s["n"], "normalizer": s["d"], "diagnostics": {k: v for k, v in out.items() if k[0] == g}}
        out[g] = vec | {"est": est, "d": s["d"], "ratio": s["n"] / s["n_sel"]}
    names = [f"{k}_{v}" for k in ("ps", "or") for v in ("c", "off", "dir", "pen", "mean", "var")] + ["est", "d", "ratio"]
    vecs = _vectors(rows.sparkSession, {g: out[g] for g in gs}, names)
    j = r.join(sized(vecs, len(gs), 8 * 10 * (p + 1)), "g")

    def correction(kind, response, fitted):
        pen = sum([F.col(f"{kind}_pen")[i] * ((xs[i] - F.col(f"{kind}_mean")[i]) * (xs[i] - F.col(f"{kind}_mean")[i]) - F.col(f"{kind}_var")[i])
                   for i in range(1, p + 1)], F.lit(0.0))
        fit = (response - fitted) * _dotx(f"{kind}_dir", p) - F.col(f"{kind}_off") - pen
        const = F.col(f"{kind}_dir")[0] * response - F.col(f"{kind}_off")
        return F.when(F.col(f"{kind}_c") == 1.0, const).otherwise(fit)

    infl = (F.col("weight") * (F.col("phi") - F.col("est")) / F.col("d") + correction("ps", F.col("a"), F.col("raw_ps"))
            + F.when(F.col("sel") == 1, F.col("ratio") * correction("or", F.col("y"), F.col("raw_or"))).otherwise(0.0))
    j = j.withColumn("influence", infl).drop(*names[:-3], "ratio")
    return (j.persist(StorageLevel.MEMORY_AND_DISK) if keep else j), table  # read again by the density part, the arm contrast and the bootstrap


# -- density influence ------------------------------------------------------------------------
def density_influence(data: DataFrame, rows: DataFrame, fits: list[Fitted], p: int, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Source and target rows of density_parts, each with its own column."""
    j, t = density_parts(data, rows, fits, p, total), F.col("site") == C.TARGET
    return j.filter(~t).drop("parts"), j.filter(t).drop("density_part")


def density_parts(data: DataFrame, rows: DataFrame, fits: list[Fitted], p: int, total: float | None = None) -> DataFrame:
    """Source and target parts of the estimated density weights' influence.

    rows: output of weighted_aipw with tilt_eta and raw_weight. Source rows get
    `density_part`; target rows get `parts`, one entry per source.
    total: pooled row count, for which the source fraction n_j / total applies.
    """
    src = rows.filter(F.col("site") != C.TARGET)
    norm, c = F.col("raw_weight"), F.col("phi") - F.col("est")
    inside = ((norm > C.DR_WEIGHT_CLIP[0]) & (norm < C.DR_WEIGHT_CLIP[1])).cast("double")
    v = inside * norm * c
    xs = _x(p, "z")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(v).alias("v"), F.first("d").alias("d"), F.avg(F.exp(-F.col("tilt_eta"))).alias("tilt_mean")]
    for i, x in enumerate(xs):
        aggs += [F.avg(norm * x).alias(f"t{i}"), F.avg(v * x).alias(f"s{i}"), F.avg(F.exp(-F.col("tilt_eta")) * x).alias(f"e{i}")]
    stats = {s["site"]: s for s in src.groupBy("site").agg(*aggs).collect()}
    by = {f.model.site: f for f in fits}
    gs = sorted(stats)
    ms = [Model(("t", g), g, None, family="tilt") for g in gs]
    beta = np.stack([by[g].beta for g in gs])
    _, nu, _, _, _, hess = unpack(accumulate(data, ms, beta, "z"), p + 1)
    design = design_factors(data, [(g, None) for g in gs], p, "z")
    tgt = rows.filter(F.col("site") == C.TARGET)
    tmean = tgt.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]).first()
    tm = np.array([tmean[f"m{i}"] for i in range(p + 1)])
    table = {}
    for i, g in enumerate(gs):
        s, f = stats[g], by[g]
        frac = (s["n"] / total) if total else 1.0
        sens = -frac / s["d"] * np.array([s[f"s{j}"] - s[f"t{j}"] * s["v"] for j in range(p + 1)])
        act = np.flatnonzero((np.abs(f.beta) > ACTIVE) | (np.arange(p + 1) == 0) | (f.lam == 0))
        ix = np.ix_(act, act)
        dirn = np.zeros(p + 1)
        dirn[act], _ = solve_curvature(hess[i][ix] / nu[i], design[i][:, act], sens[act])
        off = float(np.array([s[f"e{j}"] for j in range(p + 1)]) @ dirn)
        table[g] = {"dn_dir": dirn, "dn_off": off, "dn_norm": -frac / s["d"] * s["v"], "dn_t": float(tm @ dirn)}
    # one row per site: a source has its vector, the target those of all sources as one array, so that no row is repeated
    fl = lambda v: [float(u) for u in v]
    packed = [(g, fl(table[g]["dn_dir"]), table[g]["dn_t"]) for g in gs]
    vec = rows.sparkSession.createDataFrame([(g, fl(table[g]["dn_dir"]), float(table[g]["dn_off"]), float(table[g]["dn_norm"]), None) for g in gs] + [(C.TARGET, None, None, None, packed)],
                                            "site string, dn_dir array<double>, dn_off double, dn_norm double, dn_all array<struct<src: string, dn_dir: array<double>, dn_t: double>>")
    t = F.col("site") == C.TARGET
    part = F.exp(-F.col("tilt_eta")) * _dotx("dn_dir", p, "z") - F.col("dn_off") + F.col("dn_norm") * (norm - 1)
    parts = F.transform("dn_all", lambda m: F.struct(m["src"].alias("source"), (m["dn_t"] - linear_predictor("z", m["dn_dir"], p)).alias("density_part")))
    j = rows.join(sized(vec, len(gs) + 1, 16 * len(gs) * (p + 8)), "site")
    return j.withColumns({"density_part": F.when(~t, part), "parts": F.when(t, parts)}).drop("dn_dir", "dn_off", "dn_norm", "dn_all")
