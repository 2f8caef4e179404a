"""Multi-site estimators. Each returns influence blocks, so arms combine with their covariance."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .. import constants as C
from ..functions import clip_outcome, clip_propensity, linear_predictor, logistic, mean_response
from ..operators import fits as fi, influence as inf, resample as rs
from ..operators.gram import prepare
from ..operators.joins import attach, sized
from ..operators.scores import aipw
from ..storage import stored

METHODS = ("target_only", "sample_size", "inverse_variance", "tilted_aipw", "federated_dr", "pooled_dr")


@dataclass
class ArmResult:
    """estimate, analytic variance and influence blocks (site, obs_id, influence) with block weights of one arm.

    pair: (site, obs_id, i1, i0), the influence of both arms side by side where one scan of the rows gives them.
    """
    method: str
    arm: int
    estimate: float
    variance: float
    influence: DataFrame
    weights: dict[str, float]
    n: int = 0
    extra: dict = field(default_factory=dict)
    pair: DataFrame | None = None


def both_arms(rows: DataFrame, arm_of) -> tuple[ArmResult, ArmResult]:
    """Results of arm_of(rows, arm), which also gives its rows with `value`, the influence. The first arm's influence goes along with the rows that the second arm is
    worked out on: both come from one scan, where a join of the arms would shuffle and sort all rows of each."""
    kept = rows.columns
    r1, j = arm_of(rows, 1)
    r0, j = arm_of(j.select(*kept, F.col("value").alias("i1")), 0)
    pair = j.select("site", "obs_id", "i1", F.col("value").alias("i0"))
    for r in (r1, r0):
        r.pair, r.influence = pair, _of_arm(pair, r.arm, r.weights)
    return r1, r0


def _of_arm(pair: DataFrame, arm: int, weights: dict[str, float]) -> DataFrame:
    return pair.filter(F.col("site").isin(list(weights))).select("site", "obs_id", F.col(f"i{arm}").alias("influence"))


# -- site-level AIPW by cross-fitting -----------------------------------------------------
def crossfit_site_scores(data: DataFrame, k: int, family: str, nuisance: str = "lasso", sites: list[str] | None = None, drops_of=lambda f: (f,), **kw) -> DataFrame:
    """(obs_id, site, a, fold, phi1, phi0): scores by models that never saw the row's fold.

    data is prepared (cached) with folds 1..k. Both arms share one propensity.
    """
    sites = sites or fi.sites_of(data)
    drops = sorted({tuple(sorted(drops_of(f))) for f in range(1, k + 1)})
    if nuisance == "glm":
        ps = fi.fit_glm(data, fi.keys("ps", sites, (1,), drops), "binomial", "a", "z")
        orr = fi.fit_glm(data, fi.keys("or", sites, (1, 0), drops), family)
    else:
        ps = fi.fit_propensity(data, fi.keys("ps", sites, (1,), drops), x="z", **kw)
        orr = fi.fit_outcome(data, fi.keys("or", sites, (1, 0), drops), family, **kw)
    P, O = fi._by_key(ps), fi._by_key(orr)
    p, pz = len(orr[0].beta) - 1, len(ps[0].beta) - 1
    fl = lambda b: [float(v) for v in b]
    ad = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("site", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("ps", ad), T.StructField("m1", ad), T.StructField("m0", ad)])
    rows = [(s, f, fl(P[(s, 1, d)].beta), fl(O[(s, 1, d)].beta), fl(O[(s, 0, d)].beta)) for s in sites for f in range(1, k + 1) for d in [tuple(sorted(drops_of(f)))]]
    coef = data.sparkSession.createDataFrame(rows, schema)
    j = data.join(sized(coef, len(rows), 24 * (p + 2)), ["site", "fold"])
    pi = clip_propensity(logistic(linear_predictor("z", "ps", pz)))
    m = {a: clip_outcome(mean_response(linear_predictor("w", f"m{a}", p), family), family) for a in (1, 0)}
    return j.select("obs_id", "site", "a", "fold", aipw("y", "a", m[1], pi, 1).alias("phi1"), aipw("y", "a", m[0], 1 - pi, 0).alias("phi0"))


def complement_scores(data: DataFrame, combos: Sequence[tuple[int, int | None]], ps: dict, outcome: dict, family: str, folds: Sequence[int], training: bool = False) -> DataFrame:
    """Scores of models fitted without an outer fold (and an inner one): on the evaluation fold, which is the inner one if there is one, and on request on the training rows too.

    ps[excluded], outcome[(arm, excluded)] are coefficients. One pass scores both roles; a row of (outer, inner) has role `evaluation` or `training`, and the excluded
    outer fold of an inner pair has neither.
    """
    fl = lambda b: [float(v) for v in b]
    ad, i = T.ArrayType(T.DoubleType()), T.IntegerType()
    schema = T.StructType([T.StructField("fold", i), T.StructField("outer_fold", i), T.StructField("inner_fold", i), T.StructField("role", T.StringType()),
                           T.StructField("ps", ad), T.StructField("b1", ad), T.StructField("b0", ad)])
    rows = []
    for outer, inner in combos:
        d = (outer,) if inner is None else tuple(sorted((outer, inner)))
        for f in folds:
            role = "evaluation" if f == (outer if inner is None else inner) else "training" if training and f not in d else None
            if role:
                rows.append((f, outer, inner, role, fl(ps[d]), fl(outcome[(1, d)]), fl(outcome[(0, d)])))
    p, pz = len(rows[0][5]) - 1, len(rows[0][4]) - 1
    j = data.join(sized(data.sparkSession.createDataFrame(rows, schema), len(rows), 24 * (p + 2)), "fold")
    pi = clip_propensity(logistic(linear_predictor("z", "ps", pz)))
    m = {a: clip_outcome(mean_response(linear_predictor("w", f"b{a}", p), family), family) for a in (1, 0)}
    return j.select("obs_id", "site", "a", "fold", "outer_fold", "inner_fold", "role", pi.alias("propensity"), m[1].alias("m1"), m[0].alias("m0"),
                    aipw("y", "a", m[1], pi, 1).alias("phi1"), aipw("y", "a", m[0], 1 - pi, 0).alias("phi0"))


def site_table(scores: DataFrame, value: str = "phi", by: Sequence[str] = ("site",)) -> DataFrame:
    """site_est(site, estimate, v, variance, n): v is the population variance of the score, variance = v / n."""
    g = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("estimate"), F.var_pop(value).alias("v_ot"))
    return g.withColumn("variance", F.col("v_ot") / F.col("n"))


# -- meta-analysis of a site table -------------------------------------------------------------
def centred(site_est: DataFrame, by: Sequence[str], precision, estimate: str = "estimate") -> DataFrame:
    """Adds _gap: the estimate minus the precision-weighted mean of its group. Squares of gaps do not cancel as power sums do."""
    mean = site_est.groupBy(*by).agg((F.sum(precision * F.col(estimate)) / F.sum(precision)).alias("_mean"))
    return attach(site_est, mean, by).withColumn("_gap", F.col(estimate) - F.col("_mean")).drop("_mean")


def _dl(p, k):
    """q, tau2, i2 from precisions p and the gaps to their mean."""
    s0 = F.sum(p)
    q = F.sum(p * F.col("_gap") * F.col("_gap"))
    c = s0 - F.sum(p * p) / s0
    tau = F.when((k > 1) & (c > 0), F.greatest(F.lit(0.0), (q - (k - 1)) / c)).otherwise(0.0)
    i2 = F.when(q > k - 1, (q - (k - 1)) / q * 100).otherwise(0.0)
    return q, tau, i2


def dl_heterogeneity(site_est: DataFrame, by: Sequence[str] = (), estimate: str = "estimate", variance: str = "variance",
                     var_floor: float = C.VARIANCE_FLOOR) -> DataFrame:
    """Q, tau2, I2, total precision and the fixed-effects mean of the site estimates."""
    p, e, k = 1 / F.greatest(F.col(variance), F.lit(var_floor)), F.col(estimate), F.count(F.lit(1))
    q, tau, i2 = _dl(p, k)
    return centred(site_est, by, p, estimate).groupBy(*by).agg(k.alias("k"), q.alias("q"), tau.alias("tau2"), i2.alias("i2"), F.sum(p).alias("total_precision"),
                                     (F.sum(p * e) / F.sum(p)).alias("fe_estimate"))


def sample_size_weighted(site_est: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n, e, v, k = F.col("n").cast("double"), F.col("estimate"), F.col("variance"), F.count(F.lit(1))
    p = 1 / F.greatest(v, F.lit(C.VARIANCE_FLOOR))
    q, tau, i2 = _dl(p, k)
    tot = F.sum(n)
    g = centred(site_est, by, p).groupBy(*by).agg((F.sum(n * e) / tot).alias("estimate"), (F.sum(n * n * v) / (tot * tot)).alias("var_fixed_effects"),
                                  (F.sum(n * n) / (tot * tot)).alias("_w2"), tau.alias("tau2"), q.alias("q"), i2.alias("i2"), F.sum("n").alias("n"))
    g = g.withColumn("var_random_effects", F.col("var_fixed_effects") + F.col("tau2") * F.col("_w2")).drop("_w2")
    return g.withColumns({"variance": F.greatest(F.col("var_random_effects"), F.lit(C.VARIANCE_FLOOR)), "method": F.lit("sample_size")})


def _precisions(site_est: DataFrame, by: Sequence[str], var_floor: float) -> DataFrame:
    het = dl_heterogeneity(site_est, by, var_floor=var_floor).select(*by, "q", "tau2", "i2")
    j = site_est.join(het, list(by)) if by else site_est.crossJoin(het)
    return j.withColumn("_prec", 1 / (F.greatest(F.col("variance"), F.lit(var_floor)) + F.col("tau2")))


def inverse_variance_weights(site_est: DataFrame, by: Sequence[str] = (), var_floor: float = C.VARIANCE_FLOOR) -> DataFrame:
    """Adds block_weight: random-effects weights when tau2 > 0, else fixed-effects ones."""
    j = _precisions(site_est, by, var_floor)
    tot = j.groupBy(*by).agg(F.sum("_prec").alias("_total"))
    j = j.join(tot, list(by)) if by else j.crossJoin(tot)
    return j.withColumn("block_weight", F.col("_prec") / F.col("_total")).drop("_prec", "_total")


def inverse_variance_weighted(site_est: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    j = centred(_precisions(site_est, by, C.VARIANCE_FLOOR), by, F.col("_prec"))
    r, e, tot = F.col("_prec"), F.col("estimate"), F.sum("_prec")
    theta = F.greatest(F.col("v_ot"), F.lit(C.VARIANCE_FLOOR))
    est = F.sum(r * e) / tot
    between = F.sum(r * r * F.col("_gap") * F.col("_gap"))
    g = j.groupBy(*by).agg(
        est.alias("estimate"), (1 / tot).alias("model_variance"), (F.sum(r * r * theta / F.col("n")) / (tot * tot)).alias("within_site_var"),
        (between / (tot * tot)).alias("between_site_var"), F.first("tau2").alias("tau2"), F.first("q").alias("q"), F.first("i2").alias("i2"), F.sum("n").alias("n"))
    pooled = F.col("within_site_var") + F.col("between_site_var")
    return g.withColumns({"variance": F.greatest(F.col("model_variance"), pooled, F.lit(C.VARIANCE_FLOOR)), "method": F.lit("inverse_variance")})


# -- one arm of the score-based methods -----------------------------------------------------------
def site_method_arms(scores: DataFrame, methods: Sequence[str]) -> dict[str, tuple[ArmResult, ArmResult]]:
    """target_only, sample_size and inverse_variance of both arms from shared site scores.

    One pass over the rows gives the site table of both arms; the rest works on its
    2 (K + 1) rows with the arm as a key.
    """
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"phi{a}").alias("phi")) for a in (1, 0)])).alias("s")
    long = scores.select("obs_id", "site", arm).select("obs_id", "site", "s.*")
    rows = site_table(long, by=("arm", "site")).collect()
    spark = scores.sparkSession
    t = spark.createDataFrame(rows, "arm int, site string, n long, estimate double, v_ot double, variance double")
    mean = {(r["arm"], r["site"]): r["estimate"] for r in rows}
    means = spark.createDataFrame([(s, mean[1, s], mean[0, s]) for a, s in mean if a == 1], "site string, _m1 double, _m0 double")
    pair = scores.join(sized(means, len(rows), 64), "site").select("site", "obs_id", *[(F.col(f"phi{a}") - F.col(f"_m{a}")).alias(f"i{a}") for a in (1, 0)])
    n = sum(r["n"] for r in rows if r["arm"] == 1)
    agg = {"sample_size": sample_size_weighted, "inverse_variance": inverse_variance_weighted}
    out = {}
    for m in methods:
        if m == "target_only":
            one = {r["arm"]: r for r in rows if r["site"] == C.TARGET}
            arms = [ArmResult(m, a, one[a]["estimate"], max(one[a]["variance"], C.VARIANCE_FLOOR), _of_arm(pair, a, {C.TARGET: 1.0}), {C.TARGET: 1.0}, one[a]["n"], pair=pair) for a in (1, 0)]
        else:
            g = {r["arm"]: r for r in agg[m](t, ("arm",)).collect()}
            if m == "sample_size":
                w = {(r["arm"], r["site"]): r["n"] / n for r in rows}
            else:
                w = {(r["arm"], r["site"]): r["block_weight"] for r in inverse_variance_weights(t, ("arm",)).collect()}
            of = {a: {s: x for (b, s), x in w.items() if b == a} for a in (1, 0)}
            arms = [ArmResult(m, a, g[a]["estimate"], g[a]["variance"], _of_arm(pair, a, of[a]), of[a], n, {k: g[a][k] for k in ("tau2", "q", "i2")}, pair) for a in (1, 0)]
        out[m] = tuple(arms)
    return out


def block_variance(infl: DataFrame, weights: dict[str, float]) -> float:
    """sum over sites of weight^2 * population variance / n."""
    g = infl.groupBy("site").agg((F.var_pop("influence") / F.count(F.lit(1))).alias("v"))
    return float(sum(weights[r["site"]] ** 2 * r["v"] for r in g.collect()))


def tilted_fits(data: DataFrame, family: str) -> dict:
    """Unpenalised propensity, outcome and tilt of every site and both arms, in three lockstep fits."""
    sites = fi.sites_of(data)
    sources = [s for s in sites if s != C.TARGET]
    dk = fi.keys("dr", sources, (1, 0), [()])
    mom = fi.target_moments(data, dk)
    by = lambda fits: {(f.model.key[1], f.model.key[2]): f for f in fits}
    return {"sites": sites, "ps": by(fi.fit_glm(data, fi.keys("ps", sites, (1,), [()]), "binomial", "a")),
            "or": by(fi.fit_glm(data, fi.keys("or", sites, (1, 0), [()]), family)),
            "dr": by(fi.fit_density_ratio(data, dk, mom, 0.0, float("inf"))), "zbar": mom[dk[0]]}


def tilted_aipw_arm(data: DataFrame, rows: DataFrame, arm: int, family: str, p: int, f: dict) -> tuple[ArmResult, DataFrame]:
    """Unpenalised nuisances, exponential tilt of the arm to the target, size weights, shared target influence."""
    sites, zbar = f["sites"], f["zbar"]
    sources = [s for s in sites if s != C.TARGET]
    ps, orr = {s: f["ps"][(s, 1)] for s in sites}, {s: f["or"][(s, arm)] for s in sites}
    dr = {s: f["dr"][(s, arm)] for s in sources}
    rows = inf.site_weights(rows, {s: dr[s].beta if s in dr else np.zeros(p + 1) for s in sites}, p).drop("tilt_eta").withColumnRenamed("raw_weight", "weight")
    r, table = inf.weighted_aipw(data, rows, ps, orr, p, family, arm, keep=False)
    zc = [F.lit(0.0)] + [F.col("z")[j] - float(zbar[j + 1]) for j in range(p)]
    w, aw = F.col("weight"), F.when(F.col("a") == arm, F.col("weight")).otherwise(0.0)
    pairs = [(i, j) for i in range(1, p + 1) for j in range(i, p + 1)]
    st = {s["site"]: s for s in r.filter(F.col("site") != C.TARGET).groupBy("site").agg(
        *[F.avg(w * zc[i] * (F.col("phi") - F.col("est"))).alias(f"a{i}") for i in range(1, p + 1)],
        *[F.avg(aw * zc[i] * zc[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()}
    adj = {C.TARGET: {"adj": np.zeros(p + 1)}}
    for s in sources:
        m = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = st[s][f"m{i}_{j}"]
        a = np.array([0.0] + [-st[s][f"a{i}"] / table[s]["normalizer"] for i in range(1, p + 1)])
        adj[s] = {"adj": inf.solve_ridge(m, a)}
    n_all = sum(v["n"] for v in table.values())
    wt = {s: table[s]["n"] / n_all for s in sites}
    # the sources' adjustments act on target rows through their weighted sum
    shared = sum(wt[s] * adj[s]["adj"] for s in sources)
    adj[C.TARGET] = {"adj": -shared / wt[C.TARGET]}
    vec = inf._vectors(data.sparkSession, adj, ["adj"]).withColumnRenamed("g", "site")
    j = r.join(sized(vec, len(sites), 8 * (p + 4)), "site")
    lin = sum([zc[i] * F.col("adj")[i] for i in range(2, p + 1)], zc[1] * F.col("adj")[1])
    part = F.when(F.col("site") == C.TARGET, lin).otherwise(aw * lin)
    j = j.withColumn("value", F.col("influence") + part)
    infl = j.select("site", "obs_id", F.col("value").alias("influence"))
    est = sum(wt[s] * table[s]["estimate"] for s in sites)
    return ArmResult("tilted_aipw", arm, est, max(block_variance(infl, wt), C.VARIANCE_FLOOR), infl, wt, n_all), j


def base_fits(data: DataFrame, groups: list[str], family: str, **kw) -> dict:
    """Penalised propensity and both arms' outcome per group ("*" is all rows together)."""
    ps = {f.model.key[1]: f for f in fi.fit_propensity(data, fi.keys("ps", groups, (1,), [()]), **kw)}
    orr = {(f.model.key[1], f.model.key[2]): f for f in fi.fit_outcome(data, fi.keys("or", groups, (1, 0), [()]), family, **kw)}
    return {"ps": ps, **{a: {g: orr[(g, a)] for g in groups} for a in (1, 0)}}


def federated_dr_arm(data: DataFrame, rows: DataFrame, dr: list, arm: int, family: str, p: int, base: dict) -> tuple[ArmResult, DataFrame]:
    """Density-weighted site AIPW, inverse-variance pooling of the sites with a finite positive variance."""
    sites = sorted(base["ps"])
    r, table = inf.weighted_aipw(data, rows, base["ps"], base[arm], p, family, arm, keep=False)
    j, t = inf.density_parts(data, r, dr, p), F.col("site") == C.TARGET
    own = F.when(t, F.col("influence")).otherwise(F.col("influence") + F.col("density_part"))
    second = F.avg(own * own) - F.when(F.first("site") == C.TARGET, 0.0).otherwise(F.avg(own) * F.avg(own))
    var = {x["site"]: x["v"] for x in j.groupBy("site").agg((second / F.count(F.lit(1))).alias("v")).collect()}
    valid = [s for s in sites if np.isfinite(table[s]["estimate"]) and np.isfinite(var[s]) and var[s] > 0]
    prec = sum(1 / var[s] for s in valid)
    w = {s: 1 / var[s] / prec for s in valid}
    wmap = F.create_map(*[F.lit(v) for kv in w.items() for v in kv])
    extra = F.aggregate("parts", F.lit(0.0), lambda t, m: t + m["density_part"] * F.coalesce(wmap[m["source"]], F.lit(0.0)))
    j = j.withColumn("value", F.when(t, F.col("influence") * w.get(C.TARGET, 0.0) + extra).otherwise(own))
    blocks = {C.TARGET: 1.0} | {s: w[s] for s in valid if s != C.TARGET}
    infl = j.filter(F.col("site").isin(list(blocks))).select("site", "obs_id", F.col("value").alias("influence"))
    est = sum(w[s] * table[s]["estimate"] for s in valid)
    return ArmResult("federated_dr", arm, est, max(block_variance(infl, blocks), C.VARIANCE_FLOOR), infl, blocks, sum(table[s]["n"] for s in valid),
                     {"dropped_sites": [s for s in sites if s not in valid], "weights": w}), j


def pooled_dr_arm(data: DataFrame, rows: DataFrame, dr: list, arm: int, family: str, p: int, base: dict) -> tuple[ArmResult, DataFrame]:
    """One weighted AIPW over all rows with per-source density corrections and site-stratified variance."""
    r, table = inf.weighted_aipw(data, rows, base["ps"], base[arm], p, family, arm, pooled=True, keep=False)
    n_all = table["*"]["n"]
    n = {x["site"]: x["count"] for x in data.groupBy("site").count().collect()}
    of_site = F.create_map(*[F.lit(v) for s, c in n.items() for v in (s, n_all / c)])
    extra = F.aggregate("parts", F.lit(0.0), lambda t, m: t + m["density_part"]) * (n_all / n[C.TARGET])
    part = F.when(F.col("site") == C.TARGET, extra).otherwise(of_site[F.col("site")] * F.col("density_part"))
    j = inf.density_parts(data, r, dr, p, total=n_all).withColumn("value", F.col("influence") + part)
    infl, w = j.select("site", "obs_id", F.col("value").alias("influence")), {s: c / n_all for s, c in n.items()}
    return ArmResult("pooled_dr", arm, table["*"]["estimate"], max(block_variance(infl, w), C.VARIANCE_FLOOR), infl, w, n_all), j


# -- arms and comparison ---------------------------------------------------------------------------
def combine_arms(r1: ArmResult, r0: ArmResult) -> tuple[DataFrame, DataFrame]:
    """(one-row result, contrast influence). Arms must hold the same rows of the same sites."""
    if set(r1.weights) != set(r0.weights):
        raise ValueError(f"{r1.method}: the arms have different sites")
    spark = r1.influence.sparkSession
    wf = spark.createDataFrame([(s, float(r1.weights[s]), float(r0.weights[s])) for s in r1.weights], "site string, w1 double, w0 double")
    if r1.pair is not None and r1.pair is r0.pair:
        j = r1.pair
    else:
        a = r1.influence.select("site", "obs_id", F.col("influence").alias("i1"))
        b = r0.influence.select("site", "obs_id", F.col("influence").alias("i0"))
        j = a.join(b, ["site", "obs_id"], "full_outer")
    j = j.join(sized(wf, len(r1.weights), 48), "site")
    bad = F.when(F.col("i1").isNull() | F.col("i0").isNull(), F.raise_error(F.lit("the arms have different rows")))
    tau = F.coalesce(bad.cast("double"), F.col("w1") * F.col("i1") - F.col("w0") * F.col("i0"))
    j = j.select("site", "obs_id", (F.col("w1") * F.col("i1")).alias("u1"), (F.col("w0") * F.col("i0")).alias("u0"), tau.alias("influence"))
    g = j.groupBy("site").agg(*[(F.var_pop(c) / F.count(F.lit(1))).alias(f"v_{c}") for c in ("u1", "u0", "influence")])
    v = g.agg(F.sum("v_u1").alias("v1"), F.sum("v_u0").alias("v0"), F.greatest(F.sum("v_influence"), F.lit(C.VARIANCE_FLOOR)).alias("variance_analytic"))
    cov = (F.col("v1") + F.col("v0") - F.col("variance_analytic")) / 2
    floor = lambda c: F.greatest(F.col(c), F.lit(C.VARIANCE_FLOOR))
    res = v.select(
        F.lit(r1.method).alias("method"), F.lit(float(r1.estimate - r0.estimate)).alias("estimate"), F.lit(float(r1.estimate)).alias("mu1"), F.lit(float(r0.estimate)).alias("mu0"),
        "variance_analytic", F.sqrt("v1").alias("mu1_se"), F.sqrt("v0").alias("mu0_se"), cov.alias("cross_arm_covariance"),
        (cov / F.sqrt(floor("v1") * floor("v0"))).alias("cross_arm_correlation"), F.lit(int(r1.n)).cast("long").alias("n"))
    return res, j.select(F.lit(r1.method).alias("method"), "site", "obs_id", "influence")


def compare_methods(obs: DataFrame, methods: Sequence[str] = METHODS, family: str = "binomial", k: int = 5, nuisance: str = "lasso", variance: str = "bootstrap",
                    b: int = C.BOOTSTRAP_REPLICATES, seed: int = 1, **kw) -> tuple[DataFrame, dict[str, tuple[ArmResult, ArmResult]]]:
    """TATE of every method on one table. Site scores and density weights are computed once and shared.

    obs carries folds 1..k (and cv folds for penalised nuisances).
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    data = prepare(obs, files=True)
    p = len(data.select("w").first()[0])
    spark = data.sparkSession
    arms: dict[str, tuple[ArmResult, ArmResult]] = {}
    if set(methods) & {"target_only", "sample_size", "inverse_variance"}:
        scores = crossfit_site_scores(data, k, family, nuisance, **kw).persist()
        arms |= site_method_arms(scores, [m for m in methods if m in ("target_only", "sample_size", "inverse_variance")])
    if "tilted_aipw" in methods:
        tf = tilted_fits(data, family)
        arms["tilted_aipw"] = both_arms(data.drop("weight"), lambda rows, arm: tilted_aipw_arm(data, rows, arm, family, p, tf))
    if set(methods) & {"federated_dr", "pooled_dr"}:
        sites = fi.sites_of(data)
        weighted, dr = inf.density_ratio_weights(data, [s for s in sites if s != C.TARGET], **kw)
        for m, fn, groups in (("federated_dr", federated_dr_arm, sites), ("pooled_dr", pooled_dr_arm, ["*"])):
            if m in methods:
                bf = base_fits(data, groups, family, **kw)
                arms[m] = both_arms(weighted, lambda rows, arm: fn(data, rows, dr, arm, family, p, bf))
    both = [combine_arms(*arms[m]) for m in methods]
    # method after method: the driver then holds the plan of one
    res = spark.createDataFrame([r for x, _ in both for r in x.collect()], both[0][0].schema)
    if variance == "bootstrap":
        infl = stored(*[x for _, x in both])  # read for the means and for the draws
        w = spark.createDataFrame([(m, s, 1.0) for m in methods for s in arms[m][0].weights], "method string, site string, weight double")
        res = res.join(rs.multiplier_bootstrap(infl, w, b, seed), "method", "left")
    else:
        res = res.withColumns({"se_bootstrap": F.lit(None).cast("double"), "n_bootstrap": F.lit(None).cast("long")})
    return rs.resolve_variance(res), arms


def wald(df: DataFrame, truth: str | None = None, z: float = C.Z_975) -> DataFrame:
    out = df.withColumns({"ci_lower": F.col("estimate") - z * F.col("se"), "ci_upper": F.col("estimate") + z * F.col("se")})
    out = out.withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))
    return out.withColumn("coverage", (F.col("ci_lower") <= F.col(truth)) & (F.col(truth) <= F.col("ci_upper"))) if truth else out
