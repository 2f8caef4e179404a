"""End-to-end adaptive estimation: folds, fits, scores, moments, weights, pseudo-values, result."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..operators import fits as fi
from ..operators.folds import assign_cv_folds, assign_folds, assign_group_folds
from ..operators.gram import prepare
from ..operators.joins import settled, sized
from ..operators.moments import fold_moments, pool_joint_moments, pool_moments
from ..operators.resample import fixed_weight_draws, reweighted_moments
from ..operators.score_moments import arm_moments, contrast_draw_sums, score_stats, two_arm_moments
from ..operators.scores import long_arms, score_coefficients, score_rows
from ..operators.validation import assert_groups_in_fold, validate_cohort, validate_folds, validate_radius
from ..operators.weights import select_weight_lambda, solve_joint_weights, solve_weights, wald_discrepancy


@dataclass(frozen=True)
class Options:
    k: int = C.OUTER_FOLDS
    family: str = "binomial"
    mode: str = "one_round"            # who trains the initial outcome model
    source_program: str = "calibrated"  # calibrated | standard
    target_program: str = "lasso"       # lasso | calibrated
    layers: int = 2                     # 2 reuses the outer fits for weight learning, 3 refits without the inner fold
    recipe: str = "legacy"
    radius: float = C.RADIUS
    inference_radius: float | None = None
    target_radius: float = C.RADIUS
    lam: float | None = None            # nuisance penalty; None = cross-validation
    nlambda: int = C.LAMBDA_GRID_SIZE
    rule: str = "min"
    cutoff_lambda: float | str = C.WALD_LAMBDA  # number, or "cv"
    lambda_grid: tuple[float, ...] = (1.0,)
    screening: str = "soft_penalty"
    aggregation: str = "common_tate"    # common_tate | separate_arms | joint_tate
    init: str = "logistic"
    seed: int = 7


# named profiles: (cutoff lambda, fit radius, inference radius)
PROFILES = {"package": (1.0, 5.0, 5.0), "study": (0.5, 12.0, 12.0), "clinical": (0.5, 3.0, 5.0)}


@dataclass
class Saved:
    """What a re-aggregation needs: score rows, site sizes, source order; the models stay with the scores."""
    scores: DataFrame
    sources: list[str]
    sizes: dict[str, int]
    options: Options
    data: DataFrame | None = None
    coef: DataFrame | None = None
    n_coef: int = 0
    p: int = 0
    fits: dict = field(default_factory=dict)
    radius: float = C.RADIUS                        # of inference
    stats: dict = field(default_factory=dict)       # radius -> moments of the score vectors on the inner folds

    @property
    def n_all(self) -> int:
        return sum(self.sizes.values())


def fit_and_score(obs: DataFrame, o: Options, validate: bool = True) -> Saved:
    """Folds, all nuisance fits in lockstep, and one score row per (observation, outer fold)."""
    fit_r, inf_r = validate_radius(o.radius, o.inference_radius)
    if validate:
        validate_cohort(obs, o.family)
        for a in (1, 0):
            validate_folds(obs, o.k, a)
    if o.layers == 2 and o.k < 3:
        raise ValueError("weights learned on the other folds' scores need at least three folds")
    grouped = "group_id" in obs.columns and not obs.filter(F.col("group_id").isNotNull()).isEmpty()
    if "fold" in obs.columns:
        if grouped:
            assert_groups_in_fold(obs)
    elif grouped:  # repeated units stay together; a row without a group is a unit of its own
        unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("o"), F.col("obs_id").cast("string")))
        obs = assign_group_folds(obs.withColumn("_unit", unit), o.k, o.seed, "_unit").drop("_unit")
    else:
        obs = assign_folds(obs, o.k, o.seed)
    data = prepare(assign_cv_folds(obs))
    sizes = {r["site"]: r["count"] for r in data.groupBy("site").count().collect()}
    sources = sorted(s for s in sizes if s != C.TARGET)
    ks = range(1, o.k + 1)
    drop_of = (lambda c, k: (k,)) if o.layers == 2 else (lambda c, k: tuple(sorted({c, k})))
    pairs = [(c, k, drop_of(c, k)) for k in ks for c in ks]
    drops = sorted({d for _, _, d in pairs})
    folds = list(ks)
    kw = {"nlambda": o.nlambda, "rule": o.rule}
    if o.source_program == "standard":
        src = fi.fit_standard_source(data, sources, (1, 0), drops, o.family, fit_r, o.lam, **kw)
    else:
        src = fi.calibrate_source(data, sources, (1, 0), drops, o.family, o.mode, o.recipe, fit_r, o.lam, folds, **kw)
    gamma = {k: f.beta for k, f in fi._by_key(src["dr"]).items()}
    alpha = {k: f.beta for k, f in fi._by_key(src["or"]).items()}
    if o.target_program == "calibrated":
        tgt = fi.calibrate_target(data, (1, 0), drops, o.family, o.init, o.recipe, o.target_radius, o.lam, folds, **kw)
        tps = {(a, d): f.beta for (_, a, d), f in fi._by_key(tgt["ps"]).items()}
        tor = {(a, d): f.beta for (_, a, d), f in fi._by_key(tgt["or"]).items()}
    else:
        t = data.filter(F.col("site") == C.TARGET)
        ps = fi._by_key(fi.fit_propensity(t, fi.keys("ps", [C.TARGET], (1,), drops), x="z", lam=o.lam, **kw))
        orr = fi._by_key(fi.fit_outcome(t, fi.keys("or", [C.TARGET], (1, 0), drops), o.family, lam=o.lam, **kw))
        tps = {(a, d): ps[(C.TARGET, 1, d)].beta for a in (1, 0) for d in drops}
        tor = {(a, d): orr[(C.TARGET, a, d)].beta for a in (1, 0) for d in drops}
        tgt = {"ps": list(ps.values()), "or": list(orr.values())}
    coef, n = score_coefficients(data.sparkSession, pairs, sources, gamma, alpha, tps, tor)
    p = len(next(iter(alpha.values()))) - 1
    saved = Saved(None, sources, sizes, o, data, coef, n, p, {"source": src, "target": tgt})
    return at_radius(saved, inf_r)


def at_radius(saved: Saved, radius: float) -> Saved:
    """The same models under another inference radius; nothing is refitted. The score rows (observation x outer fold) are a plan over the cached
    observations and are never stored: the evaluation rows are one per observation, and what the weights learn from are moments."""
    o = saved.options
    s = score_rows(saved.data, saved.coef, saved.n_coef, saved.p, len(saved.sources), o.family, radius, o.target_program, o.target_radius)
    return replace(saved, scores=s, radius=radius)


def inner_stats(saved: Saved, radii: Sequence[float] | None = None) -> DataFrame:
    """Moments of the score vectors that teach the weights, for all radii from one pass; kept for the next use."""
    radii = [saved.radius] if radii is None else sorted(set(radii))
    missing = [r for r in radii if r not in saved.stats]
    if missing:
        o = saved.options
        s = settled(score_stats(saved.data, saved.coef, saved.sources, o.family, missing, o.target_program, o.target_radius))
        saved.stats.update({r: s.filter(F.col("radius") == r) for r in missing})
    out = saved.stats[radii[0]]
    for r in radii[1:]:
        out = out.unionByName(saved.stats[r])
    return out


# -- moments and weights --------------------------------------------------------------------
def split_scores(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows, weight-learning rows): a row is evaluated under its own fold and teaches the other folds."""
    same = F.col("fold") == F.col("outer_fold")
    return scores.filter(same), scores.filter(~same)


def inner_moments(saved: Saved, arms: Sequence[int]) -> DataFrame:
    return arm_moments(inner_stats(saved), len(saved.sources), arms).drop("radius")


def learn_weights(saved: Saved, arm_set: Sequence[int], lam=None, screening: str | None = None) -> DataFrame:
    """Moments pooled over the inner folds and the weights solved on them, per (arm, outer fold)."""
    o = saved.options
    k = len(saved.sources)
    m = inner_moments(saved, arm_set)
    pooled = pool_moments(m, k)
    lam = o.cutoff_lambda if lam is None else lam
    rule = screening or o.screening
    if lam == "cv":
        m = m.persist()
        chosen = select_weight_lambda(m, o.lambda_grid, o.rule, rule, k=k).select("arm", "outer_fold", F.col("lambda").alias("lam_cv"))
        return solve_weights(pooled.join(chosen, ["arm", "outer_fold"]), "lam_cv", rule).drop("lam_cv")
    return solve_weights(pooled, lam, rule)


def learn_joint_weights(saved: Saved, lam=None, screening: str | None = None) -> DataFrame:
    """(outer_fold, eta of 2K): both arms from one quadratic."""
    k = len(saved.sources)
    o = saved.options
    if (o.cutoff_lambda if lam is None else lam) == "cv":
        raise ValueError("the two-arm weights take a number as cutoff, not cross-validation")
    return solve_joint_weights(pool_joint_moments(two_arm_moments(inner_stats(saved), k).drop("radius"), k), o.cutoff_lambda if lam is None else lam, screening or o.screening)


# -- pseudo-values and results ------------------------------------------------------------------
def pseudo_values(scores_long: DataFrame, eta: DataFrame, sources: Sequence[str], sizes: dict[str, int], keys: Sequence[str] = ("outer_fold",), n_eta: int = 64,
                  extra: Sequence[str] = ()) -> DataFrame:
    """Adds phi_i: N/n_t [(1 - sum eta) phi + sum eta psi] on target rows, N/n_j eta_j correction on source rows.

    eta(keys..., eta array). The join is on a handful of rows.
    """
    k, n = len(sources), sum(sizes.values())
    j = scores_long.join(sized(eta.select(*keys, *extra, "eta"), n_eta, 8 * (k + 4)), list(keys))
    e = [F.col("eta")[i] for i in range(k)]
    rest = 1 - sum(e[1:], e[0])
    target = F.lit(n / sizes[C.TARGET]) * sum([e[i] * F.col("psi")[i] for i in range(k)], rest * F.col("phi"))
    out = F.when(F.col("site") == C.TARGET, target)
    for i, s in enumerate(sources):
        out = out.when(F.col("site") == s, F.lit(n / sizes[s]) * e[i] * F.col("corr"))
    return j.withColumn("value", out).drop("eta")


def stratified_variance(phi: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """estimate = mean; variance = sum over sites of n * population variance / N^2."""
    site = phi.groupBy(*by, "site").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    tot = F.sum("n").cast("double")
    g = site.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / tot).alias("estimate"), (F.sum(F.col("n") * F.col("v")) / (tot * tot)).alias("variance"))
    z = F.lit(C.Z_975) * F.sqrt("variance")
    return g.withColumns({"se": F.sqrt("variance"), "ci_lower": F.col("estimate") - z, "ci_upper": F.col("estimate") + z})


def aggregate_arm(saved: Saved, arm: int, lam=None, screening: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(result row, weights) of one arm's mean, or of the contrast with weights learned on it (arm 2)."""
    w = settled(learn_weights(saved, (arm,), lam, screening))
    outer, _ = split_scores(saved.scores)
    phi = pseudo_values(long_arms(outer, (arm,)), w, saved.sources, saved.sizes, n_eta=saved.options.k)
    return stratified_variance(phi), w


def _by_arm(joint: DataFrame, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """The two halves of joint weights as rows of arm 1 and arm 0."""
    cut = lambda c, a: F.slice(c, 1 if a == 1 else k + 1, k).alias(c)
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), *[cut(c, a) for c in ("wald", "penalty", "included", "eta")]) for a in (1, 0)]))
    return joint.select("outer_fold", "lam", *extra, s.alias("s")).select("s.arm", "outer_fold", "lam", *extra, "s.wald", "s.penalty", "s.included", "s.eta")


def aggregate_tate(saved: Saved, mode: str | None = None, lam=None, screening: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(result row, weights by outer fold and arm)."""
    mode = mode or saved.options.aggregation
    outer, _ = split_scores(saved.scores)
    k = len(saved.sources)
    if mode == "common_tate":
        res, w = aggregate_arm(saved, 2, lam, screening)
        return res.withColumn("method", F.lit(mode)), w.select("arm", "outer_fold", "lam", "wald", "penalty", "included", "eta")
    if mode == "separate_arms":
        w = learn_weights(saved, (1, 0), lam, screening).select("arm", "outer_fold", "lam", "wald", "penalty", "included", "eta")
    elif mode == "joint_tate":
        w = _by_arm(learn_joint_weights(saved, lam, screening), k)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    w = settled(w)
    # both arms' values of a row are summed with opposite signs
    phi = pseudo_values(long_arms(outer, (1, 0)), w, saved.sources, saved.sizes, ("arm", "outer_fold"), 2 * saved.options.k)
    return stratified_variance(contrast(phi)).withColumn("method", F.lit(mode)), w


def crossfit_mean(obs: DataFrame, arm: int, o: Options) -> tuple[DataFrame, Saved]:
    saved = fit_and_score(obs, o)
    return aggregate_arm(saved, arm)[0], saved


def crossfit_tate(obs: DataFrame, o: Options) -> tuple[DataFrame, Saved]:
    saved = fit_and_score(obs, o)
    return aggregate_tate(saved)[0], saved


def reaggregate(saved: Saved, cutoff: float | None = None, radius: float | None = None, mode: str | None = None, screening: str | None = None) -> DataFrame:
    """New cutoff, aggregation mode or inference radius from saved scores; nothing is refitted."""
    if radius is not None:
        saved = at_radius(saved, radius)
    return aggregate_tate(saved, mode, 1.0 / cutoff if cutoff else None, screening)[0]


def sensitivity_grid(saved: Saved, cutoffs: Sequence[float], radii: Sequence[float]) -> DataFrame:
    """TATE for every cutoff x inference radius, in the fitted aggregation mode.

    One pass gives the moments of all radii, one solve all weights; the evaluation rows are read once per radius for all cutoffs."""
    from functools import reduce
    k, parts, mode, rule = len(saved.sources), [], saved.options.aggregation, saved.options.screening
    if mode not in ("common_tate", "separate_arms", "joint_tate"):
        raise ValueError(f"unknown mode {mode!r}")
    arms = (2,) if mode == "common_tate" else (1, 0)
    keys = ("outer_fold",) if mode == "common_tate" else ("arm", "outer_fold")
    radii = sorted({float(r) for r in radii})
    stats = inner_stats(saved, radii)
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))

    def grid(m):
        return m.withColumn("cutoff", cut).withColumn("lam_c", 1 / F.col("cutoff"))

    if mode == "joint_tate":
        w = _by_arm(solve_joint_weights(grid(pool_joint_moments(two_arm_moments(stats, k), k, ("radius", "outer_fold"))), "lam_c", rule), k, ("cutoff", "radius"))
    else:
        w = solve_weights(grid(pool_moments(arm_moments(stats, k, arms), k, ("radius", "arm", "outer_fold"))), "lam_c", rule)
    w = settled(w)
    for r in radii:
        outer, _ = split_scores(at_radius(saved, r).scores)
        phi = pseudo_values(long_arms(outer, arms), w.filter(F.col("radius") == r), saved.sources, saved.sizes, keys, saved.options.k * len(arms) * len(cutoffs), extra=("cutoff",))
        parts.append(stratified_variance(phi if mode == "common_tate" else contrast(phi, ("cutoff",)), ["cutoff"]).withColumn("radius", F.lit(r)))
    return reduce(DataFrame.unionByName, parts)


def contrast(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Arm 1 minus arm 0 of each row's pseudo-value."""
    return phi.groupBy("obs_id", "site", *by).agg(F.sum(F.when(F.col("arm") == 1, F.col("value")).otherwise(-F.col("value"))).alias("value"))


def source_table(saved: Saved, weights: DataFrame, arm: int = 2) -> DataFrame:
    """Per source: estimate, weight, fold spread, Wald statistics, activation and inclusion shares, discrepancies."""
    outer, _ = split_scores(saved.scores)
    m = fold_moments(long_arms(outer, (arm,)), saved.sources, ("arm", "outer_fold"), floor=False)
    j = wald_discrepancy(m).select("outer_fold", "mu_t", "mu_s", "n_t", "n_s").join(
        weights.filter(F.col("arm") == arm).select("outer_fold", "eta", F.col("wald").alias("w"), "penalty", "included"), "outer_fold")
    i = F.posexplode(F.array(*[F.lit(s) for s in saved.sources])).alias("j", "source")
    e = j.select("*", i)
    at = lambda c: F.get(c, F.col("j"))
    gap = at("mu_s") - F.col("mu_t")
    return e.groupBy("source").agg(
        F.avg(at("eta")).alias("weight"), F.stddev_samp(at("eta")).alias("fold_weight_sd"), F.avg(at("mu_s")).alias("source_estimate"), F.avg("mu_t").alias("target_estimate"),
        F.avg(at("w")).alias("wald_mean"), F.max(at("w")).alias("wald_max"), F.avg((at("penalty") > 0).cast("double")).alias("penalty_activation_fraction"),
        F.avg(at("included").cast("double")).alias("inclusion_fraction"), F.avg(F.abs(gap)).alias("discrepancy_mean_abs"), F.max(F.abs(gap)).alias("discrepancy_max_abs"))


def pairwise_table(saved: Saved, arm: int = 2) -> DataFrame:
    """Per source: its assisted estimate of the target, the target-only one and their squared gap. Predictions are pooled by target rows of the evaluation folds,
    corrections by source rows; the pairwise estimate carries no standard error of its own."""
    o, k = saved.options, len(saved.sources)
    own = saved.coef.filter(F.col("fold") == F.col("outer_fold"))
    m = arm_moments(score_stats(saved.data, own, saved.sources, o.family, [saved.radius], o.target_program, o.target_radius, inner=False), k, (arm,))
    nt = F.col("n_t")
    g = m.agg((F.sum(nt * F.col("mu_t")) / F.sum(nt)).alias("target"), *[f for i in range(k) for f in (
        (F.sum(nt * F.col("mu_pred")[i]) / F.sum(nt) + F.sum(F.col("n_s")[i] * F.col("delta")[i]) / F.sum(F.col("n_s")[i])).alias(f"e{i}"),)])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"e{i}").alias("estimate")) for i, s in enumerate(saved.sources)])).alias("s")
    return g.select("target", rows).select("s.source", "s.estimate", F.lit(None).cast("double").alias("se"), F.col("target").alias("target_estimate"),
                                           F.pow(F.col("target") - F.col("s.estimate"), 2).alias("gap_squared"))


def result_rows(result: DataFrame, label: str | None = None) -> DataFrame:
    """method, estimate, se and the interval; rows without a finite estimate and se keep NULLs."""
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = fin("estimate") & fin("se")
    on = lambda c: F.when(ok, c)
    z = C.Z_975 * F.col("se")
    return result.select((F.lit(label) if label else F.col("method")).alias("method"), on(F.col("estimate")).alias("estimate"), on(F.col("se")).alias("se"),
                         on(F.col("estimate") - z).alias("ci_lower"), on(F.col("estimate") + z).alias("ci_upper"))


def weight_table(weights: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(arm, fold, source): weight, Wald statistic, penalty and inclusion of every outer fold, and their means as fold `all`."""
    at = lambda c: F.get(c, F.col("j"))
    e = weights.select("arm", F.col("outer_fold").cast("string").alias("fold"), "eta", "wald", "penalty", "included", F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("j", "source"))
    e = e.select("arm", "fold", "source", at("eta").alias("weight"), at("wald").alias("wald"), at("penalty").alias("penalty"), at("included").cast("double").alias("inclusion"))
    mean = e.groupBy("arm", "source").agg(*[F.avg(c).alias(c) for c in ("weight", "wald", "penalty", "inclusion")])
    return e.unionByName(mean.withColumn("fold", F.lit("all")))


# -- weight bootstrap -------------------------------------------------------------------------------
def weight_bootstrap(saved: Saved, b: int = C.WEIGHT_BOOTSTRAP_REPLICATES, seed: int = 1, relearn: bool = True, lam=None) -> DataFrame:
    """(draw, fixed, relearned) estimates under exponential row masses; nuisance models stay fixed."""
    from ..operators.resample import _draw_sums
    if saved.options.aggregation != "common_tate" or (saved.options.cutoff_lambda if lam is None else lam) == "cv":
        raise ValueError("the weight bootstrap is defined for weights of the contrast with a fixed cutoff")
    outer, _ = split_scores(saved.scores)
    lo = long_arms(outer, (2,))
    w = settled(learn_weights(saved, (2,), lam).select("outer_fold", "eta"))
    k, n = len(saved.sources), saved.n_all
    pseudo = pseudo_values(lo, w, saved.sources, saved.sizes, n_eta=saved.options.k)
    # back to the scale of site means
    scale = F.create_map(*[F.lit(x) for s, c in saved.sizes.items() for x in (s, c / n)])[F.col("site")]
    fixed = fixed_weight_draws(pseudo.select("obs_id", "site", (F.col("value") * scale).alias("value")), b, seed).withColumnRenamed("estimate", "fixed")
    if not relearn:
        return fixed
    eta = relearned_weights(saved, b, seed, lam)
    # per (outer fold, site): mass sums of 1, phi, psi or correction, per draw
    vals = F.when(F.col("site") == C.TARGET, F.concat(F.array(F.lit(1.0), F.col("phi")), F.col("psi"))).otherwise(
        F.concat(F.array(F.lit(1.0), F.col("corr")), F.array(*[F.lit(0.0)] * k)))
    sums = _draw_sums(lo.select("obs_id", F.concat_ws("|", F.col("outer_fold").cast("string"), "site").alias("g"), vals.alias("v")), "g", "v", b, seed, "mass")
    parts, width = F.split("g", "\\|"), 2 + k
    e = sums.select(parts[0].cast("int").alias("outer_fold"), parts[1].alias("site"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("draw"), "vec")
    e = e.select("outer_fold", "site", "draw", F.slice("vec", F.col("draw") * width + 1, width).alias("v")).join(eta, ["outer_fold", "draw"])
    et = [F.col("eta")[i] for i in range(k)]
    top = sum([et[i] * F.col("v")[2 + i] for i in range(k)], (1 - sum(et[1:], et[0])) * F.col("v")[1])
    val = F.when(F.col("site") == C.TARGET, top)
    for i, s in enumerate(saved.sources):
        val = val.when(F.col("site") == s, et[i] * F.col("v")[1])
    site = e.groupBy("draw", "site").agg((F.sum(val) / F.sum(F.col("v")[0])).alias("r"))
    rel = site.groupBy("draw").agg(F.sum("r").alias("relearned"))
    return fixed.join(rel, "draw")


def relearned_weights(saved: Saved, b: int = C.WEIGHT_BOOTSTRAP_REPLICATES, seed: int = 1, lam=None) -> DataFrame:
    """(draw, outer_fold, eta, wald, included): the weights solved again under every draw's row masses."""
    o = saved.options
    sums = contrast_draw_sums(saved.data, saved.coef, saved.sources, o.family, saved.radius, b, seed, o.target_program, o.target_radius)
    m = reweighted_moments(settled(sums), saved.sources, b)
    # pooled with the draw's masses; sizes stay the row counts
    pooled = pool_weighted(m, len(saved.sources))
    return solve_weights(pooled, saved.options.cutoff_lambda if lam is None else lam, saved.options.screening).select("draw", "outer_fold", "eta", "wald", "included")


def bootstrap_sources(weights: DataFrame, sources: Sequence[str], by: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Per fold and source over the draws: mean and sd of the weight, share of draws that include the source, mean Wald statistic."""
    at = lambda c: F.get(c, F.col("j"))
    e = weights.select(*by, "eta", "wald", "included", F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("j", "source"))
    return e.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n_bootstrap"), F.avg(at("eta")).alias("weight_mean"), F.stddev_samp(at("eta")).alias("weight_sd"),
                                        F.avg(at("included").cast("double")).alias("inclusion_probability"), F.avg(at("wald")).alias("wald_mean"))


def pool_weighted(m: DataFrame, k: int) -> DataFrame:
    """Pooling of reweighted inner moments: fields weighted by mass, sizes by row counts."""
    as_mass = m.withColumns({"_nt": F.col("n_t"), "_ns": F.col("n_s"), "n_t": F.col("mass_t"), "n_s": F.col("mass_s")})
    keys = ["draw", "arm", "outer_fold"]
    pooled = pool_moments(as_mass, k, keys).drop("n_t", "n_s")
    n = m.groupBy(*keys).agg(F.sum("n_t").alias("n_t"), F.array(*[F.sum(F.col("n_s")[i]) for i in range(k)]).alias("n_s"))
    return pooled.join(n, keys)
