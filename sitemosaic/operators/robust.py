"""Robust summaries across candidate sources."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .cohort import range_slice


def pool_fold_moments(f: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Fold (n, mean, variance) to a site mean and the variance of that mean, between-fold part included."""
    by = list(by)
    m = f.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("n").alias("size"))
    d = f.join(m.withColumnRenamed("mean", "_m"), by)
    dev = F.col("mean") - F.col("_m")
    v = d.groupBy(*by).agg((F.sum(F.col("n") * (F.col("variance") + dev * dev)) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("variance"))
    return m.join(v, by)


def pool_fold_cross_covariance(f: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Same for the covariance of two arms' fold means (mean1, mean0, covariance, n)."""
    by = list(by)
    n = F.col("n")
    m = f.groupBy(*by).agg((F.sum(n * F.col("mean1")) / F.sum("n")).alias("_m1"), (F.sum(n * F.col("mean0")) / F.sum("n")).alias("_m0"))
    d = f.join(m, by)
    prod = (F.col("mean1") - F.col("_m1")) * (F.col("mean0") - F.col("_m0"))
    return d.groupBy(*by).agg((F.sum(n * (F.col("covariance") + prod)) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("cross_covariance"))


def candidate_agreement(scores: DataFrame, k: int, psi: str = "psi") -> DataFrame:
    """Agreement of k candidates' predictions on the same rows; needs k >= 2."""
    if k < 2:
        raise ValueError("agreement needs at least two candidates")
    x = [F.col(psi)[i] for i in range(k)]
    common = sum(x[1:], x[0]) / k
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n = F.count(F.lit(1))
    sq = sum([(v - common) * (v - common) for v in x[1:]], (x[0] - common) * (x[0] - common))
    g = scores.agg(n.alias("n"), *[(F.covar_pop(x[i], x[j]) / n).alias(f"c_{i}_{j}") for i, j in pairs], (F.var_pop(common) / n).alias("common_variance"),
                   F.sqrt(F.avg(sq / k)).alias("prediction_disagreement_rmse"))
    c = lambda i, j: F.col(f"c_{min(i, j)}_{max(i, j)}")
    cells = [c(i, j) for i in range(k) for j in range(k)]
    tot = lambda xs: sum(xs[1:], xs[0])
    norm = F.sqrt(tot([v * v for v in cells]))
    gap = F.sqrt(tot([(v - F.col("common_variance")) * (v - F.col("common_variance")) for v in cells]))
    corr = [c(i, j) / F.sqrt(c(i, i) * c(j, j)) for i, j in pairs if i < j]
    low = F.least(*corr) if len(corr) > 1 else corr[0]
    return g.select("n", "common_variance", F.when(norm > 0, gap / norm).otherwise(0.0).alias("relative_covariance_error"),
                    low.alias("minimum_correlation"), "prediction_disagreement_rmse")


def arm_pairs(means: DataFrame, cov: DataFrame) -> DataFrame:
    """All treated x control contrasts. means(candidate, mu1, mu0); cov(arm1, candidate1, arm0, candidate0, covariance)
    with the within-arm variances as arm1 = arm0, candidate1 = candidate0."""
    var = lambda a: cov.filter((F.col("arm1") == a) & (F.col("arm0") == a) & (F.col("candidate1") == F.col("candidate0")))
    v1 = var(1).select(F.col("candidate1").alias("treated"), F.col("covariance").alias("v1"))
    v0 = var(0).select(F.col("candidate1").alias("control"), F.col("covariance").alias("v0"))
    cr = cov.filter("arm1 = 1 AND arm0 = 0").select(F.col("candidate1").alias("treated"), F.col("candidate0").alias("control"), F.col("covariance").alias("c"))
    a, b = means.select(F.col("candidate").alias("treated"), "mu1"), means.select(F.col("candidate").alias("control"), "mu0")
    j = a.crossJoin(b).join(v1, "treated").join(v0, "control").join(cr, ["treated", "control"], "left")
    v = F.greatest(F.col("v1") + F.col("v0") - 2 * F.coalesce("c", F.lit(0.0)), F.lit(0.0))
    return j.select("treated", "control", (F.col("mu1") - F.col("mu0")).alias("estimate"), v.alias("variance"), F.sqrt(v).alias("se"))


def quorum_intervals(iv: DataFrame, m: int, by: Sequence[str] = (), slices: int = 64) -> DataFrame:
    """Maximal regions covered by at least m closed intervals, per group.

    Endpoints are first merged per value, then counted over range slices with
    slice offsets, so a group with very many intervals is not ordered in one task.
    """
    by = list(by)
    if not by:
        iv, by = iv.withColumn("_all", F.lit(1)), ["_all"]
    ends = iv.select(*by, F.explode(F.array(F.struct(F.col("lower").alias("v"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                                            F.struct(F.col("upper").alias("v"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select(*by, "x.*")
    pts = ends.groupBy(*by, "v").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    cuts = ends.agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 1000)).first()[0] or [0.0]
    pts = pts.withColumn("_k", range_slice("v", cuts))
    per = pts.groupBy(*by, "_k").agg((F.sum("s") - F.sum("e")).alias("net"))
    off = per.select(*by, "_k", F.coalesce(F.sum("net").over(W.partitionBy(*by).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = W.partitionBy(*by, "_k").orderBy("v")
    run = F.sum(F.col("s") - F.col("e")).over(w.rowsBetween(W.unboundedPreceding, 0))
    c = pts.join(off, [*by, "_k"]).withColumn("right", F.col("_off") + run)
    c = c.withColumn("left", F.col("right") - F.col("s") + F.col("e")).withColumn("at", F.col("left") + F.col("s"))
    # an opening endpoint reaches the quorum, a closing one leaves it; opens and closes alternate, so an opening pairs with the next event
    opens, closes = (F.col("left") < m) & (F.col("at") >= m), (F.col("at") >= m) & (F.col("right") < m)
    kinds = F.filter(F.array(F.when(opens, F.lit(0)), F.when(closes, F.lit(1))), lambda x: x.isNotNull())
    event = c.filter(opens | closes).select(*by, "_k", "v", F.explode(kinds).alias("close"))
    here = event.withColumn("_next", F.lead("v").over(W.partitionBy(*by, "_k").orderBy("v", "close")))
    # a slice's last opening closes at the first event of the next slice that has any; one row per group and slice
    firsts = event.groupBy(*by, "_k").agg(F.min("v").alias("_first"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_k")
    grid = firsts.select(*by).distinct().select(*by, every)
    later = W.partitionBy(*by).orderBy("_k").rowsBetween(1, W.unboundedFollowing)
    carried = grid.join(firsts, [*by, "_k"], "left").select(*by, "_k", F.min("_first").over(later).alias("_later"))
    out = here.filter("close = 0").join(carried, [*by, "_k"]).select(*by, F.col("v").alias("lower"), F.coalesce("_next", "_later").alias("upper"))
    return out.drop("_all")


def bounded_dispersion(sums: DataFrame, score_range: float, alpha: float = 0.05, valid_min: int = 1, reference_fraction: float = 0.5,
                       dispersion_fraction: float = 0.5) -> DataFrame:
    """Between-source dispersion beyond within noise, its one-sided bound, and the combined interval.

    sums(site, role, total, total_sq, n): one target row and K source rows of equal n.
    """
    src, t = F.col("role") == "source", F.col("role") == "target"
    n, s, q = F.col("n"), F.col("total"), F.col("total_sq")
    on = lambda x: F.when(src, x)
    g = sums.agg(
        F.count_if(src).alias("k"), F.max(on(n)).cast("double").alias("n"), F.avg(on((s * s - q) / (n * (n - 1)))).alias("within"),
        F.sum(on(s / n)).alias("sm"), F.sum(on(s * s / (n * n))).alias("sm2"), F.max(F.when(t, n)).cast("double").alias("nt"),
        F.max(F.when(t, s)).alias("ts"), F.sum(on(s)).alias("ss"))
    k = F.col("k")
    vu, r = score_range * score_range / 4.0, score_range
    frob = 1 / (k * F.col("n") * (F.col("n") - 1)) + 1 / (k * (k - 1) * F.col("n") * F.col("n"))
    g = g.withColumns({"statistic": F.col("within") - (F.col("sm") * F.col("sm") - F.col("sm2")) / (k * (k - 1)), "pooled_mean": F.col("sm") / k,
                       "_lin": 4 * vu / ((k - 1) * F.col("n")), "_null": 2 * vu * vu * frob})
    sa = alpha * (1 - reference_fraction)
    mult = (1 - sa * dispersion_fraction) / (sa * dispersion_fraction)
    lin, con, obs = mult * F.col("_lin"), mult * F.col("_null"), F.col("statistic")
    zero = F.lit(0.0)
    upper = F.greatest(zero, obs + lin / 2 + F.sqrt(F.greatest(zero, lin * obs + lin * lin / 4 + con)))
    g = g.withColumn("dispersion_upper", upper)
    bias = (k - valid_min) * (k - 1) / (F.lit(float(valid_min)) * k) if valid_min else F.lit(0.0)
    srad = r * F.sqrt(F.lit(math.log(2 / (sa * (1 - dispersion_fraction)))) / (2 * k * F.col("n"))) + F.sqrt(bias * F.col("dispersion_upper"))
    trad = r * F.sqrt(F.lit(math.log(2 / (alpha * reference_fraction))) / (2 * F.col("nt")))
    tm = F.col("ts") / F.col("nt")
    lo, hi = F.greatest(F.col("pooled_mean") - srad, tm - trad), F.least(F.col("pooled_mean") + srad, tm + trad)
    # disjoint intervals: keep the shorter one
    src_short = srad <= trad
    empty = lo > hi
    g = g.withColumns({"empty_intersection": empty, "lower": F.when(empty, F.when(src_short, F.col("pooled_mean") - srad).otherwise(tm - trad)).otherwise(lo),
                       "upper": F.when(empty, F.when(src_short, F.col("pooled_mean") + srad).otherwise(tm + trad)).otherwise(hi)})
    g = g.withColumn("estimate", (F.col("lower") + F.col("upper")) / 2)
    return g.select("k", "statistic", "pooled_mean", "dispersion_upper", "estimate", "lower", "upper", "empty_intersection")
