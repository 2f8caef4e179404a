"""Row scores: one broadcast join of coefficients, then column expressions.

A score row belongs to (observation, outer fold). Target rows carry the
doubly robust score of both arms and the predictions of all source models;
source rows carry their correction. Both arms sit on the same row, so their
contrast needs no join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..functions import clip, clip_outcome, clip_propensity, col, linear_predictor, logistic, mean_response, truncate
from .joins import sized

D, AD = T.DoubleType(), T.ArrayType(T.DoubleType())
SCORE_COEF = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("outer_fold", T.IntegerType()),
    T.StructField("t1", AD), T.StructField("t0", AD), T.StructField("m1", AD), T.StructField("m0", AD),
    T.StructField("models1", T.ArrayType(AD)), T.StructField("models0", T.ArrayType(AD)),
    T.StructField("g1", AD), T.StructField("g0", AD), T.StructField("al1", AD), T.StructField("al0", AD)])


def aipw(y, a, m, p, arm: int) -> Column:
    """m + 1[a = arm] (y - m) / max(p, lower clip)."""
    m = col(m)
    return m + F.when(col(a) == arm, (col(y) - m) / F.greatest(col(p), F.lit(C.PROPENSITY_CLIP[0]))).otherwise(0.0)


def inference_ratio(eta: Column, radius: float) -> Column:
    """Guarded exp(-truncated predictor)."""
    w = F.exp(-truncate(eta, radius))
    return clip(clip(w, *C.TILT_GUARD), *C.RATIO_CLIP)


def source_correction(y, a, eta_tilt, prediction, arm: int, radius: float) -> Column:
    """Zero for rows of the other arm; they still count in every mean."""
    return F.when(col(a) == arm, inference_ratio(col(eta_tilt), radius) * (col(y) - col(prediction))).otherwise(0.0)


# -- coefficient table -----------------------------------------------------------------
def score_coefficients(spark: SparkSession, pairs: Sequence[tuple[int, int, tuple[int, ...]]], sources: Sequence[str], gamma: dict, alpha: dict,
                       target_ps: dict, target_or: dict) -> tuple[DataFrame, int]:
    """One row per (site, fold, outer fold) with the coefficients scoring it.

    pairs: (fold, outer fold, excluded folds of the models). gamma/alpha are keyed
    (source, arm, excluded); target_ps/target_or (arm, excluded).
    """
    fl = lambda b: [float(v) for v in b]
    rows = []
    for fold, outer, d in pairs:
        models = [[fl(alpha[(s, a, d)]) for s in sources] for a in (1, 0)]
        rows.append((C.TARGET, fold, outer, fl(target_ps[(1, d)]), fl(target_ps[(0, d)]), fl(target_or[(1, d)]), fl(target_or[(0, d)]), *models,
                     None, None, None, None))
        for s in sources:
            rows.append((s, fold, outer, None, None, None, None, None, None, fl(gamma[(s, 1, d)]), fl(gamma[(s, 0, d)]), fl(alpha[(s, 1, d)]), fl(alpha[(s, 0, d)])))
    return spark.createDataFrame(rows, SCORE_COEF), len(rows)


def score_rows(data: DataFrame, coef: DataFrame, n_coef: int, p: int, k: int, family: str, radius: float = C.RADIUS, target_rule: str = "lasso",
               target_radius: float = C.RADIUS) -> DataFrame:
    """scores(obs_id, site, fold, outer_fold, phi1, phi0, psi1, psi0, corr1, corr0)."""
    j = data.join(sized(coef, n_coef, 8 * (p + 1) * (8 + 2 * k)), ["site", "fold"])
    t = F.col("site") == C.TARGET
    lp = lambda c, x: linear_predictor(x, c, p)
    if target_rule == "lasso":
        p1 = clip_propensity(logistic(lp("t1", "z")))
        prop = {1: p1, 0: 1 - p1}
        m = {a: clip_outcome(mean_response(lp(f"m{a}", "w"), family), family) for a in (1, 0)}
        phi = {a: aipw("y", "a", m[a], prop[a], a) for a in (1, 0)}
    else:
        prop = {a: logistic(clip(lp(f"t{a}", "z"), -target_radius, target_radius)) for a in (1, 0)}
        m = {a: mean_response(lp(f"m{a}", "w"), family) for a in (1, 0)}
        phi = {a: m[a] + F.when(F.col("a") == a, (F.col("y") - m[a]) / prop[a]).otherwise(0.0) for a in (1, 0)}
    psi = {a: F.array(*[mean_response(lp(F.col(f"models{a}")[i], "w"), family) for i in range(k)]) for a in (1, 0)}
    corr = {a: source_correction("y", "a", lp(f"g{a}", "z"), mean_response(lp(f"al{a}", "w"), family), a, radius) for a in (1, 0)}
    return j.select("obs_id", "site", "fold", "outer_fold", *[F.when(t, phi[a]).alias(f"phi{a}") for a in (1, 0)],
                    *[F.when(t, psi[a]).alias(f"psi{a}") for a in (1, 0)], *[F.when(~t, corr[a]).alias(f"corr{a}") for a in (1, 0)])


def long_arms(scores: DataFrame, arms: Sequence[int] = (1, 0, 2)) -> DataFrame:
    """Arm as a key: 1, 0, and 2 for the contrast of the same row. Narrow."""
    diff = F.zip_with("psi1", "psi0", lambda u, v: u - v)
    item = {1: (F.col("phi1"), F.col("psi1"), F.col("corr1")), 0: (F.col("phi0"), F.col("psi0"), F.col("corr0")),
            2: (F.col("phi1") - F.col("phi0"), diff, F.col("corr1") - F.col("corr0"))}
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), item[a][0].alias("phi"), item[a][1].alias("psi"), item[a][2].alias("corr")) for a in arms]))
    return scores.select("obs_id", "site", "fold", "outer_fold", s.alias("s")).select("obs_id", "site", "fold", "outer_fold", "s.*")


# -- diagnostics of the tilt at inference -------------------------------------------------
def clip_diagnostics(source: DataFrame, eta, arm: int, radius: float, by: Sequence[str] = ("site", "fold")) -> DataFrame:
    """Rows of the arm only: logits beyond the radius, guarded weights and ratios, extremes. Counters add up over folds."""
    e = col(eta)
    on = F.col("a") == arm
    raw = F.exp(-truncate(e, radius))
    guarded = clip(raw, *C.TILT_GUARD)
    n = F.count_if(on)
    return source.groupBy(*by).agg(
        n.alias("n_obs"), F.count_if(on & (F.abs(e) > radius)).alias("logit_truncated"),
        F.when(n > 0, F.count_if(on & (F.abs(e) > radius)) / n).otherwise(0.0).alias("logit_truncation_fraction"),
        F.count_if(on & (raw < C.TILT_GUARD[0])).alias("weight_min_clipped"), F.count_if(on & (raw > C.TILT_GUARD[1])).alias("weight_max_clipped"),
        F.count_if(on & (guarded < C.RATIO_CLIP[0])).alias("ratio_min_clipped"), F.count_if(on & (guarded > C.RATIO_CLIP[1])).alias("ratio_max_clipped"),
        F.max(F.when(on, F.abs(e)).otherwise(0.0)).alias("max_abs_logit"), F.max(F.when(on, raw).otherwise(0.0)).alias("max_raw_weight"))


def dr_clip_diagnostics(weights: DataFrame, weight: str = "raw_weight") -> DataFrame:
    """Over all sources: rows, clipped rows and share, worst site share, extremes before clipping."""
    w, (lo, hi) = F.col(weight), C.DR_WEIGHT_CLIP
    s = weights.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if((w < lo) | (w > hi)).alias("c"), F.min(w).alias("lo"), F.max(w).alias("hi"))
    return s.agg(F.sum("n").alias("n"), F.sum("c").alias("n_clipped"), (F.sum("c") / F.sum("n")).alias("fraction_clipped"),
                 F.max(F.col("c") / F.col("n")).alias("max_site_fraction_clipped"), F.min("lo").alias("min_before_clipping"), F.max("hi").alias("max_before_clipping"))
