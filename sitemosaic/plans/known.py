"""Source-assisted estimate from supplied nuisances: no fitting, one moments row."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions import clip, linear_predictor, mean_response
from ..operators.moments import fold_moments
from ..operators.weights import aggregate_variance, solve_weights


def known_nuisance_dr(obs: DataFrame, alpha: Sequence[float], gamma: Mapping[str, Sequence[float]], family: str, arm: int, lam: float = C.WALD_LAMBDA,
                      propensity: str = "propensity") -> DataFrame:
    """obs(site, a, y, w, z, propensity of arm 1); alpha is shared by all sites, gamma per source.

    The target score keeps its mean: it is centred at the mean prediction.
    """
    sources, p = sorted(gamma), len(alpha) - 1
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    m = mean_response(linear_predictor("w", lit(alpha), p), family)
    pi = clip(propensity, *C.KNOWN_PROPENSITY_CLIP)
    pa = pi if arm == 1 else clip(1 - pi, *C.KNOWN_PROPENSITY_CLIP)
    t = F.col("site") == C.TARGET
    hit = F.col("a") == arm
    eta = F.lit(None).cast("double")
    for s in sources:
        eta = F.when(F.col("site") == s, linear_predictor("z", lit(gamma[s]), len(gamma[s]) - 1)).otherwise(eta)
    rows = obs.select(
        "site", F.lit(arm).alias("arm"), F.when(t, F.when(hit, (F.col("y") - m) / pa).otherwise(0.0) + m).alias("phi"), m.alias("_m"),
        F.when(t, F.array(*[m for _ in sources])).alias("psi"), F.when(~t, F.when(hit, F.exp(-eta) * (F.col("y") - m)).otherwise(0.0)).alias("corr"))
    mo = fold_moments(rows, sources, ("arm",))
    # the target estimate is the mean prediction; the score's second moment is taken about it
    c = rows.filter(t).agg(F.avg("_m").alias("_mt"), F.avg("phi").alias("_mp"))
    mo = mo.crossJoin(c).withColumns({"v_ot": F.greatest(F.col("v_ot") + (F.col("_mp") - F.col("_mt")) * (F.col("_mp") - F.col("_mt")), F.lit(C.VARIANCE_FLOOR)), "mu_t": F.col("_mt")})
    return aggregate_variance(solve_weights(mo.drop("_mt", "_mp"), lam))
