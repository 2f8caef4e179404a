"""Moments of score rows per (arm, outer fold, fold), and their pooling over folds."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as C


def _arr(items):
    return F.array(*items)


def fold_moments(scores_long: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("arm", "outer_fold", "fold"), floor: bool = True) -> DataFrame:
    """One grouped pass over target and source rows together.

    Target: mean and variance of phi, means, variances and covariances of the K
    predictions (cross matrix with a zero diagonal). Source j: mean and variance of
    its corrections, zeros of the other arm included. Arm moments are floored, the
    contrast (arm 2) is not.
    """
    k = len(sources)
    psi = [F.col("psi")[i] for i in range(k)]
    src = [F.when(F.col("site") == s, F.col("corr")) for s in sources]
    aggs = [F.count("phi").alias("n_t"), F.avg("phi").alias("mu_t"), F.var_pop("phi").alias("v_ot")]
    aggs += [f for i in range(k) for f in (
        F.avg(psi[i]).alias(f"mp{i}"), F.var_pop(psi[i]).alias(f"vt{i}"), F.covar_pop("phi", psi[i]).alias(f"co{i}"),
        F.count(src[i]).alias(f"ns{i}"), F.avg(src[i]).alias(f"de{i}"), F.var_pop(src[i]).alias(f"vs{i}"))]
    aggs += [F.covar_pop(psi[i], psi[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    g = scores_long.groupBy(*keys).agg(*aggs)
    low = F.when(F.col("arm") == 2, F.lit(0.0)).otherwise(C.VARIANCE_FLOOR) if floor and "arm" in keys else F.lit(C.VARIANCE_FLOOR if floor else 0.0)
    cross = [_arr([F.lit(0.0) if i == j else F.col(f"x{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)]
    return g.select(
        *keys, "n_t", _arr([F.col(f"ns{i}") for i in range(k)]).alias("n_s"), "mu_t", _arr([F.col(f"mp{i}") for i in range(k)]).alias("mu_pred"),
        _arr([F.col(f"de{i}") for i in range(k)]).alias("delta"), _arr([F.col(f"mp{i}") + F.col(f"de{i}") for i in range(k)]).alias("mu_s"), "v_ot",
        _arr([F.greatest(F.col(f"vt{i}"), low) for i in range(k)]).alias("v_t"), _arr([F.greatest(F.col(f"vs{i}"), low) for i in range(k)]).alias("v_s"),
        _arr([F.col(f"co{i}") for i in range(k)]).alias("c_ot"), _arr(cross).alias("c_cross"))


def pool_moments(moments: DataFrame, k: int, keys: Sequence[str] = ("arm", "outer_fold")) -> DataFrame:
    """Concatenation of folds whose scores are centred fold by fold: size-weighted means of every field.

    Give it unfloored fold moments; target fields are weighted by target rows,
    source fields by source rows.
    """
    nt = F.col("n_t")
    wt = lambda c: F.sum(nt * c) / F.sum(nt)
    ns = lambda i: F.col("n_s")[i]
    ws = lambda c, i: F.sum(ns(i) * c) / F.sum(ns(i))
    aggs = [F.sum(nt).alias("n_t"), wt(F.col("mu_t")).alias("mu_t"), wt(F.col("v_ot")).alias("v_ot")]
    for i in range(k):
        aggs += [F.sum(ns(i)).alias(f"ns{i}"), wt(F.col("mu_pred")[i]).alias(f"mp{i}"), ws(F.col("delta")[i], i).alias(f"de{i}"),
                 wt(F.col("v_t")[i]).alias(f"vt{i}"), ws(F.col("v_s")[i], i).alias(f"vs{i}"), wt(F.col("c_ot")[i]).alias(f"co{i}")]
        aggs += [wt(F.col("c_cross")[i][j]).alias(f"x{i}_{j}") for j in range(i + 1, k)]
    g = moments.groupBy(*keys).agg(*aggs)
    cols = lambda p: _arr([F.col(f"{p}{i}") for i in range(k)])
    cross = _arr([_arr([F.lit(0.0) if i == j else F.col(f"x{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return g.select(*keys, "n_t", cols("ns").alias("n_s"), "mu_t", cols("mp").alias("mu_pred"), cols("de").alias("delta"),
                    _arr([F.col(f"mp{i}") + F.col(f"de{i}") for i in range(k)]).alias("mu_s"), "v_ot", cols("vt").alias("v_t"), cols("vs").alias("v_s"),
                    cols("co").alias("c_ot"), cross.alias("c_cross"))


def joint_moments(scores: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("outer_fold", "fold")) -> DataFrame:
    """Per site and fold: covariance of the (1 + 2K) columns of the two-arm problem (target rows), variances of source rows.

    Columns: target contrast, treated predictions minus treated score, control score
    minus control predictions. Only target rows are dense; source j touches its own
    two columns.
    """
    k = len(sources)
    cols = [F.col("phi1") - F.col("phi0")] + [F.col("psi1")[i] - F.col("phi1") for i in range(k)] + [F.col("phi0") - F.col("psi0")[i] for i in range(k)]
    q = 1 + 2 * k
    aggs = [F.count("phi1").alias("n_t")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(q) for j in range(i, q)]
    for i, s in enumerate(sources):
        on = lambda c: F.when(F.col("site") == s, c)  # noqa: B023,E731
        aggs += [F.count(on(F.col("corr1"))).alias(f"n{i}"), F.avg(on(F.col("corr1"))).alias(f"d1_{i}"), F.avg(on(F.col("corr0"))).alias(f"d0_{i}"),
                 F.var_pop(on(F.col("corr1"))).alias(f"v1_{i}"), F.var_pop(on(F.col("corr0"))).alias(f"v0_{i}"),
                 F.covar_pop(on(F.col("corr1")), on(F.col("corr0"))).alias(f"v10_{i}")]
    g = scores.groupBy(*keys).agg(*aggs)
    return g.select(*keys, "n_t", _arr([F.col(f"n{i}") for i in range(k)]).alias("n_s"), _arr([F.col(f"m{i}") for i in range(q)]).alias("mean"),
                    _arr([_arr([F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(q)]) for i in range(q)]).alias("cov"),
                    *[_arr([F.col(f"{n}_{i}") for i in range(k)]).alias(n) for n in ("d1", "d0", "v1", "v0", "v10")])


def pool_joint_moments(m: DataFrame, k: int, keys: Sequence[str] = ("outer_fold",)) -> DataFrame:
    """Pooled over folds: Q, l, constant and discrepancy of the two-arm quadratic, with N."""
    q, nt = 1 + 2 * k, F.col("n_t")
    wt = lambda c: F.sum(nt * c) / F.sum(nt)
    aggs = [F.sum(nt).alias("n_t")] + [wt(F.col("mean")[i]).alias(f"m{i}") for i in range(q)]
    aggs += [wt(F.col("cov")[i][j]).alias(f"c{i}_{j}") for i in range(q) for j in range(i, q)]
    for i in range(k):
        ns = F.col("n_s")[i]
        aggs.append(F.sum(ns).alias(f"n{i}"))
        aggs += [(F.sum(ns * F.col(n)[i]) / F.sum(ns)).alias(f"{n}_{i}") for n in ("d1", "d0", "v1", "v0", "v10")]
    g = m.groupBy(*keys).agg(*aggs)

    def cell(i, j):
        c = F.col(f"c{min(i, j)}_{max(i, j)}") / F.col("n_t")
        si, sj = (i - 1) % k, (j - 1) % k
        if i and j and si == sj:
            ai, aj = (i - 1) // k, (j - 1) // k
            v = F.col(f"v1_{si}") if (ai, aj) == (0, 0) else F.col(f"v0_{si}") if (ai, aj) == (1, 1) else -F.col(f"v10_{si}")
            c = c + v / F.col(f"n{si}")
        return c

    disc = [F.col(f"m{i}") + (F.col(f"d1_{i - 1}") if i <= k else -F.col(f"d0_{i - 1 - k}")) for i in range(1, q)]
    total = sum([F.col(f"n{i}") for i in range(k)], F.col("n_t"))
    return g.select(*keys, "n_t", total.alias("n_all"), _arr([_arr([cell(i, j) for j in range(1, q)]) for i in range(1, q)]).alias("q"),
                    _arr([cell(i, 0) for i in range(1, q)]).alias("l"), cell(0, 0).alias("constant"), _arr(disc).alias("discrepancy"))
