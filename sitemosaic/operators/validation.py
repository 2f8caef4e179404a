"""Contracts, each checked by one aggregate job whose result has one row per site."""
from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, functions as F

from ..constants import TARGET


def cohort_violations(obs: DataFrame, family: str = "binomial") -> DataFrame:
    """Per site: rows breaking the contract, and arm sizes."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    y_bad = bad(F.col("y")) if family == "gaussian" else bad(F.col("y")) | ~F.col("y").isin(0.0, 1.0)
    return obs.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.exists("w", bad) | F.exists("z", bad)).alias("bad_features"),
        F.count_if(F.col("a").isNull() | ~F.col("a").isin(0, 1)).alias("bad_treatment"),
        F.count_if(y_bad).alias("bad_outcome"),
        F.count_if(F.col("a") == 1).alias("treated"), F.count_if(F.col("a") == 0).alias("control"),
        F.min(F.size("w")).alias("p_min"), F.max(F.size("w")).alias("p_max"))


def validate_cohort(obs: DataFrame, family: str = "binomial", arms=(0, 1)) -> list:
    if family not in ("binomial", "gaussian"):
        raise ValueError(f"unsupported family {family!r}")
    rows = cohort_violations(obs, family).collect()
    sites = {r["site"] for r in rows}
    if TARGET not in sites:
        raise ValueError("target site not found")
    if len(sites) < 2:
        raise ValueError("no source sites found")
    for r in rows:
        for field in ("bad_features", "bad_treatment", "bad_outcome"):
            if r[field]:
                raise ValueError(f"site {r['site']}: {r[field]} rows with {field.replace('_', ' ')}")
        for a in arms:
            if not r["treated" if a == 1 else "control"]:
                raise ValueError(f"site {r['site']}: no rows in arm {a}")
    if len({(r["p_min"], r["p_max"]) for r in rows}) != 1 or rows[0]["p_min"] != rows[0]["p_max"]:
        raise ValueError("every site must have the same features")
    return rows


def fold_capacity(obs: DataFrame, k: int, arm: int, critical: int = 3, advised: int = 5) -> DataFrame:
    n, n_arm = F.count(F.lit(1)), F.count_if(F.col("a") == arm)
    return obs.groupBy("site").agg(n.alias("n"), n_arm.alias("n_arm")).select(
        "site", "n", "n_arm", F.when((F.col("n") < k * critical) | (F.col("n_arm") < k * critical), "error")
        .when(F.col("n") < k * advised, "warning").otherwise("ok").alias("status"))


def validate_folds(obs: DataFrame, k: int, arm: int) -> None:
    if k < 2:
        raise ValueError("at least two folds are required")
    if k == 2:
        warnings.warn("two folds give unstable variances; three or more are advised")
    for r in fold_capacity(obs, k, arm).collect():
        if r["status"] == "error":
            raise ValueError(f"site {r['site']}: {r['n']} rows, {r['n_arm']} in arm {arm}: too few for {k} folds")
        if r["status"] == "warning":
            warnings.warn(f"site {r['site']}: {r['n']} rows may be too few for {k} folds")


def not_scored_once(scores: DataFrame, expected: DataFrame, keys=("obs_id",)) -> DataFrame:
    """Observations whose number of scores differs from one."""
    n = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    j = expected.select(*keys).join(n, list(keys), "full_outer")
    return j.select(*keys, F.coalesce("times", F.lit(0)).alias("times")).filter("times <> 1")


def assert_scored_once(scores: DataFrame, expected: DataFrame, keys=("obs_id",)) -> None:
    bad = not_scored_once(scores, expected, keys).limit(1).collect()
    if bad:
        raise ValueError(f"folds must score every observation exactly once; first offender {bad[0].asDict()}")


def groups_across_folds(obs: DataFrame, fold: str = "fold", group: str = "group_id") -> DataFrame:
    """Units found in more than one fold (min/max instead of a distinct count: no group state)."""
    g = obs.filter(F.col(group).isNotNull()).groupBy("site", group).agg(F.min(fold).alias("f0"), F.max(fold).alias("f1"))
    return g.filter("f0 <> f1").select("site", group)


def assert_groups_in_fold(obs: DataFrame, fold: str = "fold", group: str = "group_id") -> None:
    if groups_across_folds(obs, fold, group).limit(1).collect():
        raise ValueError("a repeated unit crosses outer folds")


def validate_radius(fit: float, inference: float | None = None) -> tuple[float, float]:
    inference = fit if inference is None else inference
    for r in (fit, inference):
        if not isinstance(r, (int, float)) or isinstance(r, bool) or math.isnan(r) or r <= 0:
            raise ValueError("truncation radii must be positive")
    return float(fit), float(inference)
