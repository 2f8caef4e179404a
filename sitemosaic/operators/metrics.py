"""Run-metrics analytics: tables of results in, grouped summaries and checks out."""
from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import constants as C
from ..functions import finite, group_key as key_expr, parse_bool
from .cohort import grouped_quantiles
from .joins import attach

# Columns that tell settings apart, where a table has them.
SETTING_COLUMNS = (
    "experiment", "dgp_type", "dgp_version", "dgp_configuration", "working_dimension", "truth_method", "outcome_family", "config", "heterogeneity_type",
    "estimand_type", "p", "K", "rho", "cutoff", "n_site", "n_folds", "nlambda_init", "nuisance_lambda_rule", "target_nuisance_method", "source_validation_method",
    "source_nuisance_method", "aggregation_mode", "calibration_layout", "roce_variance_method", "compiled_nuisance_solver", "nuisance_cv_certificate", "nuisance_tol",
    "nuisance_training_policy", "roce_crossfit_levels", "calibration_recipe", "target_propensity_initialization", "target_training_radius", "target_inference_radius",
    "baseline_inference_policy", "n_bootstrap", "n_weight_bootstrap", "M_tau", "M_tau_inference", "estimand_scope", "deviation_mechanism")

# --- fixed values: names of the quality flags, in reporting order, and their classes ---
IMPLEMENTATION_FLAGS = (
    "incomplete_replications", "excess_replications", "duplicated_replications", "nonfinite_values", "invalid_replication_id",
    "invalid_confidence_interval", "bias_truth_inconsistent", "ci_arithmetic_inconsistent", "nonpositive_standard_error",
    "coverage_ci_inconsistent", "rmse_identity_failed", "invalid_nuisance_diagnostics", "nuisance_nonconvergence_detected",
    "nuisance_density_ratio_boundary_detected", "nuisance_outcome_boundary_detected", "invalid_weight_optimizer_diagnostics",
    "invalid_direct_tate_diagnostics", "invalid_bootstrap_diagnostics", "invalid_weight_relearn_bootstrap_diagnostics",
    "weight_relearn_bootstrap_failures_detected", "invalid_cell_diagnostics", "invalid_dr_weight_diagnostics",
    "inference_safety_clipping_detected")
REVIEW_FLAGS = (
    "coverage_below_mc_band", "coverage_above_mc_band", "se_empirical_ratio_low", "se_empirical_ratio_high", "bias_exceeds_2_mcse",
    "extreme_aggregation_weight", "sparse_binary_cells_detected", "density_ratio_clipping_detected", "nuisance_cv_candidates_excluded",
    "nuisance_line_search_failures_detected")
# ---------------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)) if pd.notna(v) else None).astype("float64")


def settings(df: DataFrame) -> list[str]:
    return [c for c in SETTING_COLUMNS if c in df.columns]


def group_key(r: DataFrame, cols: Sequence[str]) -> DataFrame:
    return r.withColumns({c: key_expr(c) for c in cols})


def _rmse(c) -> Column:
    return F.sqrt(F.avg(c * c))


def summarize_results(r: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Per setting and method: bias, rmse, mean se, coverage, interval width. NULL keys drop their rows; NULL values are ignored."""
    keys = list(keys) if keys else ["method", *settings(r)]
    r = r.dropna(subset=keys)
    b, cov = finite("bias"), F.col("coverage").cast("boolean").cast("double")
    return r.groupBy(*keys).agg(
        F.avg(b).alias("bias_mean"), F.stddev_samp(b).alias("bias_sd"), _rmse(b).alias("rmse"), F.avg(finite("se")).alias("se_mean"),
        F.avg(cov).alias("coverage"), F.avg(finite("ci_width")).alias("ci_width_mean"), F.stddev_samp(finite("ci_width")).alias("ci_width_sd"),
        F.count(finite("estimate")).alias("n_success"))


def mc_errors(s: DataFrame, reference: bool = True) -> DataFrame:
    """Monte-Carlo errors, se/sd ratio and normal-reference coverage of a summary."""
    n = F.col("n_success")
    out = s.withColumns({
        "bias_mcse": F.col("bias_sd") / F.sqrt(n), "coverage_mcse": F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / n),
        "se_to_empirical_sd": F.when(F.col("bias_sd") > 0, F.col("se_mean") / F.col("bias_sd"))})
    if not reference:
        return out
    z = C.Z_975 * F.col("se_mean")
    hi = F.when(F.col("bias_sd") > 0, (z - F.col("bias_mean")) / F.col("bias_sd"))
    lo = F.when(F.col("bias_sd") > 0, (-z - F.col("bias_mean")) / F.col("bias_sd"))
    return out.withColumn("normal_reference_coverage", normal_cdf(hi) - normal_cdf(lo))


def _optional(r: DataFrame, name: str) -> Column:
    return finite(name) if name in r.columns else F.lit(None).cast("double")


STAGES = ("initial_dr", "calibrated_dr", "calibrated_outcome")


def _whole(x: Column, low: float = 0.0) -> Column:
    return x.isNull() | ((x >= low) & (x == F.floor(x)))


def nuisance_aggregates(r: DataFrame, prefix: str = "fit_") -> dict[str, Column]:
    """Totals of counters and maxima of magnitudes over the replications of a group."""
    cols = {m: [_optional(r, f"{prefix}{s}_{m}") for s in STAGES]
            for m in ("nonconverged", "line_search_failures", "cv_invalid_fold_fits", "support_floor_applied")}
    out = {}
    for m, xs in cols.items():
        for s, x in zip(STAGES, xs):
            out[f"{s}_{m}_total"] = F.sum(x)
    for s in STAGES:
        for m in ("iterations", "update_ratio", "abs_coefficient"):
            out[f"max_{s}_{m}"] = F.max(_optional(r, f"{prefix}max_{s}_{m}"))
    primary = cols["nonconverged"]
    every = [x for xs in cols.values() for x in xs]
    out["diagnostic_replications"] = F.count_if(F.coalesce(*every).isNotNull())
    out["nonconverged_replications"] = F.count_if(sum([F.coalesce(x, F.lit(0.0)) for x in primary[1:]], F.coalesce(primary[0], F.lit(0.0))) > 0)
    out["nonconverged_fits_total"] = F.coalesce(F.sum(sum([F.coalesce(x, F.lit(0.0)) for x in primary[1:]], F.coalesce(primary[0], F.lit(0.0)))), F.lit(0.0))
    bad = ~_whole(every[0])
    for x in every[1:]:
        bad = bad | ~_whole(x)
    out["invalid_nuisance"] = F.count_if(bad) > 0
    return out


def nuisance_rollup(r: DataFrame, keys: Sequence[str], prefix: str = "fit_") -> DataFrame:
    return r.groupBy(*keys).agg(*[c.alias(n) for n, c in nuisance_aggregates(r, prefix).items()])


BOOTSTRAP_COLUMNS = ("n_weight_bootstrap", "variance_relearn", "se_relearn", "se_fixed", "uncertainty_ratio", "bootstrap_failures")


def bootstrap_aggregates(r: DataFrame, tolerance: float = 1e-10) -> dict[str, Column]:
    """Weight-bootstrap diagnostics: valid rows, means, failures, identity errors, schema completeness."""
    present = [c for c in BOOTSTRAP_COLUMNS if c in r.columns]
    n, var, relearn, fixed, ratio, fails = [_optional(r, c) for c in BOOTSTRAP_COLUMNS]
    valid = ((n >= 2) & (n == F.floor(n)) & (var > 0) & (relearn > 0) & (fixed > 0) & (ratio > 0) & (fails >= 0) & (fails <= n)
             & (fails == F.floor(fails)))
    valid = F.coalesce(valid, F.lit(False))
    ev = F.max(F.when(valid, F.abs(var - relearn * relearn)))
    er = F.max(F.when(valid, F.abs(ratio - relearn / fixed)))
    off = F.count_if(F.coalesce(n, F.lit(0.0)) == 0) == F.count(F.lit(1))
    any_value = F.count(F.coalesce(var, relearn, fixed, ratio, fails)) > 0
    invalid = F.lit(0 < len(present) < len(BOOTSTRAP_COLUMNS)) | (off & any_value) | (
        ~off & ((F.count_if(valid) < F.count(F.lit(1))) | (ev > tolerance) | (er > tolerance)))
    return {"bootstrap_replications": F.count_if(valid), "mean_se_relearn": F.avg(F.when(valid, relearn)),
            "mean_se_fixed": F.avg(F.when(valid, fixed)), "mean_uncertainty_ratio": F.avg(F.when(valid, ratio)),
            "bootstrap_failures_total": F.coalesce(F.sum(F.when(valid, fails)), F.lit(0.0)),
            "variance_identity_error": ev, "ratio_identity_error": er, "invalid_bootstrap": F.coalesce(invalid, F.lit(False))}


def bootstrap_rollup(r: DataFrame, keys: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    return r.groupBy(*keys).agg(*[c.alias(n) for n, c in bootstrap_aggregates(r, tolerance).items()])


METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession, most: int = 8000) -> None:
    """Lowers the session's bound on the bytes of a generated method to what the JVM compiles: the aggregates below make a longer one, which it would interpret."""
    if int(spark.conf.get(METHOD_SETTING, "65535")) > most:
        spark.conf.set(METHOD_SETTING, str(most))


def diagnose_results(r: DataFrame, expected: int = 200, nominal: float = 0.95, mc_level: float = 0.95,
                     se_limits: tuple[float, float] = (0.85, 1.15), tolerance: float = 1e-10, keys: Sequence[str] | None = None,
                     z: float = C.Z_975, reference: bool = True) -> DataFrame:
    """Replication counts, moments, Monte-Carlo bands, identity errors and the flag status per setting and method.

    NULL and blank keys are kept as one visible group.
    """
    from statistics import NormalDist
    keys = list(keys) if keys else ["method", *settings(r)]
    r = group_key(r, keys)
    have = set(r.columns)
    ci, truth = {"ci_lower", "ci_upper"} <= have, "truth" in have
    cov = parse_bool(F.col("coverage"))
    est, bias, se = finite("estimate"), finite("bias"), finite("se")
    lo, hi = (finite("ci_lower"), finite("ci_upper")) if ci else (F.lit(0.0), F.lit(0.0))
    tr = finite("truth") if truth else F.lit(0.0)
    sid = finite("sim_id") if "sim_id" in have else F.lit(1.0)
    ordered = lo.isNotNull() & hi.isNotNull() & F.coalesce(lo <= hi, F.lit(False))
    valid_id = F.coalesce((sid >= 1) & (sid == F.floor(sid)), F.lit(False))
    d = r.withColumns({"_est": est, "_bias": bias, "_se": se, "_lo": lo, "_hi": hi, "_tr": tr, "_cov": cov, "_ord": ordered, "_vid": valid_id})
    ok = (F.col("_est").isNotNull() & F.col("_bias").isNotNull() & F.col("_se").isNotNull() & F.col("_cov").isNotNull() & F.col("_tr").isNotNull()
          & F.col("_ord") & F.col("_vid"))
    d = d.withColumn("_ok", ok)
    on = lambda c: F.when(F.col("_ok"), c)
    b = on(F.col("_bias"))
    ci_err = F.greatest(F.abs(F.col("_lo") - (F.col("_est") - z * F.col("_se"))), F.abs(F.col("_hi") - (F.col("_est") + z * F.col("_se"))))
    if "ci_width" in have:
        ci_err = F.greatest(ci_err, F.abs(finite("ci_width") - (F.col("_hi") - F.col("_lo"))))
    covered = (F.col("_tr") >= F.col("_lo")) & (F.col("_tr") <= F.col("_hi"))
    mism = F.count_if(F.col("_ord") & F.col("_tr").isNotNull() & F.col("_cov").isNotNull() & (covered != F.col("_cov")))
    weight, iters, ridge = (_optional(r, c) for c in ("max_abs_source_weight", "max_weight_optimizer_iterations", "max_weight_psd_ridge"))
    clip, drfrac = _optional(r, "inference_safety_clip_count"), _optional(r, "dr_weight_fraction_clipped")
    cell, tcell, sparse = (_optional(r, c) for c in ("min_site_arm_outcome_cell_n", "min_target_arm_outcome_cell_n", "n_site_arm_outcome_cells_below_8"))
    drn, drc = _optional(r, "dr_weight_n"), _optional(r, "dr_weight_n_clipped")
    bad_cell = ~_whole(cell) | ~_whole(tcell) | ~_whole(sparse) | F.coalesce(cell > tcell, F.lit(False))
    bad_dr = F.coalesce((drfrac < 0) | (drfrac > 1) | (drn < 1) | (drc > drn) | (F.abs(drfrac - drc / drn) > tolerance), F.lit(False))
    bad_direct = F.coalesce((weight < 0) | (_optional(r, "mean_abs_source_weight") > weight) |
                            (_optional(r, "mean_wald_statistic") > _optional(r, "max_wald_statistic")), F.lit(False))
    present = F.count(F.col("sim_id")) if "sim_id" in have else F.count(F.lit(1))
    aggs = {
        "n_rows": F.count(F.lit(1)), "_present": present, "n_complete_replications": F.count_if(F.col("_ok")), "n_invalid_replication_ids": F.count_if(~F.col("_vid")),
        "bias": F.avg(b), "empirical_sd": F.stddev_samp(b), "bias_skewness": F.skewness(b), "bias_excess_kurtosis": F.kurtosis(b),
        "mean_se": F.avg(on(F.col("_se"))), "rmse": _rmse(b), "coverage": F.avg(on(F.col("_cov").cast("double"))),
        "truth_below_interval_fraction": F.avg(on((F.col("_tr") < F.col("_lo")).cast("double"))),
        "truth_above_interval_fraction": F.avg(on((F.col("_tr") > F.col("_hi")).cast("double"))),
        "bias_identity_error": F.max(F.abs(F.col("_bias") - (F.col("_est") - F.col("_tr")))) if truth else F.lit(None).cast("double"),
        "ci_arithmetic_error": F.max(ci_err) if ci else F.lit(None).cast("double"),
        "_mism": mism if ci and truth else F.lit(0), "_np": F.count_if(F.col("_se") <= 0), "_unord": F.count_if(~F.col("_ord")) if ci else F.lit(0),
        "max_abs_source_weight_observed": F.max(weight), "_badopt": F.count_if((iters < 1) | (ridge < 0)), "_clip": F.sum(clip),
        "_sparse": F.count_if(sparse > 0), "_drclip": F.count_if(drfrac > 0), "_badcell": F.count_if(bad_cell), "_baddr": F.count_if(bad_dr),
        "_baddirect": F.count_if(bad_direct), **{f"_n_{k}": v for k, v in nuisance_aggregates(r).items()},
        **{f"_b_{k}": v for k, v in bootstrap_aggregates(r, tolerance).items()},
    }
    compiled_methods(r.sparkSession)
    g = d.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if "sim_id" in have:
        # ids are counted apart: in one aggregate with the rest, every id of a group would carry all sums through a shuffle
        ids = r.filter(F.col("sim_id").isNotNull()).select(*keys, "sim_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_unique"))
        g = g.join(ids, keys, "left").withColumn("n_unique_replications", F.coalesce("_unique", F.lit(0)))
    else:
        g = g.withColumn("n_unique_replications", F.col("_present"))
    g = g.withColumn("n_duplicate_replications", F.col("_present") - F.col("n_unique_replications"))
    n = F.col("n_complete_replications")
    zmc = NormalDist().inv_cdf(1 - (1 - mc_level) / 2)
    band = zmc * F.sqrt(F.lit(nominal * (1 - nominal)) / n)
    g = g.withColumns({
        "expected_replications": F.lit(expected), "bias_mcse": F.col("empirical_sd") / F.sqrt(n),
        "coverage_mcse": F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / n),
        "coverage_mc_lower": F.when(n > 0, F.greatest(F.lit(0.0), nominal - band)), "coverage_mc_upper": F.when(n > 0, F.least(F.lit(1.0), nominal + band)),
        "se_to_empirical_sd": F.when(F.col("empirical_sd") > 0, F.col("mean_se") / F.col("empirical_sd")),
        "rmse_from_moments": F.when(n > 1, F.sqrt(F.col("bias") * F.col("bias") + (n - 1) / n * F.col("empirical_sd") * F.col("empirical_sd")))
        .when(n == 1, F.abs("bias"))}).withColumn("rmse_identity_error", F.abs(F.col("rmse") - F.col("rmse_from_moments")))
    if reference:
        sd = F.when(F.col("empirical_sd") > 0, F.col("empirical_sd"))
        g = g.withColumn("normal_reference_coverage", normal_cdf((z * F.col("mean_se") - F.col("bias")) / sd) - normal_cdf((-z * F.col("mean_se") - F.col("bias")) / sd))
    return flag_status(g, se_limits, tolerance)


def _total(*names) -> Column:
    return sum([F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]], F.coalesce(F.col(names[0]), F.lit(0.0)))


def flag_status(g: DataFrame, se_limits: tuple[float, float] = (0.85, 1.15), tolerance: float = 1e-10) -> DataFrame:
    """`;`-joined active flags, or ok, and the coverage reading; drops the working columns."""
    c = F.col
    flags = {
        "incomplete_replications": c("n_unique_replications") < c("expected_replications"),
        "excess_replications": c("n_unique_replications") > c("expected_replications"),
        "duplicated_replications": c("n_duplicate_replications") > 0, "invalid_replication_id": c("n_invalid_replication_ids") > 0,
        "nonfinite_values": c("n_complete_replications") < c("n_rows"), "nonpositive_standard_error": c("_np") > 0,
        "invalid_confidence_interval": c("_unord") > 0, "bias_truth_inconsistent": c("bias_identity_error") > tolerance,
        "ci_arithmetic_inconsistent": c("ci_arithmetic_error") > tolerance, "coverage_ci_inconsistent": c("_mism") > 0,
        "rmse_identity_failed": c("rmse_identity_error") > tolerance, "invalid_nuisance_diagnostics": c("_n_invalid_nuisance"),
        "nuisance_nonconvergence_detected": c("_n_nonconverged_fits_total") > 0,
        "nuisance_line_search_failures_detected": _total(*[f"_n_{s}_line_search_failures_total" for s in STAGES]) > 0,
        "nuisance_cv_candidates_excluded": _total(*[f"_n_{s}_cv_invalid_fold_fits_total" for s in STAGES]) > 0,
        "invalid_weight_optimizer_diagnostics": c("_badopt") > 0, "invalid_direct_tate_diagnostics": c("_baddirect") > 0,
        "invalid_bootstrap_diagnostics": F.lit(False), "invalid_weight_relearn_bootstrap_diagnostics": c("_b_invalid_bootstrap"),
        "weight_relearn_bootstrap_failures_detected": c("_b_bootstrap_failures_total") > 0, "invalid_cell_diagnostics": c("_badcell") > 0,
        "invalid_dr_weight_diagnostics": c("_baddr") > 0, "sparse_binary_cells_detected": c("_sparse") > 0,
        "density_ratio_clipping_detected": c("_drclip") > 0, "inference_safety_clipping_detected": c("_clip") > 0,
        "extreme_aggregation_weight": c("max_abs_source_weight_observed") > 10, "coverage_below_mc_band": c("coverage") < c("coverage_mc_lower"),
        "coverage_above_mc_band": c("coverage") > c("coverage_mc_upper"), "se_empirical_ratio_low": c("se_to_empirical_sd") < se_limits[0],
        "se_empirical_ratio_high": c("se_to_empirical_sd") > se_limits[1],
        "bias_exceeds_2_mcse": (c("bias_mcse") > 0) & (F.abs("bias") > 2 * c("bias_mcse")),
    }
    joined = F.concat_ws(";", *[F.when(v, n) for n, v in flags.items()])
    on = {n: F.coalesce(flags[n], F.lit(False)) for n in ("coverage_below_mc_band", "coverage_above_mc_band", "se_empirical_ratio_low",
                                                          "se_empirical_ratio_high", "bias_exceeds_2_mcse")}
    biased, low, high = on["bias_exceeds_2_mcse"], on["se_empirical_ratio_low"], on["se_empirical_ratio_high"]
    reading = (F.when(c("coverage").isNull(), "not_evaluable")
               .when(on["coverage_below_mc_band"], F.when(biased & low, "bias_and_se_underestimation")
                     .when(biased & high, "centering_bias_despite_conservative_se").when(biased, "primarily_centering_bias")
                     .when(low, "primarily_se_underestimation").otherwise("unresolved_finite_sample_shape"))
               .when(on["coverage_above_mc_band"], F.when(high, "primarily_se_overestimation").otherwise("unresolved_finite_sample_shape"))
               .otherwise("within_nominal_mc_band"))
    out = g.withColumns({"coverage_diagnosis": reading, "diagnostic_status": F.when(joined == "", "ok").otherwise(joined)})
    keep = {f"_n_max_{s}_abs_coefficient": f"max_{s}_abs_coefficient" for s in STAGES}
    out = out.withColumnsRenamed(keep)
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def _append_flag(status: Column, flag: str, on: Column) -> Column:
    has = F.array_contains(F.split(F.coalesce(status, F.lit("")), ";"), flag)
    empty = status.isNull() | (status == "") | (status == "ok")
    return F.when(F.coalesce(on, F.lit(False)) & ~has, F.when(empty, F.lit(flag)).otherwise(F.concat(status, F.lit(";" + flag)))).otherwise(status)


def augment_qc(d: DataFrame, bound: float, frac: float = 0.9) -> DataFrame:
    """Adds flags for fitted coefficients close to the parameter bound."""
    if not bound > 0 or not 0 < frac < 1:
        raise ValueError("bound must be positive and frac strictly between 0 and 1")
    t = frac * bound
    near = lambda c: F.coalesce(finite(c) >= t, F.lit(False))
    ratio, outcome = near("max_initial_dr_abs_coefficient") | near("max_calibrated_dr_abs_coefficient"), near("max_calibrated_outcome_abs_coefficient")
    out = d.withColumns({"density_ratio_boundary": ratio, "outcome_boundary": outcome, "boundary_threshold": F.lit(t)})
    out = out.withColumn("diagnostic_status", _append_flag(F.col("diagnostic_status"), "nuisance_density_ratio_boundary_detected", F.col("density_ratio_boundary")))
    return out.withColumn("diagnostic_status", _append_flag(F.col("diagnostic_status"), "nuisance_outcome_boundary_detected", F.col("outcome_boundary")))


def classify_qc(d: DataFrame) -> DataFrame:
    flags = F.split(F.coalesce("diagnostic_status", F.lit("")), ";")
    return d.withColumns({n: F.arrays_overlap(flags, F.array(*[F.lit(x) for x in names])) for n, names in (
        ("implementation_failed", IMPLEMENTATION_FLAGS), ("statistical_review_required", REVIEW_FLAGS))})


def rank_rmse(d: DataFrame, keys: Sequence[str] | None = None, target: str = "target_only") -> DataFrame:
    """Rank of the RMSE within a setting (ties to the minimum, NULL unranked) and the ratio to the target-only RMSE."""
    keys = list(keys) if keys else settings(d)
    d = d.withColumn("rmse", finite("rmse"))
    w = W.partitionBy(*keys)
    is_t = F.col("method") == target
    n_t = F.sum(is_t.cast("int")).over(w)
    t = F.when(n_t == 1, F.max(F.when(is_t, F.col("rmse"))).over(w))
    r = F.rank().over(W.partitionBy(*keys, F.col("rmse").isNull()).orderBy("rmse"))
    return d.withColumns({"rmse_rank": F.when(F.col("rmse").isNotNull(), r), "rmse_relative_to_target": F.col("rmse") / t})


def paired_mse(r: DataFrame, method: str, benchmarks: Sequence[str], keys: Sequence[str] | None = None, incomplete: str = "raise") -> DataFrame:
    """Paired squared-error differences of one method against each benchmark.

    One shuffle puts the methods of a replicate on one row; no join per benchmark. A replicate without exactly one finite row of every method is incomplete: it
    fails the call, or with incomplete="drop" it is left out of all pairs (n_incomplete counts such replicates of the setting).
    """
    if incomplete not in ("raise", "drop"):
        raise ValueError("incomplete is 'raise' or 'drop'")
    keys = list(keys) if keys else settings(r)
    names = [method, *benchmarks]
    pick = [f for m in names for f in (F.max(F.when(F.col("method") == m, F.col("bias"))).alias(f"b_{m}"), F.count_if(F.col("method") == m).alias(f"n_{m}"))]
    wide = r.filter(F.col("method").isin(names)).groupBy(*keys, "sim_id").agg(*pick)
    bad = F.expr(" OR ".join(f"n_{m} <> 1 OR b_{m} IS NULL OR isnan(b_{m})" for m in names) + " OR sim_id IS NULL")
    if incomplete == "raise" and wide.filter(bad).limit(1).collect():
        raise ValueError("each setting needs one finite row per method and replicate")
    wide = wide.withColumn("_bad", bad)
    long = wide.select(*keys, "_bad", F.explode(F.array(*[F.struct(F.lit(b).alias("benchmark_method"), F.when(~F.col("_bad"), (
        F.col(f"b_{method}") * F.col(f"b_{method}") - F.col(f"b_{b}") * F.col(f"b_{b}"))).alias("d")) for b in benchmarks])).alias("s")).select(*keys, "_bad", "s.*")
    g = long.groupBy(*keys, "benchmark_method").agg(
        F.count("d").alias("n_paired_replications"), F.count_if("_bad").alias("n_incomplete"), F.avg("d").alias("mean_squared_error_difference"),
        (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("squared_error_difference_mcse"),
        F.avg((F.col("d") < 0).cast("double")).alias("method_lower_squared_error_fraction"))
    se = F.col("squared_error_difference_mcse")
    return g.withColumns({"method": F.lit(method), "squared_error_difference_z": F.when(se > 0, F.col("mean_squared_error_difference") / se)})


def unpivot_sources(r: DataFrame, ids: Sequence[str], prefix: str = "") -> DataFrame:
    """source_<s>_<metric> columns to one row per source with one column per metric."""
    pat = re.compile(rf"^{re.escape(prefix)}source_([^_]+)_(.+)$")
    found: dict[str, dict[str, str]] = {}
    for c in r.columns:
        m = pat.match(c)
        if m:
            found.setdefault(m[1], {})[m[2]] = c
    sources = sorted(s for s, m in found.items() if "weight" in m)
    if not sources:
        raise ValueError("no source-specific weight columns")
    metrics = sorted({m for s in sources for m in found[s]})
    structs = [F.struct(F.lit(s).alias("source"), *[(F.col(found[s][m]).cast("double") if m in found[s] else F.lit(None).cast("double")).alias(m)
                                                    for m in metrics]) for s in sources]
    return r.select(*ids, F.explode(F.array(*structs)).alias("s")).select(*ids, "s.*")


def cutoff_summary(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adaptive rows paired with target-only bias, summarised per setting and cutoff."""
    b, t = F.col("bias"), F.col("target_only_bias")
    diff, n, cov = b * b - t * t, F.count(F.lit(1)), F.avg(F.col("coverage").cast("double"))
    return paired.groupBy(*keys).agg(
        n.alias("n_replications"), F.avg(b).alias("bias"), (F.stddev_samp(b) / F.sqrt(n)).alias("bias_mcse"), F.stddev_samp("estimate").alias("empirical_sd"),
        F.avg("se").alias("mean_se"), F.when(F.stddev_samp("estimate") > 0, F.avg("se") / F.stddev_samp("estimate")).alias("se_to_empirical_sd"),
        _rmse(b).alias("rmse"), _rmse(t).alias("target_only_rmse"), F.avg(diff).alias("mean_paired_difference"),
        (F.stddev_samp(diff) / F.sqrt(n)).alias("paired_difference_mcse"), cov.alias("coverage"), F.sqrt(cov * (1 - cov) / n).alias("coverage_mcse"))


def select_cutoff(s: DataFrame, tol: float = 1.05, base_rho: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Cutoffs efficient at the base deviation, then smallest worst, mean RMSE elsewhere, then smallest cutoff."""
    by = list(by)
    at0 = F.col("rho") == base_rho
    g = s.groupBy(*by, "cutoff").agg(
        F.max(F.when(at0, F.col("rmse"))).alias("base_rmse"), F.max(F.when(~at0, F.col("rmse"))).alias("worst_rmse"),
        F.avg(F.when(~at0, F.col("rmse"))).alias("mean_rmse"), F.min(F.when(~at0, F.col("coverage"))).alias("min_coverage"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    g = g.withColumn("base_relative_to_best", F.col("base_rmse") / F.min("base_rmse").over(w)).withColumn("eligible", F.col("base_relative_to_best") <= tol)
    order = w.orderBy(F.desc("eligible"), "worst_rmse", "mean_rmse", "cutoff")
    return g.withColumn("selected", F.col("eligible") & (F.row_number().over(order) == 1))


def compare_ab(r: DataFrame, key: str, a, b, ids: Sequence[str], runtime: str = "runtime", by: Sequence[str] = ()) -> DataFrame:
    """Paired comparison of two configurations: estimate differences, se ratio, median runtime ratio, adoption flag."""
    by, ids = list(by), list(ids)
    pick = lambda v, c: F.max(F.when(F.col(key) == v, F.col(c)))
    w = r.filter(F.col(key).isin(a, b)).groupBy(*by, *ids).agg(*[pick(v, c).alias(f"{c}_{n}") for n, v in (("a", a), ("b", b)) for c in ("estimate", "se", runtime)])
    p = w.dropna().select(*by, (F.col("estimate_a") - F.col("estimate_b")).alias("d"), ((F.col("estimate_a") - F.col("estimate_b")) / F.col("se_b")).alias("ds"),
                          (F.col("se_a") / F.col("se_b")).alias("sr"), (F.col(f"{runtime}_a") / F.col(f"{runtime}_b")).alias("rr"))
    if not by:
        p, by = p.withColumn("_all", F.lit(1)), ["_all"]
    g = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean_difference"), F.max(F.abs("d")).alias("max_abs_difference"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_difference"), F.avg(F.abs("ds")).alias("mean_abs_difference_in_se"),
        F.max(F.abs("ds")).alias("max_abs_difference_in_se"), F.avg("sr").alias("mean_se_ratio"), F.avg("rr").alias("mean_runtime_ratio"))
    out = g.join(grouped_quantiles(p, "rr", by, {"median_runtime_ratio": 0.5}), by).drop("_all")
    # fixed values of the adoption rule
    adopt = ((F.col("n_pairs") >= 5) & (F.col("mean_abs_difference_in_se") <= 0.10) & (F.col("max_abs_difference_in_se") <= 0.25)
             & F.col("mean_se_ratio").between(0.98, 1.02) & (F.col("median_runtime_ratio") <= 0.80))
    return out.withColumn("adopt", adopt)


def latest_runs(r: DataFrame, keys: Sequence[str], order: str = "run_id") -> DataFrame:
    """Row of the latest run per key, by a combinable aggregate instead of a sort."""
    rest = [c for c in r.columns if c not in keys]
    return r.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def summarize_by(r: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = finite(c)
        aggs += [F.avg(x).alias(f"mean_{c}"), F.avg(F.abs(x)).alias(f"mean_abs_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    return r.groupBy(*keys).agg(*aggs)


def current_vs_best(s: DataFrame, keys: Sequence[str], label: str = "variant", current: str = "current", value: str = "mean_bias") -> DataFrame:
    """The current variant next to the variant of smallest absolute bias."""
    best = F.min_by(F.struct(label, value), F.struct(F.abs(value), F.col(label)))
    g = s.groupBy(*keys).agg(F.max(F.when(F.col(label) == current, F.col(value))).alias(f"current_{value}"), best.alias("_b"))
    return g.select(*keys, f"current_{value}", F.col(f"_b.{label}").alias(f"best_{label}"), F.col(f"_b.{value}").alias(f"best_{value}"))


def extremes(r: DataFrame, col: str, n: int = 50, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows of largest magnitude: per-partition heaps, no global sort."""
    return r.filter(finite(col).isNotNull()).orderBy(F.desc(F.abs(col)), *ties).limit(n)


def root_cause(r: DataFrame, observed: str = "observed_bias", model: str = "model_bias") -> DataFrame:
    o, m = finite(observed), finite(model)
    usable = F.abs(o) > 1e-10
    ms, ns = F.when(usable, m / o), F.when(usable, (o - m) / o)
    gap = (F.when(F.abs(ms) >= 0.5, "model_residual_underfill").when(F.abs(ns) >= 0.5, "observed_outcome_noise").otherwise("mixed_or_small"))
    return r.withColumns({"model_share": ms, "noise_share": ns, "primary_gap": gap})


def delta(base: DataFrame, cand: DataFrame, keys: Sequence[str], cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Candidate minus base per key, averaged by group."""
    x = base.select(*keys, *[F.col(c).alias(f"base_{c}") for c in cols])
    j = cand.select(*keys, *cols).join(x, list(keys))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(F.col(c) - F.col(f"base_{c}")).alias(f"mean_delta_{c}") for c in cols])


def robust_spread(r: DataFrame, keys: Sequence[str], trim: float = 0.05) -> DataFrame:
    """Sample, trimmed and MAD spread of the estimates, and tail frequencies of bias/se."""
    keys = list(keys)
    r = r.select(*keys, finite("estimate").alias("x"), finite("se").alias("s"), finite("bias").alias("b")).dropna().persist()
    # one row per group, read by both later passes
    q = grouped_quantiles(r, "x", keys, {"lo": trim, "hi": 1 - trim, "med": 0.5}).persist()
    z = F.col("b") / F.col("s")
    j = attach(r, q, keys).withColumns({"z": z, "ad": F.abs(F.col("x") - F.col("med"))})
    mad = grouped_quantiles(j.select(*keys, "ad"), "ad", keys, {"mad": 0.5})
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("empirical_sd"),
        F.stddev_samp(F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.col("x"))).alias("trimmed_sd"), F.avg("s").alias("mean_se"),
        F.stddev_samp("z").alias("z_sd"), F.avg((F.abs("z") > 1.96).cast("double")).alias("z_over_196"),
        F.avg((F.abs("z") > 3).cast("double")).alias("z_over_3"), F.max(F.abs("z")).alias("max_abs_z"))
    return g.join(mad, keys).withColumn("mad_sd", F.col("mad") * 1.4826).drop("mad")


def blowup_rate(r: DataFrame, setting: Sequence[str], unit: Sequence[str], value: str, threshold: float = 0.2) -> DataFrame:
    """Spread of a value within each unit, and the share of units whose spread exceeds the threshold."""
    s = r.groupBy(*setting, *unit).agg((F.max(value) - F.min(value)).alias("spread"))
    return s.groupBy(*setting).agg(F.count(F.lit(1)).alias("units"), F.avg("spread").alias("mean_spread"),
                                   F.avg((F.col("spread") > threshold).cast("double")).alias("blown_fraction"))


def result_row(df: DataFrame, truth: str | None = "truth", z: float = C.Z_975) -> DataFrame:
    """estimate and se with interval, width, and bias and coverage when the truth is supplied."""
    e, s = F.col("estimate"), F.col("se")
    out = df.withColumns({"ci_lower": e - z * s, "ci_upper": e + z * s, "ci_width": 2 * z * s})
    if truth:
        t = F.col(truth)
        out = out.withColumns({"bias": e - t, "coverage": (F.col("ci_lower") <= t) & (t <= F.col("ci_upper"))})
    return out
