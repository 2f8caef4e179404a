"""Queries: joins (J), run metrics (M), robust summaries (R)."""
from pyspark.sql import functions as F

from ..operators import joins as jo, metrics as me, robust as ro
from .base import BASE_SQL, R, RESULTS_SQL, base, fold_sql, obs, query, results, rnd, table

RES, COH = "WITH " + RESULTS_SQL, "WITH " + BASE_SQL
SET = ["config", "p", "rho", "cutoff"]
SETS = ", ".join(SET)


def clean(r):
    """Replicates that every method finished."""
    return r.filter(~F.col("bias").isNull())


def full_sql(src="res"):
    """Replicates with a finite row of every method."""
    return f"full_ AS (SELECT * FROM {src} WHERE sim_id IN (SELECT sim_id FROM {src} GROUP BY sim_id HAVING count(bias) = 5))"


# -- J -------------------------------------------------------------------------------
@query("J1_pair_methods", f"{RES} SELECT config, sim_id, {R('a.bias', 'bias', 9)}, {R('b.bias', 'benchmark_bias', 9)} FROM res a JOIN res b USING (config, sim_id) "
       "WHERE a.method = 'one_round' AND b.method = 'target_only'")
def j1(spark, d):
    return rnd(jo.pair_methods(results(spark, d), "one_round", "target_only", ["config", "sim_id"]), 9)


@query("J2_pair_target", f"{RES} SELECT sim_id, rho, cutoff, {R('a.estimate', 'estimate', 9)}, {R('b.bias', 'target_only_bias', 9)} FROM res a JOIN res b USING (sim_id, rho, cutoff) "
       "WHERE a.method = 'one_round' AND b.method = 'target_only'")
def j2(spark, d):
    r = results(spark, d)
    return rnd(jo.pair_target(r, ["sim_id", "rho", "cutoff"]).select("sim_id", "rho", "cutoff", "estimate", "target_only_bias"), 9)


CELL_SQL = f"{COH}, {fold_sql(3)}, coef AS (SELECT site, a, fold, regr_intercept(y_num, x1) AS b0, regr_slope(y_num, x1) AS b1 FROM f GROUP BY ALL)"


def cell_coef(o):
    g = o.groupBy("site", "a", "fold").agg(F.regr_intercept("y", F.col("w")[0]).alias("b0"), F.regr_slope("y", F.col("w")[0]).alias("b1"))
    return g.select("site", "a", "fold", F.array("b0", "b1").alias("beta"))


@query("J3_join_coef", f"{CELL_SQL} SELECT obs_id, {R('b0 + b1 * x1', 'eta')} FROM f JOIN coef USING (site, a, fold)")
def j3(spark, d):
    from ..functions import linear_predictor
    o = obs(spark, d, folds=3)
    return rnd(jo.join_coef(o, cell_coef(o), ["site", "a", "fold"], 1).select("obs_id", linear_predictor("w", "beta", 1).alias("eta")))


@query("J4_pair_arms", f"{COH} SELECT obs_id, site, {R('y_num + x1', 'phi1', 9)}, {R('y_num - x2', 'phi0', 9)}, {R('x1 + x2', 'phi_tau', 9)} FROM base")
def j4(spark, d):
    b = base(spark, d)
    s = b.select("obs_id", "site", F.explode(F.array(F.struct(F.lit(1).alias("arm"), (F.col("y_num") + F.col("x1")).alias("phi")),
                                                     F.struct(F.lit(0).alias("arm"), (F.col("y_num") - F.col("x2")).alias("phi")))).alias("s")).select("obs_id", "site", "s.*")
    return rnd(jo.pair_arms(s), 9)


SRC_SQL = f"{COH}, coef AS (SELECT site, regr_intercept(y_num, x1) AS b0, regr_slope(y_num, x1) AS b1 FROM base WHERE site <> 't' GROUP BY site)"


def source_coef(o):
    g = o.filter("site <> 't'").groupBy("site").agg(F.regr_intercept("y", F.col("w")[0]).alias("b0"), F.regr_slope("y", F.col("w")[0]).alias("b1"))
    return g.select("site", F.array("b0", "b1").alias("beta"))


@query("J5_predict_all_sources", f"{SRC_SQL} SELECT obs_id, " + ", ".join(R(f"max(b0 + b1 * x1) FILTER (WHERE c.site = 's{i}')", f"psi{i}") for i in range(1, 5))
       + " FROM base b, coef c WHERE b.site = 't' GROUP BY obs_id")
def j5(spark, d):
    o = obs(spark, d)
    p = jo.predict_all_sources(o.filter("site = 't'"), source_coef(o), 1)
    return rnd(p.select("obs_id", *[F.col("psi")[i].alias(f"psi{i + 1}") for i in range(4)]))


@query("J6_cross_candidates", f"{COH}, m AS (SELECT site, a, avg(y_num) AS m FROM base GROUP BY ALL) SELECT x.site AS treated, z.site AS control, {R('x.m', 'mean1')}, {R('z.m', 'mean0')}, "
       f"{R('x.m - z.m', 'estimate')} FROM m x, m z WHERE x.a = 1 AND z.a = 0")
def j6(spark, d):
    m = base(spark, d).groupBy(F.col("site").alias("candidate"), "a").agg(F.avg("y_num").alias("mean"))
    return rnd(jo.cross_candidates(m.filter("a = 1"), m.filter("a = 0")))


@query("J7_check_grid", """WITH g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
 SELECT coalesce(g.k, m.k) AS k, CASE WHEN m.k IS NULL THEN 0 ELSE 1 END::BIGINT AS in_manifest, coalesce(n, 0)::BIGINT AS in_results,
 CASE WHEN g.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS status FROM g FULL JOIN m ON g.k = m.k WHERE g.k IS NULL OR m.k IS NULL OR n > 1""")
def j7(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return jo.check_grid(l, o, ["k"])


@query("J8_diff_tables", f"""{COH}, b2 AS (SELECT obs_id, a, CASE WHEN nation = 3 THEN y_num + x2 ELSE y_num END AS y, CASE WHEN nation = 4 THEN 'X' ELSE seg END AS seg FROM base WHERE nation <> 9),
 j AS (SELECT b.a AS aa, b.y_num AS ya, b.seg AS sa, b2.a AS ab, b2.y AS yb, b2.seg AS sb, b2.obs_id AS ib FROM (SELECT * FROM base WHERE nation <> 10) b FULL JOIN b2 USING (obs_id)),
 t AS (SELECT count(*) FILTER (WHERE aa IS NOT NULL AND ib IS NOT NULL) AS n, count(*) FILTER (WHERE ib IS NULL) AS oa, count(*) FILTER (WHERE aa IS NULL) AS ob,
  count(*) FILTER (WHERE aa <> ab) AS da, count(*) FILTER (WHERE ya <> yb) AS dy, count(*) FILTER (WHERE sa <> sb) AS ds, max(abs(aa - ab))::DOUBLE AS ga, max(abs(ya - yb)) AS gy FROM j)
 SELECT c AS "column", n AS n_compared, CASE c WHEN 'a' THEN da WHEN 'y' THEN dy ELSE ds END AS n_different, {R("CASE c WHEN 'a' THEN ga WHEN 'y' THEN gy END", 'max_abs_difference')},
 oa AS only_a, ob AS only_b FROM t, (VALUES ('a'), ('y'), ('seg')) v(c)""")
def j8(spark, d):
    b = base(spark, d)
    x = b.filter("nation <> 10").select("obs_id", "a", F.col("y_num").alias("y"), "seg")
    y = b.filter("nation <> 9").select("obs_id", "a", F.when(F.col("nation") == 3, F.col("y_num") + F.col("x2")).otherwise(F.col("y_num")).alias("y"),
                                       F.when(F.col("nation") == 4, "X").otherwise(F.col("seg")).alias("seg"))
    return rnd(jo.diff_tables(x, y, ["obs_id"]))


# -- M -------------------------------------------------------------------------------
SUM_SQL = f"""s AS (SELECT method, {SETS}, avg(bias) AS bias_mean, stddev_samp(bias) AS bias_sd, sqrt(avg(bias * bias)) AS rmse, avg(se) AS se_mean,
 avg(CASE WHEN coverage THEN 1e0 WHEN NOT coverage THEN 0e0 END) AS coverage, avg(ci_width) AS ci_width_mean, stddev_samp(ci_width) AS ci_width_sd, count(estimate) AS n_success FROM res GROUP BY ALL)"""
SUMCOLS = ["bias_mean", "bias_sd", "rmse", "se_mean", "coverage", "ci_width_mean", "ci_width_sd"]


@query("M1_summarize_results", f"{RES}, {SUM_SQL} SELECT method, {SETS}, n_success, " + ", ".join(R(c, c) for c in SUMCOLS) + " FROM s")
def m1(spark, d):
    return rnd(me.summarize_results(results(spark, d)))


@query("M2_mc_errors", f"{RES}, {SUM_SQL} SELECT method, {SETS}, n_success, " + ", ".join(R(c, c) for c in SUMCOLS)
       + f", {R('bias_sd / sqrt(n_success)', 'bias_mcse')}, {R('sqrt(coverage * (1 - coverage) / n_success)', 'coverage_mcse')}, {R('se_mean / bias_sd', 'se_to_empirical_sd')} FROM s")
def m2(spark, d):
    return rnd(me.mc_errors(me.summarize_results(results(spark, d)), reference=False))


@query("M2_normal_reference_coverage")
def m2b(spark, d):
    return rnd(me.mc_errors(me.summarize_results(results(spark, d))).select("method", *SET, "normal_reference_coverage"))


def run_columns(r):
    """Fit and bootstrap diagnostics of each replicate, derived from its id."""
    i = F.col("sim_id")
    n = lambda m, v: F.when(i % m == 0, F.lit(float(v))).otherwise(0.0)
    return r.withColumns({
        "fit_initial_dr_nonconverged": n(401, 1), "fit_calibrated_dr_nonconverged": n(509, 2), "fit_calibrated_outcome_nonconverged": n(613, 1),
        "fit_initial_dr_line_search_failures": n(701, 1), "fit_calibrated_dr_cv_invalid_fold_fits": n(307, 3), "fit_max_initial_dr_iterations": (i % 50).cast("double"),
        "fit_max_initial_dr_abs_coefficient": (i % 97).cast("double"), "fit_max_calibrated_outcome_abs_coefficient": (i % 89).cast("double"),
        "max_abs_source_weight": (i % 1009) / 100.0, "n_weight_bootstrap": F.lit(500.0), "se_relearn": F.col("se") * 1.5, "se_fixed": F.col("se"),
        "variance_relearn": F.col("se") * 1.5 * (F.col("se") * 1.5), "uncertainty_ratio": F.when(F.col("se").isNotNull(), 1.5), "bootstrap_failures": n(811, 1)})


RUN_SQL = """run AS (SELECT *, CASE WHEN sim_id % 401 = 0 THEN 1e0 ELSE 0e0 END AS n1, CASE WHEN sim_id % 509 = 0 THEN 2e0 ELSE 0e0 END AS n2, CASE WHEN sim_id % 613 = 0 THEN 1e0 ELSE 0e0 END AS n3,
 CASE WHEN sim_id % 701 = 0 THEN 1e0 ELSE 0e0 END AS ls, CASE WHEN sim_id % 307 = 0 THEN 3e0 ELSE 0e0 END AS cvx, CAST(sim_id % 50 AS DOUBLE) AS it, CAST(sim_id % 97 AS DOUBLE) AS c1,
 CAST(sim_id % 89 AS DOUBLE) AS c3, (sim_id % 1009) / 100e0 AS mw, CASE WHEN sim_id % 811 = 0 THEN 1e0 ELSE 0e0 END AS bf FROM res)"""

# fixed value: two-sided 95 % normal quantile
ZQ = "1.959963984540054e0"
DIAG_SQL = f"""{RUN_SQL}, ok AS (SELECT *, (estimate IS NOT NULL AND sim_id >= 1) AS ok_ FROM run),
 d0 AS (SELECT method, config, CAST(p AS VARCHAR) AS p, CAST(rho AS VARCHAR) AS rho, CAST(cutoff AS VARCHAR) AS cutoff, count(*) AS n_rows, count(DISTINCT sim_id) AS n_unique_replications,
  count(*) FILTER (WHERE ok_) AS n_complete_replications, count(sim_id) - count(DISTINCT sim_id) AS n_duplicate_replications, count(*) FILTER (WHERE NOT sim_id >= 1) AS n_invalid_replication_ids,
  avg(bias) FILTER (WHERE ok_) AS bias, stddev_samp(bias) FILTER (WHERE ok_) AS empirical_sd, kurtosis_pop(bias) FILTER (WHERE ok_) AS bias_excess_kurtosis, avg(se) FILTER (WHERE ok_) AS mean_se,
  sqrt(avg(bias * bias) FILTER (WHERE ok_)) AS rmse, avg(CASE WHEN coverage THEN 1e0 ELSE 0e0 END) FILTER (WHERE ok_) AS coverage,
  avg(bias * bias * bias) FILTER (WHERE ok_) AS b3, avg(bias * bias) FILTER (WHERE ok_) AS b2,
  avg(CASE WHEN truth < ci_lower THEN 1e0 ELSE 0e0 END) FILTER (WHERE ok_) AS truth_below_interval_fraction, avg(CASE WHEN truth > ci_upper THEN 1e0 ELSE 0e0 END) FILTER (WHERE ok_) AS truth_above_interval_fraction,
  count(*) FILTER (WHERE ci_lower IS NULL) AS unord, sum(n1 + n2 + n3) AS nonconv, sum(ls) AS ls, sum(cvx) AS cvx, max(mw) AS mw, max(c1) AS c1, max(c3) AS c3,
  count(se) AS bvalid, sum(CASE WHEN se IS NOT NULL THEN bf ELSE 0 END) AS bfail FROM ok GROUP BY ALL),
 d AS (SELECT *, empirical_sd / sqrt(n_complete_replications) AS bias_mcse, sqrt(coverage * (1 - coverage) / n_complete_replications) AS coverage_mcse,
  greatest(0, 0.95e0 - {ZQ} * sqrt(0.95e0 * 0.05e0 / n_complete_replications)) AS coverage_mc_lower, least(1, 0.95e0 + {ZQ} * sqrt(0.95e0 * 0.05e0 / n_complete_replications)) AS coverage_mc_upper,
  mean_se / empirical_sd AS se_to_empirical_sd, (b3 - 3 * bias * b2 + 2 * bias * bias * bias) / pow(b2 - bias * bias, 1.5e0) AS bias_skewness FROM d0),
 q AS (SELECT *, concat_ws(';', CASE WHEN n_unique_replications < 200 THEN 'incomplete_replications' END, CASE WHEN n_unique_replications > 200 THEN 'excess_replications' END,
  CASE WHEN n_invalid_replication_ids > 0 THEN 'invalid_replication_id' END, CASE WHEN n_complete_replications < n_rows THEN 'nonfinite_values' END,
  CASE WHEN unord > 0 THEN 'invalid_confidence_interval' END, CASE WHEN nonconv > 0 THEN 'nuisance_nonconvergence_detected' END, CASE WHEN ls > 0 THEN 'nuisance_line_search_failures_detected' END,
  CASE WHEN cvx > 0 THEN 'nuisance_cv_candidates_excluded' END, CASE WHEN bvalid < n_rows THEN 'invalid_weight_relearn_bootstrap_diagnostics' END,
  CASE WHEN bfail > 0 THEN 'weight_relearn_bootstrap_failures_detected' END, CASE WHEN mw > 10 THEN 'extreme_aggregation_weight' END,
  CASE WHEN coverage < coverage_mc_lower THEN 'coverage_below_mc_band' END, CASE WHEN coverage > coverage_mc_upper THEN 'coverage_above_mc_band' END,
  CASE WHEN se_to_empirical_sd < 0.85e0 THEN 'se_empirical_ratio_low' END, CASE WHEN se_to_empirical_sd > 1.15e0 THEN 'se_empirical_ratio_high' END,
  CASE WHEN abs(bias) > 2 * bias_mcse THEN 'bias_exceeds_2_mcse' END) AS st0 FROM d),
 q2 AS (SELECT *, CASE WHEN st0 = '' THEN 'ok' ELSE st0 END AS diagnostic_status,
  CASE WHEN coverage IS NULL THEN 'not_evaluable' WHEN coverage < coverage_mc_lower THEN CASE WHEN abs(bias) > 2 * bias_mcse AND se_to_empirical_sd < 0.85e0 THEN 'bias_and_se_underestimation'
   WHEN abs(bias) > 2 * bias_mcse AND se_to_empirical_sd > 1.15e0 THEN 'centering_bias_despite_conservative_se' WHEN abs(bias) > 2 * bias_mcse THEN 'primarily_centering_bias'
   WHEN se_to_empirical_sd < 0.85e0 THEN 'primarily_se_underestimation' ELSE 'unresolved_finite_sample_shape' END
  WHEN coverage > coverage_mc_upper THEN CASE WHEN se_to_empirical_sd > 1.15e0 THEN 'primarily_se_overestimation' ELSE 'unresolved_finite_sample_shape' END ELSE 'within_nominal_mc_band' END AS coverage_diagnosis FROM q)"""
MOMS = ["bias", "empirical_sd", "bias_skewness", "bias_excess_kurtosis", "mean_se", "rmse", "coverage", "truth_below_interval_fraction", "truth_above_interval_fraction",
        "bias_mcse", "coverage_mcse", "coverage_mc_lower", "coverage_mc_upper", "se_to_empirical_sd"]
COUNTS = ["n_rows", "n_unique_replications", "n_complete_replications", "n_duplicate_replications", "n_invalid_replication_ids"]


def diagnostics(spark, d):
    return me.diagnose_results(run_columns(results(spark, d)), z=1.96, reference=False)


@query("M3_diagnose_results", f"{RES}, {DIAG_SQL} SELECT method, {SETS}, {', '.join(COUNTS)}, " + ", ".join(R(c, c, 5) for c in MOMS) + " FROM q2")
def m3(spark, d):
    return rnd(diagnostics(spark, d).select("method", *SET, *COUNTS, *MOMS), 5)


@query("M4_flag_status", f"{RES}, {DIAG_SQL} SELECT method, {SETS}, diagnostic_status, coverage_diagnosis FROM q2")
def m4(spark, d):
    return diagnostics(spark, d).select("method", *SET, "diagnostic_status", "coverage_diagnosis")


QC_SQL = f"""{DIAG_SQL}, z AS (SELECT *, c1 >= 0.9e0 * 100 AS rb, c3 >= 0.9e0 * 97 AS ob_ FROM q2),
 z1 AS (SELECT *, CASE WHEN c1 >= 87.3e0 THEN CASE WHEN diagnostic_status = 'ok' THEN 'nuisance_density_ratio_boundary_detected' ELSE diagnostic_status || ';nuisance_density_ratio_boundary_detected' END ELSE diagnostic_status END AS t1 FROM z),
 z2 AS (SELECT *, CASE WHEN c3 >= 87.3e0 THEN CASE WHEN t1 = 'ok' THEN 'nuisance_outcome_boundary_detected' ELSE t1 || ';nuisance_outcome_boundary_detected' END ELSE t1 END AS t2 FROM z1)"""


@query("M5_classify_qc", f"""{RES}, {QC_SQL} SELECT method, {SETS}, t2 AS diagnostic_status,
 regexp_matches(t2, 'incomplete_rep|excess_rep|invalid_|nonfinite|nonconvergence|boundary|bootstrap_failures') AS implementation_failed,
 regexp_matches(t2, 'mc_band|se_empirical|exceeds_2|extreme_|candidates_excluded|line_search') AS statistical_review_required FROM z2""")
def m5(spark, d):
    q = me.classify_qc(me.augment_qc(diagnostics(spark, d), 97.0))
    return q.select("method", *SET, "diagnostic_status", "implementation_failed", "statistical_review_required")


@query("M6_group_key", "SELECT CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN '<unspecified>' ELSE event_type END AS k, count(*) AS n FROM events GROUP BY 1")
def m6(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    k = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.col("event_type"), F.lit(" ")))
    return me.group_key(e.select(k.alias("k")), ["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("M7_nuisance_rollup", f"""{RES}, {RUN_SQL} SELECT method, config, sum(n1) AS initial_dr_nonconverged_total, sum(n2) AS calibrated_dr_nonconverged_total, sum(ls) AS initial_dr_line_search_failures_total,
 max(it) AS max_initial_dr_iterations, count(*) AS diagnostic_replications, count(*) FILTER (WHERE n1 + n2 + n3 > 0) AS nonconverged_replications, sum(n1 + n2 + n3) AS nonconverged_fits_total, FALSE AS invalid_nuisance
 FROM run GROUP BY ALL""")
def m7(spark, d):
    g = me.nuisance_rollup(run_columns(results(spark, d)), ["method", "config"])
    return g.select("method", "config", "initial_dr_nonconverged_total", "calibrated_dr_nonconverged_total", "initial_dr_line_search_failures_total", "max_initial_dr_iterations",
                    "diagnostic_replications", "nonconverged_replications", "nonconverged_fits_total", "invalid_nuisance")


@query("M8_bootstrap_rollup", f"""{RES}, {RUN_SQL} SELECT method, config, count(se) AS bootstrap_replications, {R('avg(se * 1.5e0)', 'mean_se_relearn')}, {R('avg(se)', 'mean_se_fixed')},
 {R('1.5e0', 'mean_uncertainty_ratio')}, sum(CASE WHEN se IS NOT NULL THEN bf ELSE 0e0 END) AS bootstrap_failures_total, 0e0 AS variance_identity_error, 0e0 AS ratio_identity_error,
 count(se) < count(*) AS invalid_bootstrap FROM run GROUP BY ALL""")
def m8(spark, d):
    return rnd(me.bootstrap_rollup(run_columns(results(spark, d)), ["method", "config"]))


@query("M9_rank_rmse", f"""{RES}, {SUM_SQL}, s2 AS (SELECT method, {SETS}, round(rmse, 3) + 0.0 AS rmse FROM s) SELECT *, rank() OVER (PARTITION BY {SETS} ORDER BY rmse) AS rmse_rank,
 {R(f"rmse / max(CASE WHEN method = 'target_only' THEN rmse END) OVER (PARTITION BY {SETS})", 'rmse_relative_to_target')} FROM s2""")
def m9(spark, d):
    s = me.summarize_results(results(spark, d)).select("method", *SET, F.round("rmse", 3).alias("rmse"))
    return rnd(me.rank_rmse(s).withColumn("rmse_rank", F.col("rmse_rank").cast("long")))


@query("M10_paired_mse", f"""{RES}, {full_sql()}, p AS (SELECT {', '.join('a.' + c for c in SET)}, b.method AS benchmark_method, CASE WHEN sim_id IN (SELECT sim_id FROM full_) THEN a.bias * a.bias - b.bias * b.bias END AS d FROM res a JOIN res b USING (sim_id)
 WHERE a.method = 'one_round' AND b.method <> 'one_round')
 SELECT {SETS}, 'one_round' AS method, benchmark_method, count(d) AS n_paired_replications, count(*) - count(d) AS n_incomplete, {R('avg(d)', 'mean_squared_error_difference')}, {R('stddev_samp(d) / sqrt(count(d))', 'squared_error_difference_mcse')},
 {R('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 'squared_error_difference_z', 5)}, {R('avg(CASE WHEN d < 0 THEN 1e0 WHEN d >= 0 THEN 0e0 END)', 'method_lower_squared_error_fraction')} FROM p GROUP BY ALL""")
def m10(spark, d):
    g = me.paired_mse(results(spark, d), "one_round", ["target_only", "sample_size", "inverse_variance", "federated_dr"], incomplete="drop")
    return rnd(g.withColumn("squared_error_difference_z", F.round("squared_error_difference_z", 5)))


@query("M11_unpivot_sources", f"""{RES} SELECT sim_id, config, s AS source, {R("bias / CASE s WHEN 's1' THEN 2 ELSE 4 END", 'weight', 11)}, CASE WHEN s = 's1' THEN {R('se', 'x').split(' AS ')[0]} END AS wald_mean
 FROM res, (VALUES ('s1'), ('s2')) v(s) WHERE method = 'one_round'""")
def m11(spark, d):
    r = results(spark, d).filter("method = 'one_round'")
    w = r.select("sim_id", "config", (F.col("bias") / 2).alias("source_s1_weight"), (F.col("bias") / 4).alias("source_s2_weight"), F.col("se").alias("source_s1_wald_mean"))
    return rnd(me.unpivot_sources(w, ["sim_id", "config"]).withColumn("wald_mean", F.round("wald_mean", 6)), 11)


@query("M12_cutoff_summary", f"""{RES}, p AS (SELECT a.config, a.rho, a.cutoff, a.estimate, a.se, a.bias AS b, t.bias AS t, CASE WHEN a.coverage THEN 1e0 ELSE 0e0 END AS c FROM res a JOIN res t USING (sim_id)
 WHERE a.method = 'one_round' AND t.method = 'target_only' AND a.bias IS NOT NULL AND t.bias IS NOT NULL)
 SELECT config, rho, cutoff, count(*) AS n_replications, {R('avg(b)', 'bias')}, {R('stddev_samp(b) / sqrt(count(*))', 'bias_mcse')}, {R('stddev_samp(estimate)', 'empirical_sd')}, {R('avg(se)', 'mean_se')},
 {R('avg(se) / stddev_samp(estimate)', 'se_to_empirical_sd')}, {R('sqrt(avg(b * b))', 'rmse')}, {R('sqrt(avg(t * t))', 'target_only_rmse')}, {R('avg(b * b - t * t)', 'mean_paired_difference')},
 {R('stddev_samp(b * b - t * t) / sqrt(count(*))', 'paired_difference_mcse')}, {R('avg(c)', 'coverage')}, {R('sqrt(avg(c) * (1 - avg(c)) / count(*))', 'coverage_mcse')} FROM p GROUP BY ALL""")
def m12(spark, d):
    p = jo.pair_target(clean(results(spark, d)), ["sim_id"])
    return rnd(me.cutoff_summary(p, ["config", "rho", "cutoff"]))


@query("M13_select_cutoff", f"""{RES}, s AS (SELECT config, rho, cutoff, sqrt(avg(bias * bias)) AS rmse, avg(CASE WHEN coverage THEN 1e0 WHEN NOT coverage THEN 0e0 END) AS cov FROM res WHERE method = 'one_round' GROUP BY ALL),
 g AS (SELECT config, cutoff, max(rmse) FILTER (WHERE rho = 0) AS b, max(rmse) FILTER (WHERE rho <> 0) AS w, avg(rmse) FILTER (WHERE rho <> 0) AS m, min(cov) FILTER (WHERE rho <> 0) AS c FROM s GROUP BY ALL),
 e AS (SELECT *, b / min(b) OVER (PARTITION BY config) AS r FROM g)
 SELECT config, cutoff, {R('b', 'base_rmse')}, {R('w', 'worst_rmse')}, {R('m', 'mean_rmse')}, {R('c', 'min_coverage')}, {R('r', 'base_relative_to_best')}, r <= 1.05e0 AS eligible,
 r <= 1.05e0 AND row_number() OVER (PARTITION BY config ORDER BY (r <= 1.05e0) DESC, w, m, cutoff) = 1 AS selected FROM e""")
def m13(spark, d):
    s = me.summarize_results(results(spark, d).filter("method = 'one_round'"), ["config", "rho", "cutoff"])
    return rnd(me.select_cutoff(s, by=["config"]))


@query("M14_compare_ab", f"""{RES}, p AS (SELECT a.config, a.estimate - b.estimate AS d, (a.estimate - b.estimate) / b.se AS ds, a.se / b.se AS sr, (1e0 + a.sim_id % 7) / (1e0 + a.sim_id % 11) AS rr FROM res a JOIN res b USING (sim_id)
 WHERE a.method = 'one_round' AND b.method = 'federated_dr' AND a.estimate IS NOT NULL AND b.estimate IS NOT NULL),
 g AS (SELECT config, count(*) AS n, avg(d) AS md, max(abs(d)) AS xd, sqrt(avg(d * d)) AS rd, avg(abs(ds)) AS mds, max(abs(ds)) AS xds, avg(sr) AS sr, avg(rr) AS rr, median(rr) AS mrr FROM p GROUP BY 1)
 SELECT config, n AS n_pairs, {R('md', 'mean_difference')}, {R('xd', 'max_abs_difference')}, {R('rd', 'rms_difference')}, {R('mds', 'mean_abs_difference_in_se')}, {R('xds', 'max_abs_difference_in_se')}, {R('sr', 'mean_se_ratio')},
 {R('rr', 'mean_runtime_ratio')}, {R('mrr', 'median_runtime_ratio')}, n >= 5 AND mds <= 0.1e0 AND xds <= 0.25e0 AND sr BETWEEN 0.98e0 AND 1.02e0 AND mrr <= 0.8e0 AS adopt FROM g""")
def m14(spark, d):
    i = F.col("sim_id")
    r = results(spark, d).withColumn("runtime", F.when(F.col("method") == "one_round", 1.0 + i % 7).otherwise(1.0 + i % 11))
    return rnd(me.compare_ab(r, "method", "one_round", "federated_dr", ["sim_id"], by=["config"]))


@query("M15_latest_runs", f"""{RES}, k AS (SELECT user_id AS seed, p, method, sim_id AS run_id, estimate, row_number() OVER (PARTITION BY user_id, p, method ORDER BY sim_id DESC) AS r FROM res)
 SELECT seed, p, method, run_id, {R('estimate', 'estimate', 11)} FROM k WHERE r = 1""")
def m15(spark, d):
    r = results(spark, d).select(F.col("user_id").alias("seed"), "p", "method", F.col("sim_id").alias("run_id"), "estimate")
    return rnd(me.latest_runs(r, ["seed", "p", "method"]), 11)


@query("M16_summarize_by", f"""{RES} SELECT config, method, count(*) AS n, {R('avg(bias)', 'mean_bias')}, {R('avg(abs(bias))', 'mean_abs_bias')}, {R('min(bias)', 'min_bias', 11)}, {R('max(bias)', 'max_bias', 11)},
 {R('avg(se)', 'mean_se')}, {R('avg(abs(se))', 'mean_abs_se')}, {R('min(se)', 'min_se', 11)}, {R('max(se)', 'max_se', 11)} FROM res GROUP BY ALL""")
def m16(spark, d):
    g = me.summarize_by(results(spark, d), ["config", "method"], ["bias", "se"])
    ext = ("min_bias", "max_bias", "min_se", "max_se")
    return rnd(g.withColumns({c: F.round(c, 11) for c in ext}), skip=ext)


@query("M17_current_vs_best", f"""{RES}, s AS (SELECT config, rho, method AS variant, avg(bias) AS mean_bias FROM res GROUP BY ALL)
 SELECT config, rho, {R("max(CASE WHEN variant = 'target_only' THEN mean_bias END)", 'current_mean_bias')}, arg_min(variant, abs(mean_bias)) AS best_variant, {R('arg_min(mean_bias, abs(mean_bias))', 'best_mean_bias')} FROM s GROUP BY ALL""")
def m17(spark, d):
    s = results(spark, d).groupBy("config", "rho", F.col("method").alias("variant")).agg(F.avg("bias").alias("mean_bias"))
    return rnd(me.current_vs_best(s, ["config", "rho"], current="target_only"))


@query("M18_extremes", f"{RES} SELECT sim_id, method, {R('bias', 'bias', 11)} FROM res WHERE bias IS NOT NULL ORDER BY abs(bias) DESC, sim_id, method LIMIT 50")
def m18(spark, d):
    return rnd(me.extremes(results(spark, d), "bias", 50, ["sim_id", "method"]).select("sim_id", "method", "bias"), 11)


@query("M19_root_cause", f"""{RES}, t AS (SELECT config, p, rho, method, avg(bias) AS o, avg(bias * (1 + mi) / 4e0 - 0.01e0 * kk / 50e0) AS m FROM res GROUP BY ALL)
 SELECT config, p, rho, method, {R('m / o', 'model_share', 4)}, {R('(o - m) / o', 'noise_share', 4)}, CASE WHEN abs(m / o) >= 0.5e0 THEN 'model_residual_underfill' WHEN abs((o - m) / o) >= 0.5e0 THEN 'observed_outcome_noise' ELSE 'mixed_or_small' END AS primary_gap FROM t""")
def m19(spark, d):
    g = results(spark, d).groupBy("config", "p", "rho", "method").agg(
        F.avg("bias").alias("observed_bias"), F.avg(F.col("bias") * (1 + F.col("mi")) / 4.0 - F.col("kk") * 0.01 / 50.0).alias("model_bias"))
    return rnd(me.root_cause(g).select("config", "p", "rho", "method", "model_share", "noise_share", "primary_gap"), 4)


@query("M20_delta", f"""{RES} SELECT b.config, b.p, count(*) AS n_pairs, {R('avg(c.bias - b.bias)', 'mean_delta_bias')}, {R('avg(c.se - b.se)', 'mean_delta_se')} FROM res b JOIN res c USING (sim_id)
 WHERE b.method = 'target_only' AND c.method = 'one_round' GROUP BY ALL""")
def m20(spark, d):
    r = results(spark, d)
    keys = ["config", "p", "sim_id"]
    return rnd(me.delta(r.filter("method = 'target_only'"), r.filter("method = 'one_round'"), keys, ["bias", "se"], ["config", "p"]))


@query("M21_robust_spread", f"""{RES}, v AS (SELECT config, method, estimate AS x, se AS s, bias / se AS z FROM res WHERE estimate IS NOT NULL),
 q AS (SELECT config, method, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi, median(x) AS med FROM v GROUP BY ALL)
 SELECT config, method, count(*) AS n, {R('stddev_samp(x)', 'empirical_sd')}, {R('stddev_samp(x) FILTER (WHERE x BETWEEN lo AND hi)', 'trimmed_sd')}, {R('avg(s)', 'mean_se')}, {R('stddev_samp(z)', 'z_sd')},
 {R('avg(CASE WHEN abs(z) > 1.96e0 THEN 1e0 ELSE 0e0 END)', 'z_over_196')}, {R('avg(CASE WHEN abs(z) > 3 THEN 1e0 ELSE 0e0 END)', 'z_over_3')}, {R('max(abs(z))', 'max_abs_z')}, {R('median(abs(x - med)) * 1.4826e0', 'mad_sd')}
 FROM v JOIN q USING (config, method) GROUP BY ALL""")
def m21(spark, d):
    return rnd(me.robust_spread(results(spark, d), ["config", "method"]))


@query("M22_blowup_rate", f"""{RES}, u AS (SELECT config, p, user_id, method, max(bias) - min(bias) AS s FROM res GROUP BY ALL)
 SELECT config, p, count(*) AS units, {R('avg(s)', 'mean_spread')}, {R('avg(CASE WHEN s > 0.2e0 THEN 1e0 WHEN s <= 0.2e0 THEN 0e0 END)', 'blown_fraction')} FROM u GROUP BY ALL""")
def m22(spark, d):
    return rnd(me.blowup_rate(results(spark, d), ["config", "p"], ["user_id", "method"], "bias"))


@query("M23_result_row", f"""{RES}, {SUM_SQL}, t AS (SELECT method, {SETS}, bias_mean + 0.5e0 AS estimate, bias_sd AS se, 0.5e0 AS truth FROM s)
 SELECT method, {SETS}, {R('estimate', 'estimate')}, {R('se', 'se')}, truth, {R(f'estimate - {ZQ} * se', 'ci_lower')}, {R(f'estimate + {ZQ} * se', 'ci_upper')}, {R(f'2 * {ZQ} * se', 'ci_width')}, {R('estimate - truth', 'bias')},
 estimate - {ZQ} * se <= truth AND truth <= estimate + {ZQ} * se AS coverage FROM t""")
def m23(spark, d):
    s = me.summarize_results(results(spark, d)).select("method", *SET, (F.col("bias_mean") + 0.5).alias("estimate"), F.col("bias_sd").alias("se"), F.lit(0.5).alias("truth"))
    return rnd(me.result_row(s))


# -- R -------------------------------------------------------------------------------
@query("R1_pool_fold_moments", f"""{COH}, {fold_sql(4)}, m AS (SELECT site, fold, count(*) AS n, avg(y_num) AS mean, var_pop(y_num) AS v FROM f GROUP BY ALL),
 t AS (SELECT site, sum(n * mean) / sum(n) AS mu FROM m GROUP BY site)
 SELECT site, CAST(sum(n) AS BIGINT) AS size, {R('max(mu)', 'mean')}, {R('sum(n * (v + (mean - mu) * (mean - mu))) / pow(sum(n), 2)', 'variance', 9)} FROM m JOIN t USING (site) GROUP BY site""")
def r1(spark, d):
    m = obs(spark, d, folds=4).groupBy("site", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("variance"))
    return rnd(ro.pool_fold_moments(m).withColumn("variance", F.round("variance", 9)), skip=("variance",))


def agreement_sql(k: int = 4) -> str:
    p = [f"p{i}" for i in range(1, k + 1)]
    cov = {(i, j): f"c{i}_{j}" for i in range(k) for j in range(i, k)}
    cell = [cov[min(i, j), max(i, j)] for i in range(k) for j in range(k)]
    root = lambda xs: f"sqrt({' + '.join(f'({x}) * ({x})' for x in xs)})"
    return (f"{SRC_SQL}, p AS (SELECT obs_id, " + ", ".join(f"max(b0 + b1 * x1) FILTER (WHERE c.site = 's{i + 1}') AS {v}" for i, v in enumerate(p))
            + f" FROM base b, coef c WHERE b.site = 't' GROUP BY obs_id), q AS (SELECT *, ({' + '.join(p)}) / {k} AS m FROM p), "
            + "s AS (SELECT count(*) AS n, var_pop(m) / count(*) AS cv, " + ", ".join(f"covar_pop({p[i]}, {p[j]}) / count(*) AS {c}" for (i, j), c in cov.items())
            + f", sqrt(avg(({' + '.join(f'({v} - m) * ({v} - m)' for v in p)}) / {k})) AS dis FROM q) SELECT n, {R('cv', 'common_variance', 9)}, "
            + R(f"{root([f'{c} - cv' for c in cell])} / {root(cell)}", "relative_covariance_error", 9) + ", "
            + R("least(" + ", ".join(f"{c} / sqrt(c{i}_{i} * c{j}_{j})" for (i, j), c in cov.items() if i < j) + ")", "minimum_correlation", 9) + f", {R('dis', 'prediction_disagreement_rmse', 9)} FROM s")


@query("R2_candidate_agreement", agreement_sql())
def r2(spark, d):
    o = obs(spark, d)
    return rnd(ro.candidate_agreement(jo.predict_all_sources(o.filter("site = 't'"), source_coef(o), 1), 4), 9)


@query("R3_arm_pairs", f"""{COH}, m AS (SELECT site, a, avg(y_num) AS m, var_samp(y_num) / count(*) AS v FROM base GROUP BY ALL)
 SELECT x.site AS treated, z.site AS control, {R('x.m - z.m', 'estimate')}, {R('x.v + z.v', 'variance', 9)}, {R('sqrt(x.v + z.v)', 'se')} FROM m x, m z WHERE x.a = 1 AND z.a = 0""")
def r3(spark, d):
    m = base(spark, d).groupBy("site", "a").agg(F.avg("y_num").alias("m"), (F.var_samp("y_num") / F.count(F.lit(1))).alias("v"))
    means = m.groupBy(F.col("site").alias("candidate")).agg(F.max(F.when(F.col("a") == 1, F.col("m"))).alias("mu1"), F.max(F.when(F.col("a") == 0, F.col("m"))).alias("mu0"))
    cov = m.select(F.col("a").alias("arm1"), F.col("site").alias("candidate1"), F.col("a").alias("arm0"), F.col("site").alias("candidate0"), F.col("v").alias("covariance"))
    return rnd(ro.arm_pairs(means, cov).withColumn("variance", F.round("variance", 9)), skip=("variance",))


@query("R4_quorum_intervals", f"""WITH iv AS (SELECT event_type AS g, value - 1e0 / (1 + event_id % 5) AS lo, value + 1e0 / (1 + event_id % 3) AS hi FROM events),
 pt AS (SELECT g, v, sum(s) AS s, sum(e) AS e FROM (SELECT g, lo AS v, 1 AS s, 0 AS e FROM iv UNION ALL SELECT g, hi, 0, 1 FROM iv) GROUP BY ALL),
 c AS (SELECT *, sum(s - e) OVER (PARTITION BY g ORDER BY v) AS r FROM pt), c2 AS (SELECT *, r - s + e AS l, r + e AS at_ FROM c),
 o AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM c2 WHERE l < 25 AND at_ >= 25), k AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i FROM c2 WHERE at_ >= 25 AND r < 25)
 SELECT o.g, {R('o.v', 'lower')}, {R('k.v', 'upper')} FROM o JOIN k ON o.g = k.g AND o.i = k.i""")
def r4(spark, d):
    e = table(spark, d, "events")
    iv = e.select(F.col("event_type").alias("g"), (F.col("value") - 1.0 / (1 + F.col("event_id") % 5)).alias("lower"), (F.col("value") + 1.0 / (1 + F.col("event_id") % 3)).alias("upper"))
    return rnd(ro.quorum_intervals(iv, 25, ["g"]))


@query("R5_bounded_dispersion", f"""{COH}, s AS (SELECT site, count(*) AS n0, sum(y_bin) AS t, sum(y_bin * y_bin) AS q FROM base GROUP BY site), e AS (SELECT site, (SELECT min(n0) FROM s WHERE site <> 't') AS n, n0, t, q FROM s),
 c AS (SELECT site, n, n0, t / n0 * n AS t, q / n0 * n AS q FROM e),
 g AS (SELECT count(*) FILTER (WHERE site <> 't') AS k, max(n)::DOUBLE AS n, avg((t * t - q) / (n * (n - 1))) FILTER (WHERE site <> 't') AS wi, sum(t / n) FILTER (WHERE site <> 't') AS sm, sum(t * t / (n * n)) FILTER (WHERE site <> 't') AS sm2,
  max(CASE WHEN site = 't' THEN t / n END) AS tm FROM c),
 h AS (SELECT *, wi - (sm * sm - sm2) / (k * (k - 1)) AS st, sm / k AS pm, 1e0 / ((k - 1) * n) AS lf, 2e0 / 16 * (1 / (k * n * (n - 1)) + 1 / (k * (k - 1) * n * n)) AS nf FROM g),
 u AS (SELECT *, (1 - 0.0125e0) / 0.0125e0 AS mu FROM h), w AS (SELECT *, greatest(0, st + mu * lf / 2 + sqrt(greatest(0, mu * lf * st + pow(mu * lf, 2) / 4 + mu * nf))) AS du FROM u),
 x AS (SELECT *, sqrt(ln(2 / 0.0125e0) / (2 * k * n)) + sqrt((k - 2) * (k - 1) / (2e0 * k) * du) AS sr, sqrt(ln(2 / 0.025e0) / (2 * n)) AS tr FROM w),
 y AS (SELECT *, greatest(pm - sr, tm - tr) AS lo, least(pm + sr, tm + tr) AS hi FROM x)
 SELECT k, {R('st', 'statistic', 9)}, {R('pm', 'pooled_mean')}, {R('du', 'dispersion_upper', 8)}, {R('(lo + hi) / 2', 'estimate')}, {R('lo', 'lower')}, {R('hi', 'upper')}, lo > hi AS empty_intersection FROM y""")
def r5(spark, d):
    s = base(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n0"), F.sum("y_bin").alias("t"), F.sum(F.col("y_bin") * F.col("y_bin")).alias("q"))
    m = s.filter("site <> 't'").agg(F.min("n0").alias("n"))
    c = s.crossJoin(m).select("site", F.when(F.col("site") == "t", "target").otherwise("source").alias("role"), "n", (F.col("t") / F.col("n0") * F.col("n")).alias("total"),
                              (F.col("q") / F.col("n0") * F.col("n")).alias("total_sq"))
    out = ro.bounded_dispersion(c, 1.0, valid_min=2)
    return rnd(out.withColumns({"statistic": F.round("statistic", 9), "dispersion_upper": F.round("dispersion_upper", 8)}), skip=("statistic", "dispersion_upper"))
