import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemosaic.operators import joins as jo, metrics as me, robust as ro
from sitemosaic.sources import read_run_results, table_fingerprint, write_results


def runs(spark, n=200, **kw):
    rows = [(i + 1, "c", "m", 0.5, 0.5 + b, b, 1.0, 0.5 + b - 1.96, 0.5 + b + 1.96, 3.92, "TRUE" if i % 3 == 0 else "T" if i % 3 == 1 else "1") for i, b in enumerate(np.linspace(-1, 1, n).tolist())]
    return spark.createDataFrame(rows, "sim_id long, config string, method string, truth double, estimate double, bias double, se double, ci_lower double, ci_upper double, ci_width double, coverage string")


def test_clean_runs_and_each_defect(spark):
    r = runs(spark)
    status = lambda d, **kw: me.diagnose_results(d, z=1.96, se_limits=(0.1, 10.0), **kw).first()["diagnostic_status"]
    base = status(r)
    assert base == "coverage_above_mc_band"
    assert "incomplete_replications" in status(r.filter("sim_id > 5"))
    assert "duplicated_replications" in status(r.unionAll(r.filter("sim_id = 3")))
    assert "nonfinite_values" in status(r.withColumn("estimate", F.when(F.col("sim_id") == 2, float("nan")).otherwise(F.col("estimate"))))
    assert "bias_truth_inconsistent" in status(r.withColumn("bias", F.col("bias") + 0.1))
    assert "coverage_ci_inconsistent" in status(r.withColumn("coverage", F.lit("F")))
    assert "invalid_replication_id" in status(r.withColumn("sim_id", F.col("sim_id") + 0.5))
    assert "nonpositive_standard_error" in status(r.withColumn("se", F.lit(0.0)))
    assert "sparse_binary_cells_detected" in status(r.withColumn("n_site_arm_outcome_cells_below_8", F.lit(2.0)))
    q = me.classify_qc(me.diagnose_results(r.filter("sim_id > 5"), z=1.96)).first()
    assert q["implementation_failed"] and q["statistical_review_required"]


def test_normal_reference_coverage(spark):
    s = spark.createDataFrame([(0.0, 1.0, 1.0, 0.95, 100), (0.0, 0.0, 1.0, 1.0, 10)], "bias_mean double, bias_sd double, se_mean double, coverage double, n_success long")
    got = [r["normal_reference_coverage"] for r in me.mc_errors(s).collect()]
    assert np.isclose(got[0], 0.95) and (got[1] is None or np.isnan(got[1]))


def test_ranks_keep_null_and_ties(spark):
    d = spark.createDataFrame([("a", "target_only", 2.0), ("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", float("nan"))], "config string, method string, rmse double")
    got = {r["method"]: (r["rmse_rank"], r["rmse_relative_to_target"]) for r in me.rank_rmse(d).collect()}
    assert got == {"x": (1, 0.5), "y": (1, 0.5), "target_only": (3, 1.0), "z": (None, None)}


def test_pairing_needs_matching_sets(spark):
    r = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)], "sim_id long, method string, bias double")
    with pytest.raises(ValueError):
        jo.pair_methods(r, "a", "b", ["sim_id"])
    with pytest.raises(ValueError):
        me.paired_mse(r, "a", ["b"], keys=[])
    one = me.paired_mse(r.filter("sim_id = 1"), "a", ["b"], keys=[]).first()
    assert np.isclose(one["mean_squared_error_difference"], 0.01 - 0.04) and one["method_lower_squared_error_fraction"] == 1.0


def test_reader_unions_by_name_and_restores_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sim_id,method,estimate,se\n1,x,0.5,NA\n2,x,0.6,NA\n")
    (tmp_path / "b.csv").write_text("method,sim_id,rho\ny,3,2.5\n")
    r = read_run_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert dict(r.dtypes)["se"] == "double" and r.count() == 3 and r.filter("rho = 2.5").first()["sim_id"] == 3.0


def test_sink_refuses_to_overwrite_and_fingerprint_ignores_order(spark, tmp_path):
    r = spark.createDataFrame([("m", 1.0), ("k", 2.0)], "method string, estimate double")
    write_results(r, str(tmp_path / "out"))
    with pytest.raises(Exception):
        write_results(r, str(tmp_path / "out"))
    f = table_fingerprint(r).first()
    assert f == table_fingerprint(r.select("estimate", "method").orderBy("estimate").repartition(3)).first()
    assert f != table_fingerprint(r.withColumn("estimate", F.col("estimate") + 1)).first()


def test_quorum_intervals_brute_force(spark):
    rng = np.random.default_rng(8)
    lo = np.round(rng.uniform(0, 10, 60), 1)
    hi = np.round(lo + rng.uniform(0, 2, 60), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lo, hi)], "lower double, upper double")
    for m in (1, 5, 9, 60):
        got = sorted((r.lower, r.upper) for r in ro.quorum_intervals(df, m, slices=8).collect())
        pts, want, start = sorted({*lo, *hi}), [], None
        mids = [(p, q) for p, q in zip(pts, pts[1:] + [None])]
        cover = lambda v: int(((lo <= v) & (v <= hi)).sum())
        for p, q in mids:
            if start is None and cover(p) >= m:
                start = p
            right = q is not None and cover((p + q) / 2) >= m
            if start is not None and not right:
                want.append((start, p))
                start = None
        assert np.allclose(np.array(got).reshape(-1), np.array(want).reshape(-1)) and len(got) == len(want)


def test_boundary_flags_append_once(spark):
    d = spark.createDataFrame([("ok", 95.0, None, 1.0), ("nuisance_outcome_boundary_detected", 1.0, 1.0, 99.0)],
                              "diagnostic_status string, max_initial_dr_abs_coefficient double, max_calibrated_dr_abs_coefficient double, max_calibrated_outcome_abs_coefficient double")
    assert [r.diagnostic_status for r in me.augment_qc(d, 100.0).collect()] == ["nuisance_density_ratio_boundary_detected", "nuisance_outcome_boundary_detected"]


def test_wrapped_sum_keeps_small_sums_and_never_overflows(spark):
    from sitemosaic.sources.results_io import wrapped_long
    sums = [0, 5, 2 ** 63 - 1, 2 ** 63, 2 ** 64, 2 ** 64 + 7, 10 ** 30]
    d = spark.createDataFrame([(str(v),) for v in sums], "s string").select(F.col("s").cast("decimal(38,0)").alias("s"))
    want = [(v + 2 ** 63) % 2 ** 64 - 2 ** 63 for v in sums]
    assert [r[0] for r in d.select(wrapped_long("s")).collect()] == want


def test_counting_ids_does_not_carry_the_sums(spark):
    import re
    from sitemosaic.operators import metrics as me
    r = spark.range(40).selectExpr("'m' AS method", "CAST(id % 2 AS int) AS p", "CASE WHEN id % 4 = 3 THEN NULL ELSE id % 10 END AS sim_id", "0.5 + id AS estimate", "CAST(id AS double) AS bias",
                                   "1e0 AS se", "true AS coverage", "0.5e0 AS truth", "id - 2e0 AS ci_lower", "id + 2e0 AS ci_upper")
    d = me.diagnose_results(r, keys=["method", "p"], reference=False)
    plan = d._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Aggregate(keys=[" in line and re.search(r"sim_id#\d+", line.split("functions=")[0]):
            assert "functions=[]" in line
    got = {x.p: (x.n_rows, x.n_unique_replications, x.n_duplicate_replications) for x in d.collect()}
    rows = r.collect()
    for p in (0, 1):
        ids = [x.sim_id for x in rows if x.p == p and x.sim_id is not None]
        assert got[str(p)] == (20, len(set(ids)), len(ids) - len(set(ids)))
