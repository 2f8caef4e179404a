import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemosaic.functions import code_binary, flag01, group_key, parse_bool
from sitemosaic.operators import cohort as co, folds as fo, validation as va
from sitemosaic.operators.quantiles import exact_quantiles
from sitemosaic.plans.cohort_plan import build_sites


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_median_fills_blanks_and_rejects_text(spark):
    df = frame(spark, [("1",), (" ",), (None,), ("3e0",), ("10",)], "x string")
    assert sorted(r.x for r in co.impute_median(df, ["x"]).collect()) == [1.0, 3.0, 3.0, 3.0, 10.0]
    with pytest.raises(Exception, match="non-numeric"):
        co.impute_median(frame(spark, [("1",), ("abc",)], "x string"), ["x"]).collect()
    with pytest.raises(ValueError, match="no observed value"):
        co.impute_median(frame(spark, [(None,)], "x double"), ["x"])


def test_median_uses_training_rows_only(spark):
    df = frame(spark, [(1.0, 1), (3.0, 1), (100.0, 0), (None, 0)], "x double, t int")
    assert 2.0 in [r.x for r in co.impute_median(df, ["x"], F.col("t") == 1).collect()]


def test_mode_ties_go_to_the_first_label_and_blank_counts(spark):
    df = frame(spark, [("b",), ("a",), ("b",), ("a",), (None,), ("",)], "v string")
    assert sorted(r.v for r in co.impute_mode(df, ["v"]).collect()) == ["a", "a", "a", "a", "b", "b"]
    blank = frame(spark, [("",), ("",), ("a",), (None,)], "v string")
    assert sorted(r.v for r in co.impute_mode(blank, ["v"]).collect()) == ["", "", "", "a"]


def test_log1p_rejects_negative(spark):
    with pytest.raises(ValueError, match="non-negative"):
        co.log1p_features(frame(spark, [(-1.0,)], "x double"), ["x"])


def test_one_hot_dictionary_rejects_unknown_levels(spark):
    df = frame(spark, [("a",), ("b",)], "v string")
    assert co.one_hot(df, ["v"], {"v": ["a", "b", "c"]}).columns == ["v_b", "v_c"]
    with pytest.raises(Exception, match="unknown level"):
        co.one_hot(df, ["v"], {"v": ["a"]}).collect()


def test_constant_columns_scale(spark):
    df = frame(spark, [(1.0, 2.0), (3.0, 2.0)], "x double, c double")
    assert [r.c for r in co.standardize(df, ["x", "c"], ddof=0).collect()] == [0.0, 0.0]
    assert sorted(r.x for r in co.standardize(df, ["x"], ddof=1).collect()) == pytest.approx([-2**-0.5, 2**-0.5])


def test_bspline_is_a_partition_of_unity(spark):
    df = spark.range(201).select((F.col("id") / 200.0).alias("x"), (F.col("id") % 2).cast("double").alias("b"))
    out = co.bspline_features(df, ["x", "b"])
    assert len([c for c in out.columns if c.startswith("x_bs")]) == 8 and "b" in out.columns
    full = co.bspline_basis(F.col("x"), [0.25, 0.5, 0.75], 0.0, 1.0)
    v = np.array([list(r) for r in df.select(*full).collect()])
    # the dropped first basis function is what is missing from one
    assert (v >= -1e-12).all() and (v.sum(axis=1) <= 1 + 1e-12).all() and np.allclose(v[-1].sum(), 1.0) and np.allclose(v[0].sum(), 0.0)


def test_collapse_folds_the_tail_into_the_smallest_kept_site(spark):
    df = frame(spark, [(s,) for s in "a" * 5 + "b" * 3 + "c" * 2 + "d"], "site_var string")
    m = {r.raw_site: (r.site_var, r.components) for r in co.collapse_sites(df, 2).collect()}
    assert m["c"] == ("b", "b;c;d") and m["d"][0] == "b" and m["a"] == ("a", "a")


def test_build_sites_labels_and_errors(spark):
    c = frame(spark, [(i, i % 2, float(i), s, float(i)) for i, s in enumerate("aaabbc")], "obs_id long, a int, y double, site_var string, x double")
    o, t = build_sites(c, 2)
    assert {r.site for r in o.select("site").distinct().collect()} == {"t", "s1"}
    assert {r.site: r.components for r in t.collect()} == {"t": "a", "s1": "b;c"}
    with pytest.raises(ValueError):
        build_sites(c, 4)


@pytest.mark.parametrize("bracket", [5, 10_000_000])
def test_exact_quantiles_match_numpy_through_narrowing(spark, bracket):
    x = np.concatenate([np.random.default_rng(1).normal(size=4001), np.full(2500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.05, 0.31, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=200, bracket_rows=bracket)["x"]
    assert np.allclose(got, np.quantile(x, probs), atol=1e-12)


@pytest.mark.parametrize("direct", [50, 10_000_000])
def test_grouped_quantiles_match_numpy(spark, direct):
    rng = np.random.default_rng(2)
    rows = [("big", float(v)) for v in rng.normal(size=3000)] + [("ties", 1.0)] * 50 + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.lo, r.med, r.hi) for r in co.grouped_quantiles(df, "x", "g", {"lo": .05, "med": .5, "hi": .95}, slice_rows=direct).collect()}
    for g in ("big", "ties", "one"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [.05, .5, .95]))


def test_influence_concentration_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(size=2000))]
    got = {r.site: (r.top1_share, r.topm_share) for r in co.influence_concentration(spark.createDataFrame(rows, "obs_id long, site string, influence double"), 7).collect()}
    for s in "ab":
        q = np.sort([v * v for _, t, v in rows if t == s])[::-1]
        assert np.allclose(got[s], (q[0] / q.sum(), q[:7].sum() / q.sum()))


@pytest.mark.parametrize("digits", [1, 3])
def test_folds_do_not_depend_on_partitions_or_slices(spark, digits):
    df = spark.range(3000).select(F.col("id").alias("obs_id"), F.when(F.col("id") % 10 < 7, "t").otherwise("s1").alias("site"), (F.col("id") % 2).cast("int").alias("a"))
    want = {r.obs_id: r.fold for r in fo.assign_folds(df.repartition(1), 5).collect()}
    got = fo.assign_folds(df.repartition(37), 5, digits=digits).collect()
    assert {r.obs_id: r.fold for r in got} == want
    n = {}
    for r in got:
        n.setdefault((r.site, r.a), [0] * 5)[r.fold - 1] += 1
    assert all(max(v) - min(v) <= 1 for v in n.values())


def test_grouped_folds_keep_units_together(spark):
    df = spark.range(400).select(F.col("id").alias("obs_id"), F.lit("t").alias("site"), (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 40).alias("group_id"))
    f = fo.assign_group_folds(df, 4)
    va.assert_groups_in_fold(f)
    with pytest.raises(ValueError, match="crosses"):
        va.assert_groups_in_fold(fo.assign_folds(df, 4))


def test_contract_violations(spark):
    schema = "obs_id long, site string, a int, y double, w array<double>, z array<double>"
    good = [(i, s, i % 2, float(i % 2), [1.0], [1.0]) for i, s in enumerate(["t"] * 4 + ["s1"] * 4)]
    va.validate_cohort(frame(spark, good, schema))
    for bad, msg in (((9, "s1", 2, 1.0, [1.0], [1.0]), "treatment"), ((9, "s1", 1, 0.5, [1.0], [1.0]), "outcome"), ((9, "s1", 1, 1.0, [float("nan")], [1.0]), "features")):
        with pytest.raises(ValueError, match=msg):
            va.validate_cohort(frame(spark, good + [bad], schema))
    with pytest.raises(ValueError, match="target"):
        va.validate_cohort(frame(spark, good[4:], schema))
    with pytest.raises(ValueError, match="too few"):
        va.validate_folds(frame(spark, good, schema), 3, 1)
    with pytest.raises(ValueError):
        va.validate_radius(-1.0)


def test_coding_expressions(spark):
    df = frame(spark, [(" y es ",), ("NO",), ("maybe",), (None,), ("  ",)], "v string")
    got = df.select(code_binary("v", ["YES"], ["NO"]).alias("b"), flag01("v").alias("f"), group_key("v").alias("g"), parse_bool("v").alias("p")).collect()
    assert [r.b for r in got] == [1, 0, None, None, None] and [r.f for r in got] == [0] * 5
    assert [r.g for r in got] == ["y es", "NO", "maybe", "<unspecified>", "<unspecified>"] and all(r.p is None for r in got)


def test_null_keys_and_empty_groups_are_kept(spark):
    from sitemosaic.operators import cohort as co
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), (None, 1.0), (None, 3.0), ("b", None), ("b", None)], "g string, x double")
    w = co.normalize_log_weights(df, "x", ["g"]).collect()
    assert len(w) == 6 and abs(sum(r.weight for r in w if r.g is None) - 2) < 1e-12
    q = {r.g: (r.med, r.hi) for r in co.grouped_quantiles(df, "x", "g", {"med": 0.5, "hi": 1.0}).collect()}
    assert q == {"a": (1.0, 2.0), None: (2.0, 3.0), "b": (None, None)}
    d = {r.g for r in co.weight_diagnostics(df, "x", "g").collect()}
    assert d == {"a", "b", None}


def test_quantiles_do_not_depend_on_the_slices(spark):
    import numpy as np
    from sitemosaic.operators import cohort as co
    x = np.random.default_rng(1).normal(size=500).round(1)
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)], "g int, x double")
    for rows in (10, 100, 10_000):
        got = {r.g: (r.a, r.b) for r in co.grouped_quantiles(df, "x", "g", {"a": 0.37, "b": 0.9}, slice_rows=rows).collect()}
        for g in range(3):
            assert np.allclose(got[g], np.quantile(x[g::3], [0.37, 0.9]))


def test_many_levels_are_coded(spark):
    from sitemosaic.operators import cohort as co
    df = spark.range(1200).selectExpr("id", "concat('l', id) AS c")
    assert len(co.one_hot(df, ["c"]).columns) == 1200


def test_bad_number_fails(spark, tmp_path):
    import pytest
    from sitemosaic.sources import read_run_results
    (tmp_path / "r.csv").write_text("sim_id,estimate\n1,0.5\n2,oops\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        read_run_results(spark, [str(tmp_path / "r.csv")]).collect()


def test_selection_folds_read_the_numbered_rows_from_the_cache(spark):
    o = spark.range(400).select(F.col("id").alias("obs_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("site"), (F.col("id") % 3 == 0).cast("int").alias("a"))
    plain = fo.assign_folds(o, 3)
    got = fo.assign_cv_folds(plain)
    assert plain.is_cached
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    fresh = fo.assign_cv_folds(fo.assign_folds(o, 3).localCheckpoint()).select("obs_id", "fold", "cv")
    assert got.select("obs_id", "fold", "cv").exceptAll(fresh).isEmpty() and got.count() == 400


def test_quantiles_of_large_groups_count_only_values_in_brackets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    rows = [("big", float(v)) for v in x] + [(None, float(v)) for v in x[:9000] * 3] + [("small", float(v)) for v in x[:7]] + [("ties", float(i % 3)) for i in range(5000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.lo, r.med, r.top) for r in co.grouped_quantiles(df, "x", "g", {"lo": .05, "med": .5, "top": 1.0}, accuracy=500).collect()}
    for g in ("big", None, "small", "ties"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [.05, .5, 1.0])), g
    assert got["none"] == (None, None, None)
    ends = df.filter("g = 'big'").groupBy("g").agg(F.percentile_approx("x", [.496, .504], 500).alias("_e"))
    counted = co.bracket_counts(df.filter("g = 'big'").withColumnRenamed("x", "_x"), ["g"], ends, 1).collect()
    assert len(counted) < 600 and sum(r._c for r in counted) == 20_000


def test_a_missed_bracket_is_ranked_exactly(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=900)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    real = co.bracket_counts
    monkeypatch.setattr(co, "bracket_counts", lambda rows, by, b, k: real(rows, by, b.withColumn("_e", F.array(*[F.lit(9.0)] * (2 * k))), k))
    got = co.grouped_quantiles(df, "x", "g", {"med": 0.5, "hi": 0.9}, accuracy=50).collect()
    assert np.allclose([got[0].med, got[0].hi], np.quantile(x, [.5, .9]))
