import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemosaic import constants as C
from sitemosaic.operators import fits as fi, influence as inf, moments as mo, newton as nw, resample as rs, scores as sc, weights as we
from sitemosaic.operators.gram import Model, accumulate, prepare, unpack
from sitemosaic.plans import crossfit as cf, estimators as es
from sitemosaic.plans.weight_layer import weight_gradients, weight_layer


def toy(n=600, seed=0, sites=("t", "s1", "s2"), p=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    site = np.array(sites)[rng.integers(0, len(sites), n)]
    a = (rng.random(n) < 1 / (1 + np.exp(-0.4 * x[:, 0]))).astype(int)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * a + x[:, 1] - 0.5 * x[:, -1])))).astype(float)
    return x, site, a, y


def frame(spark, x, site, a, y, folds=4, weight=None):
    rows = [(i, str(site[i]), int(a[i]), float(y[i]), [float(v) for v in x[i]], [float(v) for v in x[i]], i % folds + 1, i % 5 + 1, float(1.0 if weight is None else weight[i])) for i in range(len(a))]
    return spark.createDataFrame(rows, "obs_id long, site string, a int, y double, w array<double>, z array<double>, fold int, cv int, weight double")


@pytest.fixture(scope="module")
def data():
    return toy()


def test_gram_pass_matches_numpy_for_any_partitioning(spark, data):
    x, site, a, y = data
    m = Model(("k",), "s1", 1, (2,), family="binomial")
    beta = np.array([[0.1, 0.2, -0.3, 0.4]])
    keep = (site == "s1") & (np.arange(len(a)) % 4 + 1 != 2)
    d = np.c_[np.ones(len(a)), x][keep & (a == 1)]
    mu = 1 / (1 + np.exp(-d @ beta[0]))
    for parts in (1, 8, 60):
        f = prepare(frame(spark, *data).repartition(parts))
        n_all, n_used, _, _, g, h = unpack(accumulate(f, [m], beta), 4)
        assert round(n_all[0]) == keep.sum() and round(n_used[0]) == len(d)
        assert np.allclose(g[0], d.T @ (mu - y[keep & (a == 1)])) and np.allclose(h[0], (d * (mu * (1 - mu))[:, None]).T @ d)


def test_lasso_satisfies_kkt_and_lambda_max_gives_the_null_model(spark, data):
    x, site, a, y = data
    f = prepare(frame(spark, *data))
    for fam, resp in (("binomial", y), ("gaussian", y)):
        fit = fi.fit_lasso_glm(f, [("or", "*", 1, ())], fam, lam=0.03)[0]
        d, r = np.c_[np.ones(len(a)), x][a == 1], resp[a == 1]
        mu = d @ fit.beta if fam == "gaussian" else 1 / (1 + np.exp(-d @ fit.beta))
        g = d.T @ (mu - r) / len(r)
        pen = np.r_[0, 0.03 * x[a == 1].std(axis=0)]
        assert np.all(np.where(fit.beta != 0, np.abs(g + pen * np.sign(fit.beta)), np.maximum(np.abs(g) - pen, 0)) < 2e-6)
    big = fi.fit_lasso_glm(f, [("or", "*", 1, ())], "binomial", lam=10.0)[0]
    assert np.all(big.beta[1:] == 0)


def test_cross_validation_picks_a_grid_point_and_reports_the_path(spark, data):
    f = prepare(frame(spark, *data))
    fit = fi.fit_outcome(f, [("or", "*", 1, ())], "binomial", nlambda=8)[0]
    lams = [p[0] for p in fit.path]
    assert fit.lam in lams and fit.cv_mean == min(p[1] for p in fit.path) and fit.converged
    grid, scores = np.array([4.0, 2.0, 1.0]), np.array([[1.0, 1.2], [0.9, 1.2], [np.inf, 0.1]])
    assert nw.select_lambda(grid, scores, "min")[0] == 1 and nw.select_lambda(grid, scores, "1se")[0] == 0


def test_tilt_balances_the_target_and_fails_when_unbounded(spark, data):
    x, site, a, y = data
    f = prepare(frame(spark, *data))
    ks = fi.keys("dr", ["s1"], (1,), [()])
    mom = fi.target_moments(f, ks)
    fit = fi.fit_density_ratio(f, ks, mom, lam=0.0, radius=float("inf"))[0]
    d = np.c_[np.ones(len(a)), x][site == "s1"]
    w = np.exp(-d @ fit.beta) * (a[site == "s1"] == 1)
    assert np.allclose(d.T @ w / len(d), np.r_[1, x[site == "t"].mean(axis=0)], atol=1e-8)
    with pytest.raises(nw.FitError):
        fi.fit_density_ratio(f, ks, {ks[0]: np.array([1.0, 50.0, 0.0, 0.0])}, lam=0.0, radius=float("inf"))


def test_aliased_design_fails_and_small_class_is_constant(spark, data):
    x, site, a, y = data
    f = prepare(frame(spark, np.c_[x[:, :2], x[:, 0] * 2], site, a, y))
    with pytest.raises(nw.FitError, match="aliased"):
        fi.fit_glm(f, [("or", "*", 1, ())], "gaussian")
    rare = np.zeros(len(y))
    rare[np.flatnonzero(a == 1)[:3]] = 1
    g = prepare(frame(spark, x, site, a, rare))
    c = fi.fit_outcome(g, [("or", "*", 1, ())], "binomial", lam=0.01)[0]
    assert c.rule == "degenerate_constant" and np.isclose(1 / (1 + np.exp(-c.beta[0])), rare[a == 1].mean()) and np.all(c.beta[1:] == 0)


def test_fits_never_see_the_dropped_fold(spark, data):
    x, site, a, y = data
    shifted = y.copy()
    held = np.arange(len(a)) % 4 + 1 == 2
    shifted[held] = 1 - shifted[held]
    k = [("or", "*", 1, (2,))]
    one, two = (fi.fit_glm(prepare(frame(spark, x, site, a, v)), k, "binomial")[0].beta for v in (y, shifted))
    assert np.array_equal(one, two)


def test_calibration_excludes_outer_and_own_fold(spark, data):
    f = prepare(frame(spark, *data))
    r = fi.calibrate_source(f, ["s1", "s2"], (1, 0), [(1,)], "binomial", lam=0.02, folds=[1, 2, 3, 4])
    assert {m.model.key[3] for m in r["or_init"]} == {(1, 2), (1, 3), (1, 4)}
    for fit in r["dr"] + r["or"]:
        assert fit.model.drop == (1,) and [c for c, _ in fit.model.plug] == [2, 3, 4] and fit.converged


def test_weight_solver_kkt_and_rules(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6):
        b = rng.normal(size=(50, 4))
        c = np.cov(np.c_[b, b[:, :1] + rng.normal(size=(50, 1))].T)[:4, :4]
        cr = c[1:, 1:].copy()
        vt = np.diag(cr).copy()
        np.fill_diagonal(cr, 0)
        rows.append((i, 400, [300, 500, 200], 0.5, list(map(float, 0.5 + rng.normal(size=3) * 0.1)), float(c[0, 0]), list(map(float, vt)), [1.0, 2.0, 1.5], list(map(float, c[0, 1:])),
                     [list(map(float, r)) for r in cr]))
    m = spark.createDataFrame(rows, "i int, n_t long, n_s array<long>, mu_t double, mu_s array<double>, v_ot double, v_t array<double>, v_s array<double>, c_ot array<double>, c_cross array<array<double>>")
    for rule in we.RULES:
        pdf = we.solve_weights(m, 1.0, rule).toPandas()
        assert (pdf["kkt"] < 1e-9).all()
        q, l, n = we.quadratic_form(pdf)
        eta = np.array(pdf["eta"].to_list())
        pen = np.maximum(np.array(pdf["wald"].to_list()) - 1, 0) / n[:, None]
        if rule == "soft_penalty":
            f = lambda e, i: e @ q[i] @ e + 2 * l[i] @ e + pen[i] @ np.abs(e)
            for i in range(len(eta)):
                assert all(f(eta[i], i) <= f(eta[i] + s * 1e-3 * np.eye(3)[j], i) + 1e-12 for j in range(3) for s in (1, -1))
        if rule == "hard_threshold":
            assert np.all(eta[np.array(pdf["wald"].to_list()) > 1] == 0)
        v = we.aggregate_variance(we.solve_weights(m, 1.0, rule)).toPandas()
        want = pdf["v_ot"] / pdf["n_t"] + [e @ q[i] @ e + 2 * l[i] @ e for i, e in enumerate(eta)]
        assert np.allclose(v["variance"], np.maximum(want, C.VARIANCE_FLOOR))
    zero = we.aggregate_variance(m.withColumn("eta", F.array(*[F.lit(0.0)] * 3))).toPandas()
    assert np.allclose(zero["variance"], zero["v_ot"] / zero["n_t"])


def test_dl_edge_cases(spark):
    s = "site string, estimate double, variance double, v_ot double, n long"
    one = spark.createDataFrame([("t", 1.0, 0.1, 10.0, 100)], s)
    assert es.dl_heterogeneity(one).first()["tau2"] == 0.0
    same = spark.createDataFrame([("t", 1.0, 0.1, 10.0, 100), ("s1", 1.0, 0.2, 10.0, 50)], s)
    r = es.inverse_variance_weighted(same).first()
    assert r["tau2"] == 0.0 and np.isclose(r["estimate"], 1.0) and np.isclose(r["model_variance"], 1 / (10 + 5))
    tiny = spark.createDataFrame([("t", 1.0, 1e-12, 1e-10, 100), ("s1", 2.0, 1e-12, 1e-10, 100)], s)
    assert np.isclose(es.dl_heterogeneity(tiny).first()["total_precision"], 2 / C.VARIANCE_FLOOR)


def test_arms_with_different_rows_or_sites_fail(spark):
    f = lambda ids: spark.createDataFrame([("t", i, 0.1 * i) for i in ids], "site string, obs_id long, influence double")
    r = lambda d, w: es.ArmResult("m", 1, 1.0, 0.1, d, w, 3)
    with pytest.raises(ValueError):
        es.combine_arms(r(f([1, 2]), {"t": 1.0}), r(f([1, 2]), {"t": 1.0, "s1": 0.0}))
    with pytest.raises(Exception, match="different rows"):
        es.combine_arms(r(f([1, 2]), {"t": 1.0}), r(f([1, 3]), {"t": 1.0}))[0].collect()


def test_both_arms_come_from_one_scan_and_the_driver_keeps_small_plans(spark):
    """E7, E10: the contrast needs no join of the arms and no cached rows of its own, and its plan does not repeat the plan of its input."""
    from dataclasses import replace
    x, site, a, y = toy(600, 5, p=2)
    ms = ["target_only", "inverse_variance", "tilted_aipw", "federated_dr", "pooled_dr"]
    f = frame(spark, x, site, a, y)
    for _ in range(6):  # a long way from the tables to the rows
        f = f.join(f.groupBy("site").count().drop("count"), "site")
    res, arms = es.compare_methods(f, ms, "binomial", 4, b=50, lam=0.01)
    got = {r["method"]: r for r in res.collect()}
    assert set(got) == set(ms) and all(r["variance_method"] == "bootstrap" for r in got.values())
    assert res._jdf.queryExecution().analyzed().toString().count("\n") < 100
    for m in ms:
        one, infl = es.combine_arms(*arms[m])
        r1, r0 = (replace(r, pair=None) for r in arms[m])
        two, joined = es.combine_arms(r1, r0)
        u, v = one.first(), two.first()
        assert all(np.isclose(u[c], v[c], rtol=1e-9, atol=1e-15) for c in ("estimate", "variance_analytic", "mu1_se", "mu0_se", "cross_arm_correlation"))
        assert np.isclose(u["variance_analytic"] ** 0.5, got[m]["se_analytic"]) or u["variance_analytic"] <= C.VARIANCE_FLOOR
        assert infl.count() == joined.count() == ((site == "t").sum() if m == "target_only" else len(a))
        plan = infl._jdf.queryExecution().optimizedPlan().toString()
        assert "FullOuter" not in plan and plan.count("Relation [") == 1  # files, or the cached scores


def test_pooled_dr_holds_no_rows_in_the_executors(spark):
    from sitemosaic.catalog import QUERIES
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    got = QUERIES["E7_pooled_dr"](spark, "/root/testdata/sf0.01").first()
    assert got["n"] == 15_000 and held() <= before


def test_weights_of_sites_equal_the_general_ones(spark):
    from sitemosaic.operators.cohort import normalize_log_weights
    x, site, a, y = toy(300, 6, p=2)
    f = frame(spark, x, site, a, y)
    tilts = {"t": np.zeros(3), "s1": np.array([0.2, -0.5, 0.3]), "s2": np.array([-1.0, 400.0, 0.1]), "gone": np.ones(3)}
    got = inf.site_weights(f, tilts, 2)
    eta = F.when(F.col("site") == "t", 0.0)
    for s in ("s1", "s2"):
        eta = eta.when(F.col("site") == s, float(tilts[s][0]) + F.col("z")[0] * float(tilts[s][1]) + F.col("z")[1] * float(tilts[s][2]))
    want = {r["obs_id"]: r["raw"] for r in normalize_log_weights(f.withColumn("lw", -eta), "lw", ["site"], "raw").collect()}
    rows = got.collect()
    assert len(rows) == len(a) and all(np.isclose(r["raw_weight"], want[r["obs_id"]], rtol=1e-12, atol=0) for r in rows)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString()


def brute_estimate(x, a, y, w, mass):
    """Weighted AIPW with maximum-likelihood nuisances under row masses."""
    d = np.c_[np.ones(len(a)), x]

    def logit(dd, r, m):
        b = np.zeros(dd.shape[1])
        for _ in range(60):
            mu = 1 / (1 + np.exp(-dd @ b))
            b += np.linalg.solve((dd * (m * mu * (1 - mu))[:, None]).T @ dd, dd.T @ (m * (r - mu)))
        return b

    p = np.clip(1 / (1 + np.exp(-d @ logit(d, a, mass))), *C.PROPENSITY_CLIP)
    m = np.clip(1 / (1 + np.exp(-d @ logit(d[a == 1], y[a == 1], mass[a == 1]))), *C.OUTCOME_CLIP)
    phi = m + a * (y - m) / p
    return (mass * w * phi).sum() / (mass * w).sum()


def test_influence_is_the_numerical_derivative(spark):
    x, site, a, y = toy(200, 3, ("t",), 2)
    w = np.exp(0.2 * x[:, 0])
    f = prepare(frame(spark, x, site, a, y), weight="weight")
    ps = {"t": fi.fit_glm(f, fi.keys("ps", ["t"], (1,), [()]), "binomial", "a")[0]}
    orr = {"t": fi.fit_glm(f, fi.keys("or", ["t"], (1,), [()]), "binomial")[0]}
    rows = frame(spark, x, site, a, y, weight=w)
    r, t = inf.weighted_aipw(f, rows, ps, orr, 2, "binomial", 1)
    got = {v.obs_id: v.influence for v in r.collect()}
    base = np.ones(len(a))
    assert np.isclose(t["t"]["estimate"], brute_estimate(x, a, y, w, base))
    for i in range(0, 200, 17):
        up, dn = base.copy(), base.copy()
        up[i] += 1e-4
        dn[i] -= 1e-4
        num = (brute_estimate(x, a, y, w, up) - brute_estimate(x, a, y, w, dn)) / 2e-4 * len(a)
        assert np.isclose(got[i], num, rtol=2e-4, atol=2e-4)


def test_redundant_columns_are_solved_in_the_identifiable_space():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    d = np.c_[np.ones(300), x, x[:, 0] + x[:, 1]]
    plain = d.T @ d / 300
    factor = np.linalg.qr(d, mode="r")
    direction, info = inf.solve_curvature(plain, factor, plain @ np.array([0.1, 0.2, 0.3, 0.0]))
    assert info["rank"] == 3 and np.allclose(plain @ direction, plain @ np.array([0.1, 0.2, 0.3, 0.0]))
    with pytest.raises(inf.CurvatureError):
        inf.solve_curvature(plain, factor, np.array([0.0, 1.0, 0.0, 0.0]))
    # nearly redundant: neither dropped nor solved
    near = np.c_[d[:, :3], d[:, 3] + 1e-9 * rng.normal(size=300)]
    with pytest.raises(inf.CurvatureError, match="nearly"):
        inf.solve_curvature(near.T @ near / 300, np.linalg.qr(near, mode="r"), plain @ np.array([0.1, 0.2, 0.3, 0.0]))
    # a constant column is redundant
    flat = np.c_[d[:, :3], np.full(300, 7.0)]
    g = flat.T @ flat / 300
    direction, info = inf.solve_curvature(g, np.linalg.qr(flat, mode="r"), g @ np.array([0.1, 0.2, 0.3, 0.0]))
    assert info["rank"] == 3 and np.allclose(g @ direction, g @ np.array([0.1, 0.2, 0.3, 0.0]))


def test_design_factors_equal_the_gram(spark):
    rng = np.random.default_rng(2)
    rows = [(("t", "s1")[i % 2], i % 3 % 2, [float(v) for v in rng.normal(size=3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "site string, a int, w array<double>").repartition(7)
    got = inf.design_factors(df, [("t", None), ("s1", 1), (None, None), ("none", None)], 3)
    for f, keep in zip(got, (lambda r: r[0] == "t", lambda r: r[0] == "s1" and r[1] == 1, lambda r: True, lambda r: False)):
        m = np.array([[1.0, *r[2]] for r in rows if keep(r)]).reshape(-1, 4)
        assert np.allclose(f.T @ f, m.T @ m)


@pytest.fixture(scope="module")
def saved(spark):
    x, site, a, y = toy(900, 7)
    o = cf.Options(k=3, family="binomial", lam=0.01)
    return cf.fit_and_score(frame(spark, x, site, a, y, folds=3).drop("cv", "weight"), o)


def test_scores_cover_every_row_once_and_no_leak(saved):
    outer, inner = cf.split_scores(saved.scores)
    assert outer.count() == saved.n_all and inner.count() == 2 * saved.n_all
    assert outer.select("obs_id").distinct().count() == saved.n_all


def test_modes_agree_in_form_and_weights_scale(saved):
    for mode in ("common_tate", "separate_arms", "joint_tate"):
        r = cf.aggregate_tate(saved, mode)[0].first()
        assert r["n"] == saved.n_all and np.isfinite(r["estimate"]) and r["variance"] > 0
    same = cf.sensitivity_grid(saved, [1.0], [5.0]).first()
    assert np.isclose(same["estimate"], cf.reaggregate(saved, cutoff=1.0, mode="common_tate").first()["estimate"], atol=1e-12)


def test_pooled_moments_equal_moments_of_fold_centred_rows(saved):
    _, inner = cf.split_scores(saved.scores)
    got = {r.outer_fold: r for r in mo.pool_moments(cf.inner_moments(saved, (2,)), 2).collect()}
    pdf = sc.long_arms(inner, (2,)).toPandas()
    for o, g in pdf.groupby("outer_fold"):
        t = g[g.site == "t"]
        z = np.c_[t["phi"], np.array(t["psi"].to_list())]
        zc = np.concatenate([z[t.fold == f] - z[t.fold == f].mean(axis=0) for f in t.fold.unique()])
        cov = zc.T @ zc / len(zc)
        assert np.isclose(got[o].v_ot, cov[0, 0]) and np.allclose(got[o].c_ot, cov[0, 1:]) and np.isclose(got[o].c_cross[0][1], cov[1, 2])
        assert np.isclose(got[o].mu_t, t["phi"].mean())


@pytest.mark.parametrize("rule", ["soft_penalty", "quadratic_bias"])
def test_weight_layer_gradient_is_the_numerical_derivative(saved, rule):
    """Perturb one row's mass in the inner moments and re-solve the weights."""
    lam = 2.0
    g, w, _ = weight_gradients(saved, 2, lam, rule)
    got = {(r.obs_id): r.gradient for r in g.collect()}
    _, inner = cf.split_scores(saved.scores)
    pdf = sc.long_arms(inner, (2,)).toPandas()
    outer = sc.long_arms(cf.split_scores(saved.scores)[0], (2,)).toPandas()
    sizes = np.array([saved.sizes[s] for s in saved.sources])

    def estimate(mass):
        tot = 0.0
        for o, rows in pdf.groupby("outer_fold"):
            m = rows["obs_id"].map(lambda i: mass.get(i, 1.0)).to_numpy()
            t = (rows.site == "t").to_numpy()
            z = np.c_[rows["phi"][t], np.array(rows["psi"][t].to_list())]
            mt, ft = m[t], rows["fold"].to_numpy()[t]
            zc = z.copy()
            for f in np.unique(ft):
                zc[ft == f] -= (mt[ft == f, None] * z[ft == f]).sum(axis=0) / mt[ft == f].sum()
            cov, mean = (zc * mt[:, None]).T @ zc / mt.sum(), (mt[:, None] * z).sum(axis=0) / mt.sum()
            vs, de = [], []
            for s in saved.sources:
                k = (rows.site == s).to_numpy()
                c, mk, fk = rows["corr"].to_numpy(float)[k], m[k], rows["fold"].to_numpy()[k]
                cc = c.copy()
                for f in np.unique(fk):
                    cc[fk == f] -= (mk[fk == f] * c[fk == f]).sum() / mk[fk == f].sum()
                vs.append((mk * cc ** 2).sum() / mk.sum())
                de.append((mk * c).sum() / mk.sum())
            ns = np.array([(rows.site == s).sum() for s in saved.sources], dtype=float)
            nt = float(t.sum())
            q = (cov[0, 0] - cov[0, 1:, None] - cov[0, None, 1:] + cov[1:, 1:]) / nt + np.diag(np.array(vs) / ns)
            l = (cov[0, 1:] - cov[0, 0]) / nt
            disc = mean[1:] + np.array(de) - mean[0]
            if rule == "quadratic_bias":
                eta = np.linalg.solve(q + np.diag(nt ** -0.25 * disc ** 2), -l)
            else:
                wald = np.abs(disc) / np.sqrt(np.maximum(np.diag(q), C.VARIANCE_FLOOR))
                pen = np.maximum(lam * wald - 1, 0) / (nt + ns.sum())
                eta, _, _ = we.solve_quadratic(q[None], l[None], pen[None])
                eta = eta[0]
            r = outer[outer.outer_fold == o]
            rt = r[r.site == "t"]
            inc = (np.array(rt["psi"].to_list()) - rt["phi"].to_numpy(float)[:, None]).sum(axis=0) / saved.sizes["t"]
            inc = inc + np.array([r[r.site == s]["corr"].astype(float).sum() for s in saved.sources]) / sizes
            tot += eta @ inc
        return tot

    ids = list(pdf[pdf.site == "t"]["obs_id"].unique()[:3]) + list(pdf[pdf.site == "s1"]["obs_id"].unique()[:3])
    for i in ids:
        num = (estimate({i: 1 + 1e-4}) - estimate({i: 1 - 1e-4})) / 2e-4
        assert np.isclose(got[i], num, rtol=5e-3, atol=1e-9), (i, got[i], num)
    layer = weight_layer(saved, 2, lam, rule).first()
    assert layer["max_site_sum"] < 1e-9 and layer["variance_fixed"] > 0


def test_bootstrap_is_partition_free_and_close_to_analytic(spark):
    rng = np.random.default_rng(4)
    rows = [("m", "t" if i % 3 else "s1", i, float(v)) for i, v in enumerate(rng.normal(size=3000))]
    f = spark.createDataFrame(rows, "method string, site string, obs_id long, influence double")
    w = spark.createDataFrame([("m", "t", 0.6), ("m", "s1", 0.4)], "method string, site string, weight double")
    a, b = (rs.multiplier_bootstrap(f.repartition(k), w, 2000, 9).first()["se_bootstrap"] for k in (1, 13))
    v = {s: np.var([r[3] for r in rows if r[1] == s]) / sum(r[1] == s for r in rows) for s in ("t", "s1")}
    assert np.isclose(a, b, rtol=1e-9) and np.isclose(a, np.sqrt(0.36 * v["t"] + 0.16 * v["s1"]), rtol=0.06)
    bits = rs.hash_bits(np.arange(2000), np.arange(4), 1)
    assert abs((bits >> np.uint64(63)).astype(float).mean() - 0.5) < 0.03


def test_weight_bootstrap_fixed_draws_match_brute_force(saved):
    d = cf.weight_bootstrap(saved, 40, seed=3).toPandas()
    assert len(d) == 40 and np.isfinite(d[["fixed", "relearned"]].to_numpy()).all()
    w = {r.outer_fold: np.array(r.eta) for r in cf.learn_weights(saved, (2,)).collect()}
    pdf = sc.long_arms(cf.split_scores(saved.scores)[0], (2,)).toPandas()
    u = (rs.hash_bits(pdf["obs_id"].to_numpy(), np.arange(40), 3) >> np.uint64(11)).astype(float) + 0.5
    mass = -np.log(u * 2.0 ** -53)
    want = np.zeros(40)
    for s in ["t", *saved.sources]:
        k = (pdf.site == s).to_numpy()
        g = pdf[k]
        e = np.array([w[o] for o in g.outer_fold])
        v = (1 - e.sum(axis=1)) * g["phi"].to_numpy(float) + (e * np.array(g["psi"].to_list())).sum(axis=1) if s == "t" else e[:, saved.sources.index(s)] * g["corr"].to_numpy(float)
        want += (mass[k] * v[:, None]).sum(axis=0) / mass[k].sum(axis=0)
    assert np.allclose(d.sort_values("draw")["fixed"], want, atol=1e-10)


def test_density_influence_is_the_numerical_derivative(spark):
    """Only the density weights react to the masses; nuisances and direct masses stay fixed."""
    x, site, a, y = toy(400, 11, ("t", "s1"), 2)
    x[site == "s1", 0] += 0.4
    f = prepare(frame(spark, x, site, a, y))
    w, dr = inf.density_ratio_weights(f, ["s1"], lam=0.0)
    ps = {s: fi.fit_glm(f, fi.keys("ps", [s], (1,), [()]), "binomial", "a")[0] for s in ("t", "s1")}
    orr = {s: fi.fit_glm(f, fi.keys("or", [s], (1,), [()]), "binomial")[0] for s in ("t", "s1")}
    r, t = inf.weighted_aipw(f, w, ps, orr, 2, "binomial", 1)
    src, tgt = inf.density_influence(f, r, dr, 2)
    phi = {v.obs_id: v.phi for v in r.filter("site = 's1'").collect()}
    s_ids, t_ids = np.flatnonzero(site == "s1"), np.flatnonzero(site == "t")
    d, dt, ph = np.c_[np.ones(len(s_ids)), x[s_ids]], np.c_[np.ones(len(t_ids)), x[t_ids]], np.array([phi[i] for i in s_ids])

    def estimate(ms, mt):
        m0, b = (mt[:, None] * dt).sum(axis=0) / mt.sum(), np.zeros(3)
        for _ in range(80):
            e = np.exp(-d @ b) * ms / ms.sum()
            step = np.linalg.solve((d * e[:, None]).T @ d, m0 - d.T @ e)
            b -= step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        tilt = np.exp(-d @ b)
        wt = np.clip(tilt / ((ms * tilt).sum() / ms.sum()), *C.DR_WEIGHT_CLIP)
        return (wt * ph).sum() / wt.sum()

    assert np.isclose(t["s1"]["estimate"], estimate(np.ones(len(s_ids)), np.ones(len(t_ids))))
    gs = {v.obs_id: v.density_part for v in src.collect()}
    gt = {v.obs_id: v.parts[0]["density_part"] for v in tgt.collect()}
    for k in range(0, 150, 29):
        for ids, got, which in ((s_ids, gs, 0), (t_ids, gt, 1)):
            def moved(h):
                m = [np.ones(len(s_ids)), np.ones(len(t_ids))]
                m[which][k] += h
                return estimate(*m)
            num = (moved(1e-4) - moved(-1e-4)) / 2e-4 * len(ids)
            assert np.isclose(got[ids[k]], num, rtol=1e-3, atol=1e-5), (which, k)


def test_units_and_modes_of_the_plan(spark):
    """Repeated units stay in one fold; the grid follows the fitted mode; what is undefined is refused."""
    import numpy as np
    import pytest
    from pyspark.sql import functions as F
    from sitemosaic.plans import crossfit as cf
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        site = ("t", "s1", "s2")[i % 3]
        x = float(rng.normal())
        a = int(rng.random() < 1 / (1 + np.exp(-0.3 * x)))
        rows.append((i, site, a, float(0.5 * a + x + rng.normal()), [x], [x], i // 18 + 1 if i % 2 else None))
    obs = spark.createDataFrame(rows, "obs_id long, site string, a int, y double, w array<double>, z array<double>, group_id long")
    o = cf.Options(k=3, family="gaussian", lam=0.01, aggregation="separate_arms", source_program="standard")
    saved = cf.fit_and_score(obs, o)
    spread = saved.data.join(obs.select("obs_id", "group_id"), "obs_id").filter("group_id IS NOT NULL").groupBy("site", "group_id").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert spread == 1 and saved.data.count() == 900
    for mode in ("common_tate", "separate_arms", "joint_tate"):
        s = cf.replace(saved, options=cf.replace(o, aggregation=mode))
        want = cf.aggregate_tate(s, lam=1.0)[0].first()
        got = cf.sensitivity_grid(s, [1.0], [o.radius]).first()
        assert abs(got["estimate"] - want["estimate"]) < 1e-10 and abs(got["se"] - want["se"]) < 1e-10
    with pytest.raises(ValueError, match="bootstrap"):
        cf.weight_bootstrap(saved, 10)
    with pytest.raises(ValueError, match="cross-validation"):
        cf.learn_joint_weights(saved, "cv")
    with pytest.raises(ValueError, match="three folds"):
        cf.fit_and_score(obs, cf.replace(o, k=2))
    moved = obs.withColumn("fold", (F.floor(F.col("obs_id") / 3) % 3 + 1).cast("int"))
    with pytest.raises(ValueError, match="crosses"):
        cf.fit_and_score(moved, o)


def test_more_folds_than_bits(spark):
    import numpy as np
    from sitemosaic.operators import gram
    rows = [(i, "s1", i % 2, float(i), [float(i % 7)], [float(i % 7)], i % 80 + 1) for i in range(400)]
    data = gram.prepare(spark.createDataFrame(rows, "obs_id long, site string, a int, y double, w array<double>, z array<double>, fold int").selectExpr("*", "1 AS cv"))
    m = gram.Model(key=("m",), site="s1", arm=None, drop=(70, 3), family="gaussian", response="y")
    got = gram.accumulate(data, [m], np.zeros((1, 2)))
    assert got[0, 0] == 390


def test_heterogeneity_without_cancellation(spark):
    import numpy as np
    from sitemosaic.plans.estimators import dl_heterogeneity
    e = np.array([1e5, 1e5 + 1e-3, 1e5 - 2e-3])
    df = spark.createDataFrame([(f"s{i}", float(v), 1e-6, 10) for i, v in enumerate(e)], "site string, estimate double, variance double, n long")
    got = dl_heterogeneity(df).first()
    assert abs(got["q"] - ((e - e.mean()) ** 2).sum() * 1e6) < 1e-3


def test_series_give_the_fits_of_row_passes(spark, monkeypatch):
    """Paths and held-out losses from series equal those of passes over rows, which the series replace."""
    x, site, a, y = toy(n=3000, p=2)
    x = np.random.default_rng(5).permutation(np.clip(x[:, :1], -2, 2))
    f = prepare(frame(spark, x, site, a, y))
    g = {"plug": np.array([0.1, 0.2])}
    target = np.array([1.0, 0.1])

    def all_fits():
        ps = fi.fit_propensity(f, fi.keys("ps", ["s1", "s2"], (1,), [(1,), (2,)]), nlambda=6)
        dk = fi.keys("dr", ["s1"], (1, 0), [(1,)])
        dr = fi.fit_density_ratio(f, dk, {k: target for k in dk}, nlambda=6)
        wk = fi.keys("or", ["s1"], (1,), [(3,)])
        return ps + dr + fi.fit_weighted_outcome(f, wk, {k: ((0, g["plug"]),) for k in wk}, "binomial", nlambda=6)

    passes = []
    advance = nw.advance
    monkeypatch.setattr(nw, "advance", lambda *args, **kw: passes.append(1) or advance(*args, **kw))
    monkeypatch.setattr(nw, "held_out_sums", lambda *args, **kw: pytest.fail("held-out losses come from the series"))
    got = all_fits()
    assert not passes
    monkeypatch.undo()
    monkeypatch.setattr(nw.se, "ORDER", {})
    for one, want in zip(got, all_fits()):
        assert np.allclose(one.beta, want.beta, atol=1e-9) and one.lam == pytest.approx(want.lam) and one.converged == want.converged
        assert np.allclose([v for _, v in one.path], [v for _, v in want.path], rtol=1e-9)


def test_arm_correlation_of_the_query_has_no_floor(spark, tmp_path):
    """Variances of the arm means below the floor: the registered query follows its SQL, which has none."""
    import duckdb

    from sitemosaic import catalog
    from sitemosaic.catalog.base import table
    for name in ("nation", "customer", "orders"):
        rows = table(spark, "/root/testdata/sf0.001", name)
        if name == "orders":
            rows = rows.withColumn("o_totalprice", F.col("o_totalprice") / 1e4)
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["E9_combine_arms"](spark, str(tmp_path)).first()
    rel = con.execute(catalog.ORACLES["E9_combine_arms"])
    want = dict(zip([c[0] for c in rel.description], rel.fetchone()))
    assert want["mu1_se"] ** 2 < C.VARIANCE_FLOOR
    assert got["cross_arm_correlation"] == pytest.approx(want["cross_arm_correlation"], abs=1e-5)


def test_rows_put_together_for_a_cell_stay_small():
    import numpy as np
    import pyarrow as pa
    from sitemosaic.operators.gram import buffered
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(125_000.0))], ["x"])
    tables = list(buffered([batch] * 24))
    assert max(t.nbytes for t in tables) <= 8 << 20 and sum(t.num_rows for t in tables) == 24 * 125_000
