"""Queries: sources (S), projections (P), feature statistics (F), validation (V), folds (K)."""
from pyspark.sql import functions as F, types as T

from .. import functions as fx
from ..operators import cohort as co, folds as fo, validation as va
from ..plans.cohort_plan import CohortRecipe, build_cohort, build_sites
from ..sources import (CohortSpec, read_cohort_csv, read_run_results, site_cohort, table_fingerprint, wrapped_long,
                       with_setting_from_path, write_results)
from .base import BASE_SQL, R, RESULTS_SQL, base, cv_sql, fold_sql, obs, query, results, rnd, scratch

WITH = "WITH " + BASE_SQL


# -- S -------------------------------------------------------------------------------
@query("S1_read_cohort_csv", f"{WITH} SELECT obs_id, site, a, {R('y_num', 'y', 9)}, {R('x1', 'x1', 9)}, seg FROM base")
def s1(spark, d):
    path = scratch(spark)
    base(spark, d).select("obs_id", "site", "a", F.col("y_num").alias("y"), "x1", "seg").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("obs_id", T.LongType()), ("site", T.StringType()), ("a", T.IntegerType()), ("y", T.DoubleType()),
        ("x1", T.DoubleType()), ("seg", T.StringType()))])
    return rnd(read_cohort_csv(spark, path, schema), 9)


@query("S2_site_cohort", f"""{WITH}, m AS (SELECT region, CASE WHEN region = 2 THEN 't' ELSE 's' || row_number() OVER (
  PARTITION BY region = 2 ORDER BY region) END AS site FROM (SELECT DISTINCT region FROM base))
SELECT obs_id, m.site, a, {R('y_num', 'y', 9)}, {R('x1', 'w1', 9)}, {R('x2', 'w2', 9)} FROM base JOIN m USING (region)""")
def s2(spark, d):
    spec = CohortSpec(site="region", treatment="a", outcome="y_num", features=("x1", "x2"), target=2, obs_id="obs_id")
    o = site_cohort(base(spark, d), spec)
    return rnd(o.select("obs_id", "site", "a", "y", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2")), 9)


@query("S3_read_run_results", f"""WITH {RESULTS_SQL}
SELECT sim_id, method, {R('estimate', 'estimate', 11)}, {R('CASE WHEN p = 10 THEN se END', 'se', 11)},
       {R('CASE WHEN p = 100 THEN rho END', 'rho')}, CAST(NULL AS DOUBLE) AS bootstrap_ratio FROM res""")
def s3(spark, d):
    r, path = results(spark, d), scratch(spark)
    na = F.lit(None).cast("double").alias("bootstrap_ratio")
    opt = {"header": True, "nullValue": "NA"}
    r.filter("p = 10").select("sim_id", "method", "estimate", "se", na).write.options(**opt).csv(path + "/a")
    r.filter("p = 100").select("sim_id", "method", "estimate", "rho", na).write.options(**opt).csv(path + "/b")
    u = read_run_results(spark, [path + "/a", path + "/b"])
    return rnd(u.withColumns({"sim_id": F.col("sim_id").cast("long"), "estimate": F.round("estimate", 11)}), 11)


@query("S4_setting_from_path", """
WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/runs/out_n' || (user_id * 10) || '_K' || (event_id % 7 + 2) || '_p' || (user_id % 90 + 10) || '_x.csv'
  WHEN 1 THEN '/runs/c_K' || (event_id % 7 + 2) || '_p' || (user_id % 90 + 10) || '_seed' || event_id || '_kf' || (event_id % 9 + 2) || '.csv'
  ELSE '/runs/t_k' || (event_id % 7 + 2) || 'p' || (user_id % 90 + 10) || '_seed' || event_id || '.csv' END AS f FROM events)
SELECT event_id, CAST(nullif(regexp_extract(f, '_n([0-9]+)_K([0-9]+)_p([0-9]+)_', 1), '') AS INTEGER) AS n_total,
  event_id % 7 + 2 AS K, CAST(regexp_extract(f, '_[kK][0-9]+_?p([0-9]+)', 1) AS INTEGER) AS p,
  CAST(nullif(regexp_extract(f, '_seed([0-9]+)', 1), '') AS INTEGER) AS seed,
  CAST(nullif(regexp_extract(f, '_kf([0-9]+)', 1), '') AS INTEGER) AS kf FROM p""")
def s4(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    k, p, i = (F.col("event_id") % 7 + 2).cast("string"), (F.col("user_id") % 90 + 10).cast("string"), F.col("event_id").cast("string")
    f = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/runs/out_n"), F.col("user_id") * 10, F.lit("_K"), k, F.lit("_p"), p, F.lit("_x.csv")))
         .when(F.col("event_id") % 3 == 1, F.concat(F.lit("/runs/c_K"), k, F.lit("_p"), p, F.lit("_seed"), i, F.lit("_kf"), F.col("event_id") % 9 + 2, F.lit(".csv")))
         .otherwise(F.concat(F.lit("/runs/t_k"), k, F.lit("p"), p, F.lit("_seed"), i, F.lit(".csv"))))
    out = with_setting_from_path(e.select("event_id", f.alias("f")), "f").drop("f")
    return out.withColumn("K", F.col("K").cast("long"))


@query("S5_write_results", f"WITH {RESULTS_SQL} SELECT method, config, {R('avg(estimate)', 'estimate')}, {R('avg(se)', 'se')} FROM res GROUP BY method, config")
def s5(spark, d):
    r = results(spark, d).groupBy("method", "config").agg(F.avg("estimate").alias("estimate"), F.avg("se").alias("se"))
    path = scratch(spark)
    write_results(r, path)
    return rnd(spark.read.parquet(path + "/results"))


@query("S6_table_fingerprint", f"""{WITH}, h AS (SELECT md5(concat_ws(chr(31), 'v' || a, 'v' || nation, 'v' || obs_id, coalesce('v' || nullif(seg, 'BUILDING'), 'n'), 'v' || site)) AS h FROM base),
 n AS (SELECT CAST(('0x' || h[1:12]) AS BIGINT) AS x, CAST(('0x' || h[13:24]) AS BIGINT) AS y FROM h)
 SELECT count(*) AS n_rows, bit_xor(x) AS xor_hash, CAST(sum(y) AS BIGINT) AS sum_hash FROM n""")
def s6(spark, d):
    b = base(spark, d).select("obs_id", "site", "a", "nation", F.when(F.col("seg") != "BUILDING", F.col("seg")).alias("seg"))
    return table_fingerprint(b).withColumn("sum_hash", wrapped_long("sum_hash"))


# -- P -------------------------------------------------------------------------------
@query("P1_recode_labels", f"""{WITH} SELECT obs_id, CASE seg WHEN 'BUILDING' THEN 'industry' WHEN 'MACHINERY' THEN 'industry' ELSE seg END AS seg
FROM base WHERE seg <> 'HOUSEHOLD'""")
def p1(spark, d):
    m = {"BUILDING": "industry", "MACHINERY": "industry", "HOUSEHOLD": None}
    return co.recode_labels(base(spark, d), "seg", m).select("obs_id", "seg")


@query("P2_code_binary", """SELECT o_orderkey AS obs_id, CASE WHEN upper(regexp_replace(t, '\\s+', '', 'g')) IN ('1-URGENT','2-HIGH') THEN 1
 WHEN upper(regexp_replace(t, '\\s+', '', 'g')) IN ('5-LOW') THEN 0 END AS a
 FROM (SELECT o_orderkey, ' ' || lower(replace(o_orderpriority, '-', ' - ')) || ' ' AS t FROM orders)""")
def p2(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = F.concat(F.lit(" "), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" - "))), F.lit(" "))
    return o.select(F.col("o_orderkey").alias("obs_id"), fx.code_binary(t, ["1-URGENT", "2-HIGH"], ["5-LOW"]).alias("a"))


@query("P3_code_duration", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS DOUBLE) AS days
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def p3(spark, d):
    l, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    j = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", fx.code_duration(F.unix_date(F.to_date("o_orderdate")), F.unix_date(F.to_date("l_shipdate"))).alias("days"))


@query("P4_observed_cases", f"{WITH} SELECT obs_id, a, {R('y_num', 'y', 9)} FROM base WHERE status <> 'P' AND priority <> '3-MEDIUM'")
def p4(spark, d):
    b = base(spark, d).select("obs_id", F.when(F.col("priority") != "3-MEDIUM", F.col("a")).alias("a"),
                              F.when(F.col("status") != "P", F.col("y_num")).alias("y"))
    return rnd(co.observed_cases(b), 9)


@query("P5_log1p_features", f"{WITH} SELECT obs_id, {R('ln(1e0 + y_num)', 'log1p_y_num')}, {R('ln(1e0 + x2)', 'log1p_x2')} FROM base")
def p5(spark, d):
    return rnd(co.log1p_features(base(spark, d).select("obs_id", "y_num", "x2"), ["y_num", "x2"]))


@query("P6_missing_indicator", f"{WITH} SELECT obs_id, CASE WHEN v IS NULL OR trim(v) = '' THEN 1 ELSE 0 END AS miss FROM (SELECT obs_id, "
       "CASE WHEN nation = 3 THEN NULL WHEN nation = 4 THEN '  ' ELSE seg END AS v FROM base)")
def p6(spark, d):
    v = F.when(F.col("nation") == 3, None).when(F.col("nation") == 4, "  ").otherwise(F.col("seg"))
    return base(spark, d).select("obs_id", fx.missing_indicator(v).alias("miss"))


@query("P7_combine_merge", f"""{WITH} SELECT obs_id, CASE WHEN a = 1 OR y_bin = 1 THEN 1 ELSE 0 END AS either,
 CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'INDUSTRY' ELSE seg END AS seg FROM base""")
def p7(spark, d):
    return base(spark, d).select("obs_id", fx.combine_indicators("a", "y_bin").alias("either"),
                                 fx.merge_levels("seg", ["BUILDING", "MACHINERY"], "INDUSTRY").alias("seg"))


@query("P8_flag01", f"{WITH} SELECT obs_id, CASE WHEN status = 'F' OR status = 'P' THEN 1 ELSE 0 END AS flag FROM base")
def p8(spark, d):
    return base(spark, d).select("obs_id", fx.flag01(F.when(F.col("status") == "F", "yes").when(F.col("status") == "P", "1")).alias("flag"))


@query("P9_clip_family", f"""{WITH} SELECT obs_id, {R('greatest(least(x1, 2.5e0), -2.5e0)', 'range', 11)},
 {R('greatest(least(y_num / 4, 0.99e0), 0.01e0)', 'propensity', 11)}, {R('greatest(least(y_num / 4, 0.999e0), 0.001e0)', 'outcome', 11)},
 {R('greatest(least(x1, 5e0), -5e0)', 'truncated', 11)} FROM base""")
def p9(spark, d):
    q = F.col("y_num") / 4
    return rnd(base(spark, d).select("obs_id", fx.clip("x1").alias("range"), fx.clip_propensity(q).alias("propensity"),
                                     fx.clip_outcome(q).alias("outcome"), fx.truncate("x1").alias("truncated")), 11)


@query("P10_logistic_log", f"""{WITH} SELECT obs_id, {R('1 / (1 + exp(-greatest(least(x1 * 8, 50e0), -50e0)))', 'h')},
 {R('ln(greatest(x1, 1e-8))', 'l')} FROM base""")
def p10(spark, d):
    return rnd(base(spark, d).select("obs_id", fx.logistic(F.col("x1") * 8).alias("h"), fx.safe_log("x1").alias("l")))


def _sc(e):
    return f"(({e}) - avg({e}) OVER ()) / stddev_samp({e}) OVER ()"


@query("P11_transform_features", f"""{WITH} SELECT obs_id,
 {R(_sc('exp(0.5e0 * x1)'), 's1', 5)}, {R(_sc('10 + x2 / (1 + exp(x1))'), 's2', 5)}, {R(_sc('pow(0.04e0 * x1 * x3 + 0.5e0, 3)'), 's3', 5)},
 {R(_sc('pow(x2 + x4 + 20, 2)'), 's4', 5)}, {R(_sc('x1 * x1'), 'm1', 5)}, {R(_sc('x1 * x2'), 'm2', 5)}, {R(_sc('x3 * x3'), 'm3', 5)},
 {R(_sc('x2 + x4'), 'm4', 5)} FROM base""")
def p11(spark, d):
    c = ["x1", "x2", "x3", "x4"]
    s = co.transform_features(base(spark, d).select("obs_id", *c), c, "strong", "_s")
    m = co.transform_features(s, c, "mild", "_m")
    return rnd(m.select("obs_id", *[F.col(f"x{i}_s").alias(f"s{i}") for i in range(1, 5)], *[F.col(f"x{i}_m").alias(f"m{i}") for i in range(1, 5)]), 5)


@query("P12_parse_bool", """SELECT event_id, CASE upper(trim(t)) WHEN 'TRUE' THEN TRUE WHEN 'T' THEN TRUE WHEN '1' THEN TRUE WHEN 'FALSE' THEN FALSE
 WHEN 'F' THEN FALSE WHEN '0' THEN FALSE END AS b FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN ' T ' WHEN 2 THEN '1'
 WHEN 3 THEN 'False' WHEN 4 THEN 'f' WHEN 5 THEN '0' WHEN 6 THEN 'NA' END AS t FROM events)""")
def p12(spark, d):
    vals = ["true", " T ", "1", "False", "f", "0", "NA", None]
    t = F.array(*[F.lit(v) for v in vals])[(F.col("event_id") % 8).cast("int")]
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fx.parse_bool(t).alias("b"))


# -- F -------------------------------------------------------------------------------
MISS = "base0 AS (SELECT *, CASE WHEN x1 >= 0 THEN x1 END AS v FROM base)"


@query("F1_impute_median", f"{WITH}, {MISS} SELECT obs_id, {R('coalesce(v, (SELECT median(v) FROM base0 WHERE region <> 4))', 'v')} FROM base0")
def f1(spark, d):
    b = base(spark, d).select("obs_id", "region", F.when(F.col("x1") >= 0, F.col("x1")).alias("v"))
    return rnd(co.impute_median(b, ["v"], train_pred=F.col("region") != 4).drop("region"))


LV = "base0 AS (SELECT *, CASE WHEN nation = 3 THEN NULL WHEN nation = 4 THEN '' ELSE seg END AS v FROM base)"


def with_gaps(b):
    return b.withColumn("v", F.when(F.col("nation") == 3, None).when(F.col("nation") == 4, "").otherwise(F.col("seg")))


@query("F2_impute_mode", f"{WITH}, {LV}, m AS (SELECT v FROM base0 WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) "
       "SELECT obs_id, CASE WHEN base0.v IS NULL OR base0.v = '' THEN m.v ELSE base0.v END AS v FROM base0 CROSS JOIN m")
def f2(spark, d):
    return co.impute_mode(with_gaps(base(spark, d)).select("obs_id", "v"), ["v"])


SEGS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("F3_one_hot", f"{WITH} SELECT obs_id, " + ", ".join(f"CASE WHEN seg = '{s}' THEN 1e0 ELSE 0e0 END AS seg_{s}" for s in SEGS)
       + ", " + ", ".join(f"CASE WHEN status = '{s}' THEN 1e0 ELSE 0e0 END AS status_{s}" for s in "OP") + " FROM base")
def f3(spark, d):
    return co.one_hot(base(spark, d).select("obs_id", "seg", "status"), ["seg", "status"])


@query("F3_one_hot_sparse", f"""{WITH}, lo AS (SELECT obs_id, 'seg' AS c, seg AS l FROM base UNION ALL SELECT obs_id, 'status', status FROM base UNION ALL SELECT obs_id, 'cust', CAST(cust AS VARCHAR) FROM base),
 lv AS (SELECT DISTINCT c, l FROM lo), d AS (SELECT c, l, row_number() OVER (PARTITION BY c ORDER BY md5(concat('0:', l)), l) - 1 AS i FROM (SELECT *, min(l) OVER (PARTITION BY c) AS f FROM lv) WHERE l <> f)
 SELECT obs_id, count(i) AS n_hot, coalesce(string_agg(c || ':' || i, ',' ORDER BY c, i), '') AS hot FROM lo LEFT JOIN d USING (c, l) GROUP BY obs_id""")
def f3b(spark, d):
    b, cols = base(spark, d).select("obs_id", "seg", "status", "cust"), ["seg", "status", "cust"]
    hot = co.one_hot_sparse(b, "obs_id", cols, co.level_dictionary(b, cols))
    text = F.array_join(F.transform("hot", lambda p: F.concat(p["column"], F.lit(":"), p["index"].cast("string"))), ",")
    return hot.select("obs_id", F.size("hot").cast("long").alias("n_hot"), text.alias("hot"))


@query("F4_standardize", f"""{WITH} SELECT obs_id, {R('(x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER ()', 'x1')},
 {R('(x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER ()', 'x2')}, 0e0 AS one FROM base""")
def f4(spark, d):
    b = base(spark, d).select("obs_id", "x1", "x2", F.lit(1.0).alias("one"))
    return rnd(co.standardize(b, ["x1", "x2", "one"]))


@query("F5_fold_preprocess", f"""{WITH}, {MISS}, {fold_sql(3, 'base0')}, k(outer_fold) AS (VALUES (1), (2), (3)),
 fl AS (SELECT outer_fold, median(v) AS fill FROM f, k WHERE fold <> outer_fold GROUP BY 1),
 st AS (SELECT k.outer_fold, avg(coalesce(v, fill)) AS m, stddev_pop(coalesce(v, fill)) AS s, avg(x2) AS m2, stddev_pop(x2) AS s2
        FROM f, k JOIN fl ON fl.outer_fold = k.outer_fold WHERE fold <> k.outer_fold GROUP BY 1)
 SELECT obs_id, st.outer_fold, {R('(coalesce(v, fill) - m) / s', 'v')}, {R('(x2 - m2) / s2', 'x2')} FROM f, st JOIN fl USING (outer_fold)""")
def f5(spark, d):
    b = base(spark, d).select("obs_id", "site", "a", F.when(F.col("x1") >= 0, F.col("x1")).alias("v"), "x2")
    f = fo.assign_folds(b, 3).persist()
    return rnd(co.fold_preprocess(f, ["v", "x2"], 3).select("obs_id", "outer_fold", "v", "x2"))


def bspline_sql(columns=("x1", "x2"), knots: int = 5, degree: int = 3) -> str:
    """The Cox-de Boor recursion, one query per degree; knots are inner quantiles and differ on these tables."""
    stats, steps, out = [], [[] for _ in range(degree + 1)], []
    for x in columns:
        stats += [f"min({x}) AS {x}_lo", f"max({x}) AS {x}_hi"] + [f"quantile_cont({x}, {i + 1} / {knots + 1}e0) AS {x}_k{i + 1}" for i in range(knots)]
        t = [f"{x}_lo"] * (degree + 1) + [f"{x}_k{i + 1}" for i in range(knots)] + [f"{x}_hi"] * (degree + 1)
        have = [None if t[i] == t[i + 1] else f"{x}_b0_{i}" for i in range(len(t) - 1)]
        steps[0] += [f"CASE WHEN {x} >= {t[i]} AND {x} {'<=' if i == len(t) - degree - 2 else '<'} {t[i + 1]} THEN 1e0 ELSE 0e0 END AS {b}" for i, b in enumerate(have) if b]
        for d in range(1, degree + 1):
            new = []
            for i in range(len(t) - 1 - d):
                terms = [f"({x} - {t[i]}) / ({t[i + d]} - {t[i]}) * {have[i]}"] if have[i] and t[i + d] != t[i] else []
                terms += [f"({t[i + d + 1]} - {x}) / ({t[i + d + 1]} - {t[i + 1]}) * {have[i + 1]}"] if have[i + 1] and t[i + d + 1] != t[i + 1] else []
                new.append(f"{x}_b{d}_{i}" if terms else None)
                steps[d] += [f"{' + '.join(terms)} AS {new[-1]}"] if terms else []
            have = new
        out += [R(b or "0e0", f"{x}_bs{j + 1}") for j, b in enumerate(have[1:])]
    ctes = [f"g0 AS (SELECT base.obs_id, base.a * 1e0 AS a, {', '.join(columns)}, q.*, {', '.join(steps[0])} FROM base, q)"]
    ctes += [f"g{d} AS (SELECT *, {', '.join(steps[d])} FROM g{d - 1})" for d in range(1, degree + 1)]
    return f"{WITH}, q AS (SELECT {', '.join(stats)} FROM base), {', '.join(ctes)} SELECT obs_id, a, {', '.join(out)} FROM g{degree}"


@query("F6_bspline_features", bspline_sql())
def f6(spark, d):
    return rnd(co.bspline_features(base(spark, d).select("obs_id", "x1", "x2", F.col("a").cast("double").alias("a")), ["x1", "x2", "a"]))


@query("F7_collapse_sites", f"""{WITH}, c AS (SELECT 'N' || nation AS raw_site, count(*) AS n FROM base GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, raw_site) AS r FROM c),
 m AS (SELECT r.*, least(r.r, 6) AS k FROM r), j AS (SELECT m.raw_site, m.n, m.r, kept.raw_site AS site_var FROM m JOIN r kept ON kept.r = m.k)
 SELECT raw_site, site_var, n, string_agg(raw_site, ';' ORDER BY r) OVER (PARTITION BY site_var ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS components FROM j""")
def f7(spark, d):
    b = base(spark, d).select(F.concat(F.lit("N"), F.col("nation")).alias("site_var"))
    return co.collapse_sites(b, 6).drop("r")


@query("F8_normalize_log_weights", f"""{WITH}, s AS (SELECT *, exp(greatest(-0.3e0 * x1 - max(-0.3e0 * x1) OVER (PARTITION BY site), ln(2.2250738585072014e-308))) AS u FROM base)
 SELECT obs_id, {R('u / avg(u) OVER (PARTITION BY site)', 'weight')} FROM s""")
def f8(spark, d):
    b = base(spark, d).select("obs_id", "site", (F.col("x1") * -0.3).alias("lw"))
    return rnd(co.normalize_log_weights(b, "lw", ["site"]).select("obs_id", "weight"))


@query("F9_unit_norm_weighted_mean", f"""{WITH}, u AS (SELECT *, x1 / sqrt(sum(x1 * x1) OVER (PARTITION BY site)) AS u FROM base)
 SELECT site, {R('sum(u * u)', 'norm')}, {R('sum(u)', 'total', 5)}, {R('sum(y_num * x2) / sum(x2)', 'wmean')} FROM u GROUP BY site""")
def f9(spark, d):
    u = co.unit_norm(base(spark, d).select("site", "x1", "x2", "y_num"), "x1", ["site"], "u")
    g = u.groupBy("site").agg(F.sum(F.col("u") * F.col("u")).alias("norm"), F.round(F.sum("u"), 5).alias("total"), co.weighted_mean("y_num", "x2").alias("wmean"))
    return rnd(g)


@query("F10_safe_var", f"{WITH} SELECT cust, {R('greatest(coalesce(var_samp(y_num), 1e-8), 1e-8)', 'v')} FROM base GROUP BY cust")
def f10(spark, d):
    return rnd(base(spark, d).groupBy("cust").agg(co.safe_var("y_num").alias("v")))


@query("F11_site_summary", f"{WITH} SELECT site, count(*) AS n, count(*) FILTER (WHERE a = 1) AS treated, count(*) FILTER (WHERE a = 0) AS control, 2 AS features FROM base GROUP BY site")
def f11(spark, d):
    return co.site_summary(obs(spark, d, features=("x1", "x2")))


@query("F12_cell_diagnostics", f"""{WITH}, c AS (SELECT site, count(*) FILTER (WHERE a = 0 AND y_bin = 0) AS c1, count(*) FILTER (WHERE a = 0 AND y_bin = 1) AS c2,
 count(*) FILTER (WHERE a = 1 AND y_bin = 0) AS c3, count(*) FILTER (WHERE a = 1 AND y_bin = 1) AS c4 FROM base GROUP BY site)
 SELECT min(least(c1, c2, c3, c4)) AS min_cell, min(CASE WHEN site = 't' THEN least(c1, c2, c3, c4) END) AS min_target_cell,
 CAST(sum((c1 < 8)::INT + (c2 < 8)::INT + (c3 < 8)::INT + (c4 < 8)::INT) AS BIGINT) AS cells_below FROM c""")
def f12(spark, d):
    b = base(spark, d).select("site", "a", F.col("y_bin").alias("y"))
    return co.cell_diagnostics(b)


@query("F13_support_floor", f"""{WITH}, s AS (SELECT *, CASE WHEN site = 's2' AND a = 1 THEN 3e0 ELSE x1 END AS v FROM base),
 t AS (SELECT avg(v) AS tm, avg(x2) AS tm2 FROM s WHERE site = 't'),
 g AS (SELECT site, max(v) - min(v) <= 1.4901161193847656e-08 * greatest(1, abs(min(v)), abs(max(v))) AS c1, (max(v) + min(v)) / 2 AS m1 FROM s WHERE a = 1 AND site <> 't' GROUP BY site)
 SELECT site, CASE WHEN c1 THEN 1 ELSE 0 END::BIGINT AS constant_features, {R('CASE WHEN c1 AND abs(tm - m1) > 0 THEN abs(tm - m1) + 1e-6 * greatest(1, abs(tm - m1)) ELSE 0 END', 'lambda_floor')} FROM g, t""")
def f13(spark, d):
    v = F.when((F.col("site") == "s2") & (F.col("a") == 1), 3.0).otherwise(F.col("x1"))
    b = base(spark, d).select("site", "a", F.array(v, "x2").alias("z"))
    m = b.filter("site = 't'").agg(F.array(F.lit(1.0), F.avg(F.col("z")[0]), F.avg(F.col("z")[1])).alias("moment"))
    return rnd(co.support_floor(b.filter("site <> 't'"), m, 1, 2))


WT = "w AS (SELECT obs_id, site, x1, x2, greatest(least(exp(-0.4e0 * x1 + y_num / 4), 10e0), 0.1e0) AS weight FROM base)"


def _weights(spark, d):
    w = fx.clip(F.exp(F.col("x1") * -0.4 + F.col("y_num") / 4), 0.1, 10.0)
    return base(spark, d).select("obs_id", "site", "y_num", w.alias("weight"), F.array("x1", "x2").alias("z"))


@query("F14_weight_diagnostics", f"""{WITH}, {WT}, t AS (SELECT avg(x1) AS t1, avg(x2) AS t2 FROM w WHERE site = 't'),
 g AS (SELECT site, count(*) AS n, sum(weight) * sum(weight) / sum(weight * weight) AS ess, max(weight) AS mx, max(weight) / sum(weight) AS share,
 count(*) FILTER (WHERE weight <= 0.1e0) AS at_lower, count(*) FILTER (WHERE weight >= 10) AS at_upper, quantile_cont(weight, 0.5) AS p50,
 quantile_cont(weight, 0.9) AS p90, quantile_cont(weight, 0.95) AS p95, quantile_cont(weight, 0.99) AS p99,
 sum(weight * x1) / sum(weight) AS m1, sum(weight * x2) / sum(weight) AS m2 FROM w WHERE site <> 't' GROUP BY site)
 SELECT site, n, {R('ess', 'ess', 4)}, {R('mx', 'max_weight')}, {R('share', 'max_share')}, at_lower, at_upper, {R('p50', 'p50')}, {R('p90', 'p90')},
 {R('p95', 'p95')}, {R('p99', 'p99')}, {R('greatest(abs(m1 - t1), abs(m2 - t2))', 'max_imbalance')} FROM g, t""")
def f14(spark, d):
    w = _weights(spark, d)
    dg = co.weight_diagnostics(w.filter("site <> 't'"))
    out = dg.join(co.weighted_imbalance(w, 2), "site")
    return rnd(out.withColumn("ess", F.round("ess", 4)))


@query("F15_influence_concentration", f"""{WITH}, q AS (SELECT site, power(y_num - avg(y_num) OVER (PARTITION BY site), 2) AS q FROM base),
 r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY q DESC) AS r FROM q)
 SELECT site, {R('max(q) / sum(q)', 'top1_share')}, {R('sum(q) FILTER (WHERE r <= 20) / sum(q)', 'topm_share')} FROM r GROUP BY site""")
def f15(spark, d):
    b = base(spark, d).select("obs_id", "site", "y_num")
    m = b.groupBy("site").agg(F.avg("y_num").alias("m"))
    return rnd(co.influence_concentration(b.join(m, "site").withColumn("influence", F.col("y_num") - F.col("m")), 20))


def recipe():
    return CohortRecipe(
        site="seg", treatment=fx.code_binary("treat", ["YES"], ["NO"]),
        outcomes={"fulfilled": fx.code_binary("state", ["F"], ["O"]), "value": F.col("amount")},
        continuous=("bal", "mon"), flags=("flag_a", "flag_b"), categorical=("grade",), log_columns=("mon",), missing_flag="mon",
        combine=("either", ("flag_a", "flag_b")), merge=("grade", ("4-NOT SPECIFIED", "5-LOW"), "6-OTHER"))


RAW_SQL = WITH + """, raw AS (SELECT obs_id, seg, CASE WHEN a = 1 THEN ' yes' ELSE 'N o' END AS treat, status AS state, y_num AS amount,
 CASE WHEN x1 >= 0 THEN x1 END AS bal, CASE WHEN nation = 3 THEN NULL WHEN nation = 4 THEN ' ' ELSE CAST(CAST(round(x2 * 12) AS INTEGER) AS VARCHAR) END AS mon,
 CASE WHEN nation % 2 = 0 THEN 'Yes' ELSE 'No' END AS flag_a, CASE WHEN nation % 3 = 0 THEN 'TRUE' END AS flag_b,
 CASE WHEN nation = 5 THEN NULL ELSE priority END AS grade FROM base)"""


def raw_cohort(spark, d):
    mon = F.when(F.col("nation") == 3, None).when(F.col("nation") == 4, " ").otherwise(F.round(F.col("x2") * 12).cast("int").cast("string"))
    return base(spark, d).select(
        "obs_id", "seg", F.when(F.col("a") == 1, " yes").otherwise("N o").alias("treat"), F.col("status").alias("state"), F.col("y_num").alias("amount"),
        F.when(F.col("x1") >= 0, F.col("x1")).alias("bal"), mon.alias("mon"), F.when(F.col("nation") % 2 == 0, "Yes").otherwise("No").alias("flag_a"),
        F.when(F.col("nation") % 3 == 0, "TRUE").alias("flag_b"), F.when(F.col("nation") != 5, F.col("priority")).alias("grade"))


COHORT_SQL = RAW_SQL + """, k AS (SELECT * FROM raw WHERE state IN ('F', 'O') AND seg <> 'HOUSEHOLD'),
 st AS (SELECT median(bal) AS mb, median(CAST(nullif(trim(mon), '') AS DOUBLE)) AS mm, (SELECT grade FROM k WHERE grade IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mg FROM k),
 c0 AS (SELECT obs_id, CASE WHEN treat = ' yes' THEN 1 ELSE 0 END AS a, CASE WHEN state = 'F' THEN 1 ELSE 0 END AS y,
  CASE WHEN seg IN ('BUILDING') THEN 'MACHINERY' ELSE seg END AS site_var, coalesce(bal, mb) AS bal,
  ln(1 + coalesce(CAST(nullif(trim(mon), '') AS DOUBLE), mm)) AS log1p_mon, CASE WHEN mon IS NULL OR trim(mon) = '' THEN 1e0 ELSE 0e0 END AS mon_missing,
  CASE WHEN flag_a = 'Yes' OR coalesce(flag_b, '') = 'TRUE' THEN 1e0 ELSE 0e0 END AS either, coalesce(grade, mg) AS g FROM k, st),
 cohort AS (SELECT obs_id, a, y, site_var, bal, log1p_mon, mon_missing, either, CASE WHEN g = '2-HIGH' THEN 1e0 ELSE 0e0 END AS g2,
  CASE WHEN g = '3-MEDIUM' THEN 1e0 ELSE 0e0 END AS g3, CASE WHEN g IN ('4-NOT SPECIFIED', '5-LOW') THEN 1e0 ELSE 0e0 END AS g6 FROM c0)"""


def _cohort(spark, d):
    return build_cohort(raw_cohort(spark, d), recipe(), "fulfilled", "grouped_log_missing", {"HOUSEHOLD": None, "BUILDING": "MACHINERY"})


@query("F18_build_cohort", f"{COHORT_SQL} SELECT obs_id, a, y, site_var, {R('bal', 'bal')}, {R('log1p_mon', 'log1p_mon')}, mon_missing, either, g2, g3, g6 FROM cohort")
def f18(spark, d):
    c = _cohort(spark, d)
    return rnd(c.withColumnsRenamed({"grade_2-HIGH": "g2", "grade_3-MEDIUM": "g3", "grade_6-OTHER": "g6"}))


@query("F19_build_sites", COHORT_SQL + ", n AS (SELECT site_var, row_number() OVER (ORDER BY count(*) DESC, site_var) AS r FROM cohort GROUP BY 1), "
       "m AS (SELECT site_var, CASE WHEN r = 1 THEN 't' ELSE 's' || (least(r, 2) - 1) END AS site FROM n) "
       "SELECT obs_id, site, a, CAST(y AS DOUBLE) AS y, " + ", ".join(R(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", f"w{i}", 5)
                                                              for i, c in enumerate(("bal", "log1p_mon", "mon_missing", "either", "g2", "g3", "g6")))
       + " FROM cohort JOIN m USING (site_var)")
def f19(spark, d):
    o, _ = build_sites(_cohort(spark, d), k=2)
    return rnd(o.select("obs_id", "site", "a", "y", *[F.col("w")[i].alias(f"w{i}") for i in range(7)]), 5)


# -- V -------------------------------------------------------------------------------
@query("V1_validate_cohort", f"""{WITH} SELECT site, count(*) AS n, 0::BIGINT AS bad_features, 0::BIGINT AS bad_treatment, count(*) FILTER (WHERE y_num NOT IN (0, 1)) AS bad_outcome,
 count(*) FILTER (WHERE a = 1) AS treated, count(*) FILTER (WHERE a = 0) AS control, 1 AS p_min, 1 AS p_max FROM base GROUP BY site""")
def v1(spark, d):
    va.validate_cohort(obs(spark, d, y="y_bin"))
    return va.cohort_violations(obs(spark, d), "binomial")


@query("V2_fold_capacity", f"{WITH} SELECT site, count(*) AS n, count(*) FILTER (WHERE a = 1) AS n_arm, 'ok' AS status FROM base GROUP BY site")
def v2(spark, d):
    return va.fold_capacity(obs(spark, d), 5, 1)


@query("V3_scored_once", f"{WITH} SELECT obs_id, CASE WHEN nation = 7 THEN 0 ELSE 2 END::BIGINT AS times FROM base WHERE nation IN (7, 9)")
def v3(spark, d):
    b = base(spark, d)
    scored = b.filter("nation <> 7").select("obs_id").unionAll(b.filter("nation = 9").select("obs_id"))
    return va.not_scored_once(scored, b)


@query("V4_groups_across_folds", f"{WITH}, {fold_sql(5)} SELECT site, CAST(cust + 1 AS BIGINT) AS group_id FROM f GROUP BY ALL HAVING count(DISTINCT fold) > 1")
def v4(spark, d):
    return va.groups_across_folds(obs(spark, d, folds=5, group=True))


@query("V5_validate_radius")
def v5(spark, d):
    fit, inference = va.validate_radius(3.0, 5.0)
    return base(spark, d).agg(F.count_if(F.abs("x1") > fit).alias("beyond_fit"), F.count_if(F.abs("x1") > inference).alias("beyond_inference"))


# -- K -------------------------------------------------------------------------------
@query("K1_assign_folds", f"{WITH}, {fold_sql(5)} SELECT obs_id, site, a, fold FROM f")
def k1(spark, d):
    return obs(spark, d, folds=5).select("obs_id", "site", "a", "fold")


@query("K2_assign_group_folds", f"""{WITH}, g AS (SELECT DISTINCT site, CAST(cust + 1 AS BIGINT) AS gid FROM base),
 gf AS (SELECT *, CAST((row_number() OVER (PARTITION BY site ORDER BY md5(concat('7:', gid)), gid) - 1) % 5 + 1 AS INTEGER) AS fold FROM g)
 SELECT obs_id, base.site, fold FROM base JOIN gf ON base.site = gf.site AND gid = cust + 1""")
def k2(spark, d):
    return fo.assign_group_folds(obs(spark, d, group=True), 5).select("obs_id", "site", "fold")


@query("K3_fold_view", f"{WITH}, {fold_sql(5)} SELECT site, fold, count(*) AS n, {R('sum(y_num)', 'total', 4)} FROM f WHERE fold NOT IN (2, 4) GROUP BY ALL")
def k3(spark, d):
    v = fo.fold_view(obs(spark, d, folds=5), drop=[2, 4])
    return v.groupBy("site", "fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("K4_cv_fold_count", f"{WITH} SELECT cust, CAST(least(count(*), greatest(4, least(5, count(*) // 5))) AS INTEGER) AS folds FROM base GROUP BY cust")
def k4(spark, d):
    return base(spark, d).groupBy("cust").agg(F.count(F.lit(1)).alias("n")).select("cust", fo.cv_fold_count("n").alias("folds"))


@query("K4_selection_folds", f"{WITH}, {fold_sql(10)}, {cv_sql('f', 'fold')} SELECT obs_id, site, fold, cv FROM v")
def k4b(spark, d):
    return fo.assign_cv_folds(obs(spark, d, folds=10)).select("obs_id", "site", "fold", "cv")
