"""Inputs shared by the registered queries, derived from the given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import TARGET
from ..operators.folds import assign_folds
from ..storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

METHODS = ("target_only", "one_round", "sample_size", "inverse_variance", "federated_dr")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared folder."""
    return new_folder(spark)


def R(expr: str, name: str, digits: int = 6) -> str:
    """SQL counterpart of F.round(...): no negative zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rnd(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


# -- multi-site cohort: orders x customer x nation ---------------------------------
def base(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("obs_id"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"),
        F.when(F.col("n_regionkey") == 0, TARGET).otherwise(F.concat(F.lit("s"), F.col("n_regionkey"))).alias("site"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("a"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y_bin"), (F.col("o_totalprice") / 1e5).alias("y_num"),
        (F.col("c_acctbal") / 1000.0).alias("x1"), (F.month("o_orderdate") / 12.0).alias("x2"),
        (F.dayofmonth("o_orderdate") / 31.0).alias("x3"), (F.year("o_orderdate") - 1995.0).alias("x4"),
        F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("cust"))


BASE_SQL = """
base AS (
  SELECT o_orderkey AS obs_id, n_regionkey AS region, n_nationkey AS nation,
         CASE WHEN n_regionkey = 0 THEN 't' ELSE 's' || n_regionkey END AS site,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS a,
         CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS y_bin, o_totalprice / 1e5 AS y_num,
         c_acctbal / 1000e0 AS x1, month(o_orderdate) / 12e0 AS x2, day(o_orderdate) / 31e0 AS x3,
         year(o_orderdate) - 1995e0 AS x4, c_mktsegment AS seg, o_orderpriority AS priority, o_orderstatus AS status,
         o_custkey AS cust
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def obs(spark, d, y: str = "y_num", features=("x1",), folds: int | None = None, group: bool = False) -> DataFrame:
    x = F.array(*features)
    o = base(spark, d).select("obs_id", "site", "a", F.col(y).alias("y"), x.alias("w"), x.alias("z"),
                              (F.col("cust") + 1 if group else F.lit(None)).cast("long").alias("group_id"))
    return assign_folds(o, folds) if folds else o


def fold_sql(k: int, src: str = "base", seed: int = 7) -> str:
    """CTE `f`: the source plus a balanced fold by (site, a)."""
    return (f"f AS (SELECT *, CAST((row_number() OVER (PARTITION BY site, a ORDER BY md5(concat('{seed}:', obs_id)), obs_id) - 1)"
            f" % {k} + 1 AS INTEGER) AS fold FROM {src})")


def cv_sql(src: str = "base", outer: str = "'000'", seed: int = 11, name: str = "v") -> str:
    """CTEs: the source plus its penalty-selection fold, as many per site as the smaller arm carries."""
    return (f"vk AS (SELECT site, min(least(n, greatest(4, least(5, n // 5)))) AS k FROM (SELECT site, a, count(*) AS n FROM {src} GROUP BY site, a) GROUP BY site),"
            f" {name} AS (SELECT {src}.*, CAST((row_number() OVER (PARTITION BY {src}.site, a ORDER BY {outer}, md5(concat('{seed}:', obs_id)), obs_id) - 1) % k + 1 AS INTEGER) AS cv FROM {src} JOIN vk ON vk.site = {src}.site)")


# -- result-shaped table from events -------------------------------------------------
def results(spark, d) -> DataFrame:
    """Each event is one replicate of every method; numbers are arithmetic on its columns."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("kk"))
    m = F.explode(F.array(*[F.struct(F.lit(i).alias("mi"), F.lit(n).alias("method")) for i, n in enumerate(METHODS)])).alias("m")
    e = e.select("*", m).select("event_id", "user_id", "event_type", "value", "kk", "m.mi", "m.method")
    bias = ((F.col("value") - 50.0) / 100.0 * (0.5 + F.col("mi") * 0.125)
            + (F.pmod(F.col("event_id") * (F.col("mi") + 3), F.lit(97)) - 48.0) / 512.0)
    se = 0.25 + F.pmod(F.col("event_id"), F.lit(13)) / 64.0 + F.col("mi") / 32.0
    bad = F.pmod(F.col("event_id") + F.col("mi"), F.lit(101)) == 0
    r = e.select(
        F.col("event_id").alias("sim_id"), F.col("event_type").alias("config"),
        F.when(F.col("user_id") % 2 == 0, 10).otherwise(100).alias("p"),
        F.when(F.col("kk") % 3 == 0, 0.0).when(F.col("kk") % 3 == 1, 1.0).otherwise(2.5).alias("rho"),
        (1.0 + (F.col("user_id") % 5) / 2.0).alias("cutoff"), "method", "mi", "kk", "user_id",
        F.lit(0.5).alias("truth"), F.when(~bad, bias).alias("bias"), F.when(~bad, se).alias("se"))
    lo, hi = F.col("estimate") - 1.96 * F.col("se"), F.col("estimate") + 1.96 * F.col("se")
    r = r.withColumn("estimate", F.col("truth") + F.col("bias"))
    r = r.withColumns({"ci_lower": lo, "ci_upper": hi}).withColumns({"ci_width": F.col("ci_upper") - F.col("ci_lower")})
    return r.withColumn("coverage", (F.col("ci_lower") <= F.col("truth")) & (F.col("truth") <= F.col("ci_upper")))


RESULTS_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS kk FROM events),
meth(mi, method) AS (VALUES (0, 'target_only'), (1, 'one_round'), (2, 'sample_size'), (3, 'inverse_variance'), (4, 'federated_dr')),
r0 AS (
  SELECT event_id AS sim_id, event_type AS config, CASE WHEN user_id % 2 = 0 THEN 10 ELSE 100 END AS p,
         CASE kk % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 ELSE 2.5e0 END AS rho, 1e0 + (user_id % 5) / 2e0 AS cutoff,
         method, mi, kk, user_id, 0.5e0 AS truth,
         CASE WHEN (event_id + mi) % 101 <> 0 THEN (value - 50e0) / 100e0 * (0.5e0 + mi * 0.125e0)
              + ((event_id * (mi + 3)) % 97 - 48e0) / 512e0 END AS bias,
         CASE WHEN (event_id + mi) % 101 <> 0 THEN 0.25e0 + (event_id % 13) / 64e0 + mi / 32e0 END AS se
  FROM ev CROSS JOIN meth),
r1 AS (SELECT *, truth + bias AS estimate FROM r0),
r2 AS (SELECT *, estimate - 1.96e0 * se AS ci_lower, estimate + 1.96e0 * se AS ci_upper FROM r1),
res AS (SELECT *, ci_upper - ci_lower AS ci_width, (ci_lower <= truth AND truth <= ci_upper) AS coverage FROM r2)"""
